"""Changes: orders as changes of parts by customers; experience, directory history, complexity, likelihood, presorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeloom.functions import patterns
from changeloom.functions.scalars import round_half_away
from changeloom.operators import change, decisions, history, members, reports
from changeloom.plans.triage import presort
from changeloom.queries import query, table
from changeloom.sources import trees

_FILE = "replace(p_brand, '#', '') || '/' || replace(p_type, ' ', '/') || '/' || p_partkey"


def _parts(spark, sf):
    path = F.concat_ws("/", F.regexp_replace("p_brand", "#", ""), F.regexp_replace("p_type", " ", "/"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", path.alias("path"), "p_size")


def _lines(spark, sf):
    """A row a line: an order as the change, its customer as the author, the part's path as the file."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_parts(spark, sf), F.col("l_partkey") == F.col("p_partkey"))
    return met.select(F.col("l_orderkey").alias("change_id"), "l_linenumber", F.lit("shop").alias("repo"), "path", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("email"), F.col("o_orderdate").alias("ts"), "o_orderpriority", "l_quantity", "l_returnflag", "p_size")


_LINES = f"""p AS (SELECT p_partkey, {_FILE} AS path, p_size FROM part),
x AS (SELECT l_orderkey AS change_id, l_linenumber, path, 'c' || o_custkey AS email, o_orderdate AS ts, o_orderpriority, l_quantity, l_returnflag, p_size
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN p ON l_partkey = p_partkey)"""


def _split(spark, sf):
    """The changes of the last year, and the history before them."""
    x = _lines(spark, sf)
    edge = F.broadcast(x.agg(F.max("ts").alias("_last")))
    marked = x.crossJoin(edge).withColumn("_new", F.col("ts") >= F.col("_last") - F.expr("INTERVAL 365 DAYS")).drop("_last")
    status = F.when(F.col("l_linenumber") == 1, "A").otherwise("M")
    return marked.filter("_new"), marked.filter("NOT _new").select("repo", F.col("change_id").cast("string").alias("hash"), "email", "path", status.alias("status"))


_SPLIT = f"""{_LINES}, n AS (SELECT * FROM x WHERE ts >= (SELECT max(ts) FROM x) - INTERVAL 365 DAYS), h AS (SELECT * FROM x WHERE ts < (SELECT max(ts) FROM x) - INTERVAL 365 DAYS),
f AS (SELECT path, email, count(DISTINCT change_id) AS n, bool_or(l_linenumber = 1) AS made FROM h GROUP BY ALL), r AS (SELECT email, count(DISTINCT change_id) AS n FROM h GROUP BY ALL),
experience AS (SELECT change_id, path, max(CASE WHEN bot THEN -1 ELSE coalesce(f.n, 0) END)::BIGINT AS file_commits, max(CASE WHEN bot THEN -1 ELSE coalesce(r.n, 0) END)::BIGINT AS repo_commits, coalesce(bool_or(made AND NOT bot), false) AS created
 FROM (SELECT DISTINCT change_id, path, email, email LIKE '%7' AS bot FROM n) LEFT JOIN f USING (path, email) LEFT JOIN r USING (email) GROUP BY ALL)"""


def _experience(spark, sf):
    fresh, old = _split(spark, sf)
    bot = F.when(F.col("email").endswith("7"), F.concat("email", F.lit(change.BOT))).otherwise(F.col("email"))
    return change.author_experience(fresh, fresh.select("change_id", bot.alias("email")), old)


@query(f"WITH {_SPLIT} SELECT change_id, path, file_commits, repo_commits, created FROM experience")
def author_experience(spark, sf):
    """Customers whose name ends in 7 are robots."""
    return _experience(spark, sf).select("change_id", "path", "file_commits", "repo_commits", "created")


@query("""SELECT 'shop' AS repo, 'c' || o_custkey AS email, count(DISTINCT o_orderkey) AS commits FROM orders GROUP BY ALL""")
def author_totals(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("shop").alias("repo"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("email"), F.col("o_orderkey").alias("hash"))
    return history.author_totals(rows)


_HIST = f"""{_LINES}, fh AS (SELECT path, count(DISTINCT change_id) AS commits, count(*) FILTER (l_returnflag = 'R') AS fixes, count(*) FILTER (l_returnflag = 'A') AS reverts,
 floor(count(*) / 3e0 * 100 + 0.5e0) / 100 AS recent, floor(count(*) FILTER (l_returnflag = 'R') / 7e0 * 100 + 0.5e0) / 100 AS recent_fixes,
 CASE WHEN count(*) % 4 = 0 THEN -1 ELSE min(l_quantity)::INT END AS age_days FROM x GROUP BY path),
up AS (SELECT path, unnest([array_to_string(string_split(path, '/')[1:i], '/') FOR i IN range(1, len(string_split(path, '/')))]) AS dir FROM fh),
dh AS (SELECT dir, sum(commits)::BIGINT AS commits, sum(fixes)::BIGINT AS fixes, sum(reverts)::BIGINT AS reverts, floor(sum(recent) * 100 + 0.5e0) / 100 AS recent, floor(sum(recent_fixes) * 100 + 0.5e0) / 100 AS recent_fixes,
 coalesce(min(age_days) FILTER (age_days >= 0), -1) AS age_days FROM up JOIN fh USING (path) GROUP BY dir),
da AS (SELECT dir, count(DISTINCT email) AS authors FROM up JOIN x USING (path) GROUP BY dir)"""


def _file_history(spark, sf):
    x = _lines(spark, sf)
    fixes = F.count_if(F.col("l_returnflag") == "R")
    age = F.when(F.count("*") % 4 == 0, -1).otherwise(F.min("l_quantity").cast("int"))
    return x.groupBy("repo", "path").agg(F.countDistinct("change_id").alias("commits"), fixes.alias("fixes"), F.count_if(F.col("l_returnflag") == "A").alias("reverts"), (F.count("*") / 3.0).alias("recent"), round_half_away(fixes / 7.0, 2).alias("recent_fixes"), age.alias("age_days"), F.countDistinct("email").alias("authors"))


def _dir_history(spark, sf):
    return change.directory_history(_file_history(spark, sf), _lines(spark, sf).select("repo", "path", "email"))


@query(f"WITH {_HIST} SELECT dir, commits, fixes, reverts, floor(recent * 100 + 0.5e0) / 100 AS recent, floor(recent_fixes * 100 + 0.5e0) / 100 AS recent_fixes, age_days, authors FROM dh JOIN da USING (dir)")
def directory_history(spark, sf):
    return _dir_history(spark, sf).select("dir", "commits", "fixes", "reverts", round_half_away(F.col("recent"), 2).alias("recent"), round_half_away(F.col("recent_fixes"), 2).alias("recent_fixes"), F.col("age_days").cast("int"), "authors")


@query(f"""WITH {_HIST} SELECT path, floor(greatest(0e0, dh.recent_fixes - fh.recent_fixes) * 100 + 0.5e0) / 100 AS dir_fixes
FROM fh JOIN dh ON dh.dir = regexp_replace(path, '/[^/]*$', '')""")
def fixes_around(spark, sf):
    return change.fixes_around(_file_history(spark, sf), _dir_history(spark, sf)).select("path", round_half_away(F.col("dir_fixes"), 2).alias("dir_fixes"))


_SIDES = """head AS (SELECT l_orderkey AS change_id, 'd' || l_linenumber AS name, max(l_quantity)::INT AS cyclo, max(l_partkey % 6)::INT AS nest, l_linenumber AS ord FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey, l_linenumber),
base AS (SELECT l_orderkey AS change_id, 'd' || l_linenumber AS name, max(l_suppkey % 40)::INT AS cyclo, l_linenumber AS ord FROM lineitem WHERE l_returnflag <> 'A' GROUP BY l_orderkey, l_linenumber)"""


@query(f"""WITH {_SIDES}, b AS (SELECT coalesce(h.change_id, b.change_id) AS change_id, coalesce(h.name, b.name) AS name, h.cyclo AS c, h.nest, h.ord, coalesce(b.cyclo, 0) AS was
 FROM head h FULL JOIN base b ON h.change_id = b.change_id AND h.name = b.name)
SELECT change_id, coalesce(arg_max(c, c * 100 - ord), 0) AS cyclo, coalesce(arg_max(was, CASE WHEN c IS NOT NULL THEN c * 100 - ord END), 0) AS cyclo_base, coalesce(max(nest), 0) AS nest, greatest(0, coalesce(max(c - was), 0)) AS delta,
 len(list(DISTINCT name)) AS names FROM b WHERE name <> 'd3' GROUP BY change_id""")
def complexity_full_outer(spark, sf):
    """Lines as declarations, complexity as quantity at the head and as supplier before; third lines aren't touched."""
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("name"), "l_quantity", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_linenumber").alias("ord"))
    by = ["change_id", "name", "ord"]
    head = x.filter("l_returnflag <> 'R'").groupBy(*by).agg(F.max("l_quantity").cast("int").alias("cyclo"), F.max(F.col("l_partkey") % 6).cast("int").alias("nest"))
    base = x.filter("l_returnflag <> 'A'").groupBy(*by).agg(F.max(F.col("l_suppkey") % 40).cast("int").alias("cyclo"), F.lit(0).alias("nest"))
    made = change.complexity(x.filter("name <> 'd3'").select("change_id", "name"), head, base, ["change_id"])
    return made.select("change_id", "cyclo", "cyclo_base", "nest", "delta", F.size("names").cast("bigint").alias("names"))


@query(f"WITH {_LINES} SELECT change_id, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs FROM x GROUP BY change_id")
def change_spread(spark, sf):
    return change.spread(_lines(spark, sf))


_POINTS = ["least(30e0, fixes * 12e0)", "least(20e0, reverts * 15e0)", "least(10e0, greatest(0e0, recent - 3e0))", "least(8e0, greatest(0e0, authors - 2e0) * 2e0)", "least(6e0, dir_fixes * 2e0)", "least(22e0, greatest(0e0, cyclo - 5e0) * 1.25e0)", "least(10e0, greatest(0e0, nest - 3e0) * 4e0)", "least(14e0, delta * 2e0)", "least(6e0, greatest(0e0, changed - 20e0) * 0.05e0)", "CASE WHEN repo_commits >= 0 AND file_commits = 0 THEN 8e0 ELSE 0e0 END", "CASE WHEN repo_commits BETWEEN 0 AND 9 THEN 6e0 ELSE 0e0 END", "least(10e0, n_missing * 5e0)", "CASE WHEN test_gap THEN 6e0 ELSE 0e0 END", "least(6e0, greatest(0e0, dirs - 3e0))", "CASE WHEN fix_pr THEN 4e0 ELSE 0e0 END"]
_NAMES = ["fixes", "reverts", "churn", "authors", "dir_fixes", "cyclo", "nest", "cyclo_delta", "size", "new_to_file", "newcomer", "cochange", "test_gap", "diffusion", "fix_pr"]
_LISTED = ", ".join(f"{{'m': -{p}, 'i': {i}, 'n': '{n}'}}" for i, (p, n) in enumerate(zip(_POINTS, _NAMES, strict=True)))


@query(f"""WITH {_LINES}, d AS (SELECT change_id, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) AS dirs FROM x GROUP BY change_id),
u AS (SELECT change_id, l_linenumber, path, l_linenumber = 7 AS skipped, p_size = 50 AS generated, CASE WHEN l_returnflag = 'R' THEN p_size / 8e0 ELSE 0e0 END AS fixes, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS reverts, l_quantity / 8e0 AS recent,
 p_size % 7 AS authors, p_size / 16e0 AS dir_fixes, l_quantity::INT AS cyclo, p_size % 6 AS nest, p_size % 9 AS delta, l_quantity * 20 AS changed, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size % 3 END AS file_commits, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size % 20 END AS repo_commits,
 p_size % 4 AS n_missing, p_size % 2 = 0 AS test_gap, dirs, o_orderpriority LIKE '1%' AS fix_pr FROM x JOIN d USING (change_id)),
s AS (SELECT *, list_sort([f FOR f IN [{_LISTED}] IF f.m <= -0.5e0]) AS f FROM u),
t AS (SELECT *, CASE WHEN skipped OR generated THEN 0 ELSE least(100, floor(coalesce(list_sum([g.m FOR g IN f]), 0e0) * -1 + 0.5e0))::INT END AS likelihood FROM s)
SELECT change_id, l_linenumber, likelihood, CASE WHEN likelihood >= 75 THEN 'critical' WHEN likelihood >= 55 THEN 'high' WHEN likelihood >= 35 THEN 'medium' ELSE 'low' END AS likelihood_level,
 CASE WHEN skipped OR generated THEN '' ELSE array_to_string([g.n FOR g IN f[1:5]], ',') END AS factors FROM t""")
def change_likelihood(spark, sf):
    """The likelihood that each line of an order goes wrong, and its first five factors."""
    x = _lines(spark, sf)
    size, q = F.col("p_size"), F.col("l_quantity")
    unknown = lambda n: F.when(size % 5 == 0, -1).otherwise(size % n).cast("bigint")
    u = x.join(change.spread(x), "change_id").select(
        "change_id", "l_linenumber", "path", (F.col("l_linenumber") == 7).alias("skipped"), (size == 50).alias("generated"), F.lit("modified").alias("status"),
        F.when(F.col("l_returnflag") == "R", size / 8.0).otherwise(0.0).alias("recent_fixes"), (F.col("l_returnflag") == "A").cast("int").alias("reverts"), (q / 8.0).alias("recent"),
        (size % 7).alias("authors"), (size / 16.0).alias("dir_fixes"), q.cast("int").alias("cyclo"), (size % 6).alias("nest"), (size % 9).alias("delta"), (q * 20).alias("changed"),
        unknown(3).alias("file_commits"), unknown(20).alias("repo_commits"), (size % 4).alias("n_missing"), (size % 2 == 0).alias("test_gap"), "dirs", F.col("o_orderpriority").startswith("1").alias("fix_pr"),
    )
    made = change.change_likelihood(u)
    return made.select("change_id", "l_linenumber", "likelihood", "likelihood_level", F.concat_ws(",", F.transform("factors", lambda f: f["name"])).alias("factors"))


@query("""SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'human/config' WHEN doc_id % 13 = 0 THEN 'human/binary' WHEN source = 'books' THEN 'none/generated' WHEN doc_id % 11 = 0 THEN 'none/generated'
 WHEN list_bool_or([l LIKE '%Code generated%' AND l LIKE '%DO NOT EDIT%' FOR l IN string_split(substr(coalesce(text, ''), 1, 2048), chr(10))]) THEN 'none/generated'
 WHEN doc_id % 10 = 0 THEN 'none/rename' WHEN doc_id % 9 = 0 THEN 'none/format' WHEN lang = 'en' THEN 'skim/docs' END AS decided FROM documents""")
def presort_cascade(spark, sf):
    """Documents as changed files: every rule of the cascade but those of imports decides some of them."""
    i = F.col("doc_id")
    name = F.concat(F.when(F.col("source") == "books", "vendor/").otherwise("src/"), F.when(i % 17 == 0, "migrations/").otherwise(""), i.cast("string"), F.when(F.col("lang") == "en", ".md").otherwise(".c"))
    lines = F.array(F.struct(F.lit("+").alias("op"), F.lit("x").alias("text")))
    rows = table(spark, sf, "documents").select(
        "doc_id", name.alias("file"), F.lit("").alias("symbol"), F.when(i % 10 == 0, "renamed").otherwise("modified").alias("status"), lines.alias("lines"), (i % 13 == 0).alias("binary"), (i % 11 == 0).alias("attribute"),
        F.coalesce("text", F.lit("")).alias("head"), (i % 9 != 0).alias("real"), F.when(i % 10 == 0, 0).otherwise(1).alias("n_hunks"),
    )
    return presort(rows).select("doc_id", F.concat_ws("/", "rule.bucket", "rule.change_kind").alias("d")).select("doc_id", F.nullif("d", F.lit("")).alias("decided"))


@query("""WITH x AS (SELECT doc_id, ['none', 'skim', 'human', 'other'][doc_id % 4 + 1] AS choice, (doc_id % 10) / 10e0 AS p, (doc_id % 6) / 10e0 AS b, doc_id % 19 = 0 AS cut, CASE WHEN doc_id % 3 = 0 THEN 'skim' END AS second FROM documents),
y AS (SELECT *, CASE WHEN choice = 'other' THEN 'invalid answer' WHEN (CASE WHEN p = 0 THEN 0.3e0 ELSE p END) < CASE choice WHEN 'none' THEN 0.8e0 WHEN 'skim' THEN 0.6e0 ELSE 0e0 END THEN 'not sure enough' WHEN choice = 'none' AND b > 1 - 0.8e0 THEN 'behavior may change' WHEN cut AND choice <> 'human' THEN 'text was cut' END AS why FROM x)
SELECT doc_id, CASE WHEN why IS NULL THEN choice ELSE coalesce(second, 'human') END AS bucket, CASE WHEN why IS NULL THEN 'first' WHEN second IS NOT NULL THEN 'second' ELSE 'none' END AS source, why AS deferred FROM y""")
def two_model_cascade(spark, sf):
    i = F.col("doc_id")
    choice = F.element_at(F.array(*map(F.lit, ["none", "skim", "human", "other"])), (i % 4 + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", choice.alias("choice"), F.create_map(choice, (i % 10) / 10.0).alias("probabilities"), F.lit(0.3).alias("first_confidence"), ((i % 6) / 10.0).alias("changes_behavior"), (i % 19 == 0).alias("cut_off"), F.when(i % 3 == 0, "skim").alias("second_bucket"), F.lit(0.5).alias("second_confidence"))
    return decisions.two_models(rows, {"none": 0.8, "skim": 0.6}).select("doc_id", "bucket", "source", "deferred")


@query("""WITH x AS (SELECT l_orderkey, l_partkey % 50 AS symbol, (l_linenumber % 2 = 0) AS modified FROM lineitem), b AS (SELECT DISTINCT o_orderkey, o_custkey % 50 AS name FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey, symbol::VARCHAR AS symbol, modified, CASE WHEN modified AND k.o_orderkey IS NOT NULL THEN b.name IS NULL END AS is_new FROM x LEFT JOIN (SELECT DISTINCT o_orderkey FROM b) k ON k.o_orderkey = l_orderkey LEFT JOIN b ON b.o_orderkey = l_orderkey AND b.name = symbol""")
def new_symbols(spark, sf):
    """Whether a line's symbol is missing from what is known of its order; orders in process aren't known."""
    repo = F.lit("shop").alias("repo")
    units = table(spark, sf, "lineitem").select(repo, F.col("l_orderkey").cast("string").alias("file"), (F.col("l_partkey") % 50).cast("string").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, "modified").otherwise("added").alias("status"), "l_orderkey")
    base = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(repo, F.col("o_orderkey").cast("string").alias("file"), (F.col("o_custkey") % 50).cast("string").alias("name"))
    return members.new_symbols(units, base, ["repo"]).select("l_orderkey", "symbol", (F.col("status") == "modified").alias("modified"), "is_new")


@query("""WITH d AS (SELECT l_orderkey, l_suppkey % 3 AS name, arg_max(l_partkey, l_linenumber * 100000000 + l_partkey) AS key FROM lineitem GROUP BY ALL)
SELECT o_orderkey, o_custkey % 3 AS name, key FROM orders LEFT JOIN d ON l_orderkey = o_orderkey AND name = o_custkey % 3""")
def last_declared(spark, sf):
    declared = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 3).alias("name"), F.col("l_partkey").alias("key"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    tokens = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("name"))
    return members.last_declared(tokens, declared, ["o_orderkey"])


@query("""WITH x AS (SELECT l_orderkey AS change_id, l_partkey % 20 AS spot, l_returnflag = 'R' AS deleted FROM lineitem), n AS (SELECT o_orderkey AS change_id, unnest(range(0, 25)) AS n FROM orders)
SELECT DISTINCT n.change_id, n.n FROM n JOIN x USING (change_id) WHERE CASE WHEN deleted THEN CASE WHEN n >= spot THEN n - spot + 1 ELSE spot - n END ELSE abs(n - spot) END <= 3""")
def commentable_lines(spark, sf):
    changes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("change_id"), (F.col("l_partkey") % 20).alias("at"), (F.col("l_returnflag") == "R").alias("deleted"))
    lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("change_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(24).cast("bigint"))).alias("n"))
    return reports.commentable(lines, changes, ["change_id"])


@query("""WITH f AS (SELECT l_orderkey AS change_id, l_linenumber AS path, 1 AS n FROM lineitem), w AS (SELECT l_orderkey AS change_id, l_linenumber AS path FROM lineitem WHERE l_quantity > 10)
SELECT f.change_id, f.path, (f.change_id, f.path) IN (SELECT (change_id, path) FROM w) AS real FROM f""")
def real_changes(spark, sf):
    """Lines of more than ten pieces also differ without white space."""
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("change_id"), F.col("l_linenumber").alias("path"), "l_quantity")
    without = x.withColumn("n_hunks", (F.col("l_quantity") > 10).cast("int"))
    return trees.real_changes(x.select("change_id", "path"), without)


@query("""SELECT page_id, path, CASE WHEN regexp_matches(path, '_test\\.go$') THEN regexp_replace(path, '_test\\.go$', '.go') WHEN regexp_matches(path, '\\.(test|spec)\\.[jt]sx?$') THEN regexp_replace(path, '\\.(?:test|spec)(\\.[jt]sx?)$', '\\1') ELSE '' END AS subject,
 regexp_matches(path, '(^|/)mocks?/') OR path LIKE '%.gen.%' OR path LIKE '%\\_gen.go' ESCAPE '\\' AS follows FROM (SELECT page_id, 'pkg/' || ['mock/', 'a/', 'gen/'][page_id % 3 + 1] || 'f' || page_id || ['_test.go', '.spec.tsx', '.go', '_gen.go', '.gen.ts'][page_id % 5 + 1] AS path FROM pages)""")
def test_subjects(spark, sf):
    i = F.col("page_id")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (i % n + 1).cast("int"))
    path = F.concat(F.lit("pkg/"), pick(["mock/", "a/", "gen/"], 3), F.lit("f"), i.cast("string"), pick(["_test.go", ".spec.tsx", ".go", "_gen.go", ".gen.ts"], 5))
    x = table(spark, sf, "pages").select("page_id", path.alias("path"))
    return x.select("page_id", "path", patterns.test_subject(F.col("path")).alias("subject"), patterns.follows_source(F.col("path"), F.lit(False)).alias("follows"))
