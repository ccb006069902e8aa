"""The map of a code base: records of symbols, files, directories and repositories from graph, history, rules, contracts and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeloom.functions.scalars import ancestors, blend, dirname, level, round_half_away
from changeloom.operators import contracts, decisions, graph, hierarchy, history
from changeloom.operators.joins import match_rules
from changeloom.operators.windows import percentile_below
from changeloom.session import cut
from changeloom.sources.trees import path_rules

#: The score of what no tag speaks of; hops and loss a hop of tags of sinks; callers that are named.
DEFAULT, HOPS, DECAY, NAMED = 10, 3, 0.1, 5

_OPTIONAL = {"kind": "string", "exported": "boolean", "internal": "boolean", "tags": "array<string>", "category": "string"}


def ranks(nodes: DataFrame, edges: DataFrame, key: str, fixed: int | None = None) -> DataFrame:
    """(key, pr, rank): PageRank times the number of nodes, and the percentile below.

    nodes(key, share?, counted?): virtual nodes have a share of the teleport; only counted nodes are the population.
    """
    column = lambda name, default: F.col(name) if name in nodes.columns else F.lit(default)
    ids = nodes.groupBy(F.col(key).alias("id")).agg(F.max(column("share", None).cast("double")).alias("share"), F.bool_or(column("counted", True)).alias("counted"))
    pr = graph.pagerank(ids.select("id", "share"), edges, fixed=fixed)
    scaled = pr.join(ids.select("id", "counted"), "id").crossJoin(F.broadcast(pr.agg(F.count("*").alias("_n"))))
    ranked = percentile_below(scaled.select("id", "counted", (F.col("pr") * F.col("_n")).alias("pr")), "pr", "rank", include=F.col("counted"))
    return ranked.filter("counted").select(F.col("id").alias(key), "pr", "rank")


def rule_tags(subjects: DataFrame, rules: list[dict], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tags(key, tag, score), limits(key, cap, floor)) of subjects by rules; a rule that only caps is no tag."""
    met = match_rules(subjects, rules)
    tags = met.filter((F.col("rule_score") > 0) | F.col("rule_cap").isNull()).select(*key, F.col("rule_id").alias("tag"), F.col("rule_score").alias("score"))
    return tags, met.groupBy(*key).agg(F.min("rule_cap").alias("cap"), F.max("rule_floor").alias("floor"))


def node_tags(nodes: DataFrame, ruled: DataFrame, edges: DataFrame, outside: DataFrame, sinks: list[dict], hops: int = HOPS, decay: float = DECAY) -> DataFrame:
    """(node, tag, score), the highest of each tag: by rules, by calls of sinks (direct, or so many hops away), and what
    implements an operation by the operation's tags. ruled(node, tag, score); edges(src, dst, kind); outside: edges to other code."""
    every = ruled
    if sinks:
        calls = edges.select("src", "dst").unionByName(outside.select("src", "dst"))
        hits = contracts.sink_hits(nodes.select("key", "kind", "category"), calls, sinks)
        carried = graph.propagate(hits, edges.select("src", "dst"), hops, decay, nodes.filter("internal").select(F.col("key").alias("node")))
        every = every.unionByName(carried.select("node", "tag", "score"))
    best = lambda df: df.groupBy("node", "tag").agg(F.max("score").alias("score"))
    own = cut(best(every))
    serves = contracts.serve_tags(own, nodes.filter("kind = 'api-op'").select(F.col("key").alias("node")), edges)
    return cut(best(own.unionByName(serves)))


def callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, callers, caller_files, caller_repos, virtual_caller): who calls a node, seen through internal nodes; files are those
    other than its own. A consumer outside the code is no caller, but is said."""
    pairs = graph.direct_callers(edges, nodes.filter("internal").select(F.col("key").alias("node")))
    at = lambda key, end: nodes.select(F.col("key").alias(key), F.col("repo").alias(f"{end}_repo"), F.concat_ws("/", "repo", "file").alias(f"{end}_file"))
    met = pairs.join(at("node", "own"), "node").join(at("caller", "by"), "caller", "left")
    other = F.when(F.col("by_file") != F.col("own_file"), F.col("by_file"))
    return met.groupBy("node").agg(
        F.countDistinct(F.when(F.col("by_repo").isNotNull(), F.col("caller"))).alias("callers"),
        F.countDistinct(other).alias("caller_files"),
        F.countDistinct(F.when(F.col("by_repo") != F.col("own_repo"), F.col("by_repo"))).alias("caller_repos"),
        F.bool_or(F.col("caller").startswith("virtual:")).alias("virtual_caller"),
    )


def top_callers(nodes: DataFrame, edges: DataFrame, pr: DataFrame, most: int = NAMED) -> DataFrame:
    """(node, top_callers): ids of the callers of the highest pr(key, pr), seen through internal nodes; of equal ones by id."""
    pairs = graph.direct_callers(edges, nodes.filter("internal").select(F.col("key").alias("node")))
    named = nodes.select(F.col("key").alias("caller"), symbol_id().alias("id")).join(pr.select(F.col("key").alias("caller"), "pr"), "caller")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("pr"), "id"))
    first = pairs.join(named, "caller").withColumn("place", place).filter(F.col("place") <= most)
    lists = first.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("_l"))
    return lists.select("node", F.col("_l.id").alias("top_callers"))


def symbol_id() -> Column:
    return F.concat("repo", F.lit("/"), "file", F.lit(":"), "sym")


def place_likelihood() -> Column:
    """The likelihood of a place by its history and complexity."""
    measures = {"fixes": F.col("recent_fixes"), "reverts": F.col("reverts"), "churn": F.col("recent"), "authors": F.col("authors"), "cyclo": F.col("cyclo"), "nest": F.col("nest")}
    return decisions.likelihood(measures, decisions.PLACE_POINTS, F.coalesce("generated", F.lit(False)))


def build_map(
    nodes: DataFrame, edges: DataFrame, commits: DataFrame, rules: list[dict], ref: Column | None = None, *, files: DataFrame | None = None,
    joined: DataFrame | None = None, sinks: list[dict] | None = None, consumers: list[dict] | None = None, emission: dict | None = None, fixed: int | None = None,
) -> DataFrame:
    """Records of all levels of nodes(key, repo, file, sym, start, end, cyclo, nest) and edges(src, dst, n, kind?).

    nodes may also have kind, exported, internal, tags and category (of the repository). files(repo, path, generated): all files,
    those without nodes too; else the nodes' files. joined(src, dst): edges by contract (``operators.contracts``). consumers:
    outside the code, see ``virtual_consumers``. emission: options of ``hierarchy.emitted``; without it each symbol that
    isn't internal has a record. fixed: so many rounds of PageRank instead of until it is still.

    Files, directories and repositories have the rank of their own collapsed graphs. A file has the tags and floors of all its
    symbols, but not their caps; without nodes it has the rank of the nearest ranked directory. A directory's rollback is the higher of
    its own rules' score and the 75th percentile of its files', its likelihood is that percentile; outside the graph it has its
    children's rank. Generated files and symbols have the likelihood 0. Symbols name their callers of the highest rank, files their
    usual partners in changes of the history's days, but for generated ones.
    """
    every = nodes.select("key", "repo", "file", "sym", "start", "end", "cyclo", "nest", *[(F.col(c) if c in nodes.columns else F.lit(None)).cast(t).alias(c) for c, t in _OPTIONAL.items()])
    every = cut(every.withColumns({"kind": F.coalesce("kind", F.lit("")), "exported": F.coalesce("exported", F.lit(False)), "internal": F.coalesce("internal", F.lit(False)), "tags": F.coalesce("tags", F.array().cast("array<string>"))}))
    plain = edges if "kind" in edges.columns else edges.withColumn("kind", F.lit(""))
    known, outside = graph.resolve_edges(plain.select("src", "dst", "n", "kind"), every)
    if joined is not None:
        known = known.unionByName(joined.select("src", "dst", F.lit(1).alias("n"), F.lit("contract").alias("kind")))
    real = every.select("key", "repo", "file", F.lit(None).cast("double").alias("share"), (~F.col("internal")).alias("counted"))
    if consumers:
        operations = every.filter("kind = 'api-op'").select("key", F.concat_ws("/", "repo", "file").alias("path"))
        ends, asked = contracts.virtual_consumers(operations, consumers)
        known = known.unionByName(asked.select("src", "dst", "n", "kind"))
        real = real.unionByName(ends.select("key", F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("file"), "share", F.lit(False).alias("counted")))
    known = cut(known.filter("src <> dst"))
    weighed = graph.weigh(known)

    def grouped(group: Column) -> DataFrame:
        """(id, pr, rank) of groups of nodes; a consumer is a group of its own."""
        of = real.select("key", F.when(F.col("repo").isNull(), F.col("key")).otherwise(group).alias("grp"), "share", F.col("repo").isNotNull().alias("counted"))
        return ranks(of.select(F.col("grp").alias("id"), "share", "counted"), graph.collapse(weighed, of.select(F.col("key").alias("node"), "grp")), "id", fixed)

    # tags of nodes
    ruled, limits = rule_tags(every.withColumn("path", F.col("file")).withColumn("node", F.col("key")), rules, ["node"])
    tags = node_tags(every, ruled, known, outside, sinks or [])
    scores = hierarchy.rollback_score(tags, ["node"], DEFAULT).join(tags.groupBy("node").agg(F.max("score").alias("top_score")), "node")

    # history of files
    now = F.current_timestamp() if ref is None else ref
    changed = history.changes(commits)
    seen = history.file_history(changed, now)

    # symbols
    own = every.filter("NOT internal AND file <> ''").withColumns({"node": F.col("key"), "path": F.col("file"), "generated": F.array_contains("tags", "generated")})
    met = own.join(scores, "node", "left").join(limits, "node", "left").join(callers(every, known.select("src", "dst")), "node", "left")
    met = hierarchy.emitted(met, **emission) if emission is not None else met
    symbol_ranks = cut(ranks(real, weighed, "key", fixed))
    symbols = met.join(symbol_ranks, "key").join(top_callers(every, known.select("src", "dst"), symbol_ranks), "node", "left").join(seen, ["repo", "path"], "left").withColumns({"rollback": F.coalesce("rollback", F.lit(DEFAULT)), "likelihood": place_likelihood()})
    symbols = symbols.withColumn("impact", blend(F.col("rank"), F.col("rollback"), F.col("floor"), F.col("cap"))).withColumn("rank", round_half_away(F.col("rank"), 1))

    # files
    categories = every.groupBy("repo").agg(F.max("category").alias("category"))
    listed = own.select("repo", "path").distinct().withColumn("listed", F.lit(False)) if files is None else files.select("repo", "path", F.coalesce("generated", F.lit(False)).alias("listed"))
    subjects = listed.join(categories, "repo", "left")
    of_path, path_limits = rule_tags(subjects, path_rules(rules), ["repo", "path"])
    of_symbols = hierarchy.file_tags(tags.select(F.col("node").alias("key"), "tag", "score", F.lit(0).alias("floor")), every).select("repo", F.col("file").alias("path"), "tag", "score")
    file_tags = of_symbols.unionByName(of_path).groupBy("repo", "path", "tag").agg(F.max("score").alias("score"))
    floors = limits.join(own.select("node", "repo", "path"), "node").groupBy("repo", "path").agg(F.max("floor").alias("_floor"))
    measured = own.groupBy("repo", "path").agg(F.max("cyclo").alias("cyclo"), F.max("nest").alias("nest"), F.count("*").alias("symbols"))
    made = met.filter("generated").select("repo", "path").distinct().withColumn("_made", F.lit(True))
    base = subjects
    for side in (hierarchy.rollback_score(file_tags, ["repo", "path"], DEFAULT), path_limits, floors, measured, seen, made):
        base = base.join(side, ["repo", "path"], "left")
    base = base.withColumns({"generated": F.col("listed") | F.coalesce("_made", F.lit(False)), "rollback": F.coalesce("rollback", F.lit(DEFAULT)), "floor": F.greatest(F.coalesce("floor", F.lit(0)), F.coalesce("_floor", F.lit(0))), "symbols": F.coalesce("symbols", F.lit(0))})
    base = cut(base.withColumn("likelihood", place_likelihood()).withColumn("id", F.concat_ws("/", "repo", "path")))

    # directories
    p75 = lambda c: hierarchy.nearest_rank(c, 0.75).cast("int").alias(c)
    below = [p75("rollback"), p75("likelihood"), F.sum("symbols").alias("symbols")]
    rolled = hierarchy.rollup_paths(base, "path", below, ["repo"])
    dir_tags, dir_limits = rule_tags(rolled.join(categories, "repo", "left").select("repo", "dir", "category", F.concat("dir", F.lit("/")).alias("path")), path_rules(rules), ["repo", "dir"])
    dir_scores = hierarchy.rollback_score(dir_tags, ["repo", "dir"], DEFAULT).withColumnRenamed("rollback", "_own")
    dirs = rolled.join(dir_scores, ["repo", "dir"], "left").join(dir_limits, ["repo", "dir"], "left").withColumn("rollback", F.greatest("rollback", F.coalesce("_own", F.lit(DEFAULT))))
    dir_ranks = cut(grouped(F.concat(F.concat_ws("/", "repo", dirname(F.col("file"))), F.lit("/"))))
    dirs = dirs.withColumns({"id": F.concat(F.col("repo"), F.lit("/"), F.col("dir"), F.lit("/")), "path": F.concat_ws("/", "repo", "dir")}).join(dir_ranks, "id", "left").withColumn("rank", round_half_away(F.col("rank"), 1))
    dirs = hierarchy.rank_from_children(dirs.select("id", "repo", "dir", "path", "rollback", "likelihood", "symbols", "cap", "floor", "pr", "rank"), "path")
    dirs = cut(dirs.withColumn("impact", blend(F.coalesce("rank", F.lit(0.0)), F.col("rollback"), F.col("floor"), F.col("cap"))))

    # ranks of files: the graph's, else the nearest directory's
    ranked = base.join(grouped(F.concat_ws("/", "repo", "file")), "id", "left").withColumn("rank", round_half_away(F.col("rank"), 1))
    roots = dir_ranks.filter(F.col("id").endswith("//")).select(F.regexp_replace("id", "//$", "").alias("path"), round_half_away(F.col("rank"), 1).alias("rank"))
    bare = ranked.filter("rank IS NULL").drop("rank")
    inherited = hierarchy.inherit_nearest(bare, dirs.select("path", "rank").unionByName(roots), "id", "path", "rank").withColumn("rank_source", F.concat("rank_source", F.lit("/")))
    whole = ranked.filter("rank IS NOT NULL").withColumn("rank_source", F.lit("graph")).unionByName(inherited, allowMissingColumns=True)
    whole = whole.withColumn("rank", F.coalesce("rank", F.lit(0.0))).withColumn("impact", blend(F.col("rank"), F.col("rollback"), F.col("floor"), F.col("cap")))

    # repositories
    repos = base.groupBy("repo").agg(*below).withColumns({"id": F.col("repo"), "rollback": F.greatest("rollback", F.lit(DEFAULT))}).join(grouped(F.col("repo")), "id", "left")
    repos = repos.withColumn("rank", round_half_away(F.coalesce("rank", F.lit(0.0)), 1)).withColumn("impact", blend(F.col("rank"), F.col("rollback")))

    listed_tags = lambda df, by: hierarchy.sorted_tags(df, by).withColumnRenamed("tags", "rollback_tags")
    symbols = symbols.join(listed_tags(tags, ["node"]), "node", "left").withColumns({"id": symbol_id(), "lines": F.array("start", "end"), "rank_source": F.lit("graph"), "callers": F.coalesce("callers", F.lit(0))})
    whole = whole.join(listed_tags(file_tags, ["repo", "path"]), ["repo", "path"], "left")
    paired = history.file_partners(changed.filter(history.in_window(F.col("ts"), now)), base.filter("generated").select("repo", "path"))
    lists = paired.groupBy("repo", F.col("item").alias("path")).agg(F.array_sort(F.collect_list(F.struct("rk", F.col("partner").alias("path"), "n", "conf"))).alias("_l"))
    whole = whole.join(lists, ["repo", "path"], "left").withColumn("cochange", F.transform("_l", lambda x: F.struct(x["path"], x["n"], x["conf"])))
    dirs = dirs.drop("path").withColumnRenamed("dir", "path").join(listed_tags(dir_tags, ["repo", "dir"]).withColumnRenamed("dir", "path"), ["repo", "path"], "left")
    columns = {
        "id": "string", "level": "string", "repo": "string", "path": "string", "sym": "string", "kind": "string", "lines": "array<int>", "impact": "int", "likelihood": "int", "rank": "double", "pr": "double", "rank_source": "string",
        "rollback": "int", "rollback_tags": "array<struct<tag: string, score: int>>", "callers": "bigint", "caller_files": "bigint", "top_callers": "array<string>",
        "cochange": "array<struct<path: string, n: bigint, conf: double>>", "symbols": "bigint", "impact_cap": "int", "generated": "boolean",
    }

    def records(df: DataFrame, name: str, **given: Column) -> DataFrame:
        given = {"level": F.lit(name), **given}
        if "cap" in df.columns:
            given["impact_cap"] = F.col("cap")
        return df.select(*[given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    nothing = F.lit(None)
    parts = [
        records(symbols, "symbol", symbols=nothing),
        records(whole, "file"),
        records(dirs, "dir"),
        records(repos, "repo", path=F.lit(""), rank_source=F.when(F.col("pr").isNotNull(), "graph")),
    ]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("impact_level", level(F.col("impact"))).withColumn("likelihood_level", F.when(F.col("likelihood").isNotNull(), level(F.col("likelihood"))))


def top_records(records: DataFrame, measure: str, n: int, at: str | None = None, repo: str | None = None) -> DataFrame:
    """The first n records of a level and repository by a measure, then by rank and id."""
    if at:
        records = records.filter(F.col("level") == at)
    if repo:
        records = records.filter(F.col("repo") == repo)
    return records.orderBy(F.desc(measure), F.desc("rank"), "id").limit(n)


def ancestors_of(records: DataFrame) -> DataFrame:
    """(id, ancestor) of files, for joins of a file with what holds it."""
    files = records.filter("level = 'file'")
    return files.select("id", F.explode(ancestors(F.col("path"))).alias("_d"), "repo").select("id", F.concat(F.col("repo"), F.lit("/"), F.col("_d"), F.lit("/")).alias("ancestor"))
