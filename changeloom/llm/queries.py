"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from changeloom.llm import bpe, decontaminate, exact_dedup, line_dedup, minhash, mixing_lm, page_text, quality, simhash, source_audit, substring_dedup, toxicity, vector_codes
from changeloom.llm.common import table

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = r"[\x20\x09-\x0D]"


def op1_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_mixing_lm(spark, sf_dir):
    return mixing_lm.report(table(spark, sf_dir, "documents"))


def op8_page_text(spark, sf_dir):
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op11_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_source_audit(spark, sf_dir):
    return source_audit.audit(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (pipeline, op1_decontaminate, op2_simhash, op3_quality, op4_toxicity, op5_bpe, op6_exact_dedup, op7_mixing_lm, op8_page_text, op9_line_dedup, op10_substring_dedup, op11_minhash, op12_vector_codes, op13_source_audit)}


def _codes_sql(rounds: int = 6) -> str:
    """Six rounds of assigning and averaging, each a pair of steps of its own."""
    out = ["""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
x AS MATERIALIZED (SELECT r, p, e[p * len(e) // 8 + 1:(p + 1) * len(e) // 8] AS s FROM v, unnest(range(8)) AS t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, s AS c FROM x WHERE r <= 16)"""]
    for i in range(rounds + 1):
        out.append(f"""a{i} AS MATERIALIZED (SELECT r, x.p, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(s, c)])::BIGINT, k := k)) AS m
        FROM x JOIN b{i} b USING (p) GROUP BY r, x.p)""")
        if i < rounds:
            out.append(f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN
        (SELECT p, k, list(t ORDER BY j) AS c FROM (SELECT a.p, m.k AS k, j, (sum(s[j]) - ((sum(s[j]) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS t
         FROM a{i} a JOIN x ON x.r = a.r AND x.p = a.p, unnest(range(1, len(s) + 1)) AS u(j) GROUP BY ALL) GROUP BY p, k) n ON n.p = b.p AND n.k = b.k)""")
    return ",\n".join(out) + f""",
q AS (SELECT r, string_agg(printf('%02x', m.k), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN q USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)""",
        "op9_line_dedup": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, i, l[i] AS line, {_LOWER.format(f"regexp_replace(l[i], '^{_WHITE}+|{_WHITE}+$', '', 'g')")} AS k FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
f AS (SELECT k FROM x WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(f.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM x LEFT JOIN f ON x.k = f.k GROUP BY doc_id""",
        "op10_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
m AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, p FROM win JOIN m USING (s), unnest(range(i, i + 13)) AS t(p) WHERE doc_id > least),
x AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
k AS (SELECT x.doc_id, count(gone.p) AS n, string_agg(word, ' ' ORDER BY x.p) FILTER (gone.p IS NULL) AS kept
      FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
        "op11_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS s FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id, n""",
        "op12_vector_codes": _codes_sql(),
        "op13_source_audit": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
x AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM x GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN l USING (lang)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p,
             1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, 'pair' AS part, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term)
             WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      UNION ALL SELECT lang, source, term, 'term', p - q FROM p WHERE n > 0 AND p > q),
o AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM f)
SELECT * FROM o WHERE part = 'pair' OR rank <= 50""",
    }
