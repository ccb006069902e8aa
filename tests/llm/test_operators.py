"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeats."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from changeloom.llm import bpe, components, decontaminate, exact_dedup, line_dedup, mixing_lm, page_text, perfect_hash, quality, simhash, substring_dedup, toxicity
from changeloom.llm.queries import oracle_sql

SCHEMA = "doc_id bigint, text string, n_words string, score string, TEXT2 string, fingerprint int"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def texts(n=60, seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["Été", "ÉTÉ", "x,y", "a"]
    line = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    common, passage = line(4), line(20)
    out = []
    for i in range(n):
        t = "\n".join(line(r.randrange(1, 25)) for _ in range(r.randrange(1, 5)))
        if i % 3 == 0:
            t += "\n  " + (common.upper() if i % 2 else common) + "\t"
        if i % 5 == 0:
            t = passage + " " + t
        if i % 7 == 6:
            t = out[-1][1]
        out.append((i, t))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (n + 4, "Two words"), (n + 5, passage + " " + "long " * 30_000), (n + 6, "W1 w2 w3\u0085w4 " * 8)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and rows that repeat an id, alike or not."""
    return frame(spark, [*texts(25), (None, None), (None, "a b c"), (3, texts(25)[3][1]), (4, "other text " * 20), (None, texts(25)[5][1])])


def by_sql(spark, docs, name, **tables):
    con = duckdb.connect()
    for k, v in {"documents": docs, **tables}.items():
        pdf = v.toPandas()
        con.register(k + "_", pdf)
        con.sql(f"create view {k} as select * from {k}_")
    return sorted(con.sql(oracle_sql()[name]).fetchall(), key=str)


def same(df, rows, columns):
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == rows


ITEMS = [(1, texts()[5][1]), (1, texts()[5][1]), (2, "w1"), (3, None), (4, "---"), (11, "W1 w2 w3\u0085w4 W1"), (12, " ".join(texts()[10][1].split()[:14]))]


def test_decontaminate(spark, docs, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = by_sql(spark, docs, "op1_decontaminate", benchmark=items)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)
    same(decontaminate.report(docs, items), want, columns)
    same(decontaminate.report(docs, items, limit=12), want, columns)
    assert decontaminate.report(odd, items).count() == odd.count()
    assert decontaminate.report(odd, items.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.report(docs.limit(0), items).count() == 0


def test_decontaminate_spans(spark):
    docs = spark.createDataFrame([(1, "É!! The  CAT-sat; on")], "doc_id bigint, text string")
    row = decontaminate.decontaminate(docs, spark.createDataFrame([(7, "cat sat")], "item_id bigint, text string")).first()
    assert [(s["start"], s["end"]) for s in row["spans"]] == [(9, 16)] and row["item_ids"] == ["7"]
    letters = "a b c d e f g h i j k l m"
    docs = spark.createDataFrame([(1, letters, 5, 6)], "doc_id bigint, text string, _before int, N_WORDS int")
    items = spark.createDataFrame([(1, letters)], "item_id bigint, text string")
    for limit in (100, 1):
        row = decontaminate.decontaminate(docs, items, limit=limit).first()
        assert [(s["start"], s["end"]) for s in row["spans"]] == [(0, 25)] and row["_before"] == 5 and row["n_words"] == 13 and row["N_WORDS"] == 6


def test_sample_is_bounded(spark):
    from changeloom.llm.labelled import sample

    docs = spark.range(3000).selectExpr("id % 30 AS doc_id", "cast(id AS string) AS text")
    labels = spark.range(30).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic")
    rows, (none, some) = sample(docs, labels, "toxic", 5)
    assert rows.count() == 10 and rows.select("doc_id").distinct().count() == 10 and none + some > 20
    assert toxicity.train(docs, labels, most_grams=30).base < 9


def test_exact_dedup(spark, docs, odd):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    same(exact_dedup.exact_dedup(docs), by_sql(spark, docs, "op6_exact_dedup"), columns)
    assert exact_dedup.exact_dedup(odd).count() == odd.count()
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_digest_index_appends_only_what_is_new(spark):
    index = exact_dedup.DigestIndex(spark, "test_index", 4)
    first = frame(spark, [(1, "A"), (2, "a"), (3, "b")])
    index.append(first, "one")
    index.append(frame(spark, [(9, "B"), (10, "c")]), "two")
    index.append(frame(spark, [(9, "B"), (10, "c")]), "two")
    assert sorted(bytes(r["digest"]) for r in spark.table("test_index").collect()) == sorted(hashlib.sha256(x.encode()).digest() for x in "abc")
    assert [(r["keep_id"], r["group_size"]) for r in spark.table("test_index_changes").collect()] == [(9, 1)]
    index = exact_dedup.DigestIndex(spark, "test_index", 4)  # another run finds the index of this one
    assert index.rows().count() == 3
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.decide(frame(spark, [(9, "B"), (10, "c"), (2, "a"), (3, "b")])).collect()}
    assert got == {9: (9, 2, True), 10: (10, 1, True), 2: (2, 2, True), 3: (9, 2, False)}
    assert "Exchange" not in index.rows()._jdf.queryExecution().executedPlan().toString()
    plan = frame(spark, [(1, "A")]).sparkSession.table("test_index")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "bucket" in plan.lower()
    index.append(frame(spark, [(20, "D"), (21, "d"), (5, "A")]), "three")
    assert spark.table("test_index").groupBy("digest").count().filter("count > 1").isEmpty()
    assert {(r["keep_id"], r["group_size"]) for r in index.rows().collect()} == {(5, 3), (9, 2), (10, 1), (21, 2)}
    spark.sql("DROP TABLE test_index_changes")  # as if lost before anything was written: a batch that is run again adds what is missing
    again = exact_dedup.DigestIndex(spark, "test_index", 4)
    again.append(frame(spark, [(20, "D"), (21, "d"), (5, "A")]), "three")
    assert [(r["keep_id"], r["group_size"]) for r in spark.table("test_index_changes").collect()] == [(5, 1)] and spark.table("test_index").count() == 4
    again.drop()


def test_line_dedup(spark, docs, odd):
    columns = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = by_sql(spark, docs, "op9_line_dedup")
    assert any(r[2] for r in want)
    same(line_dedup.report(docs), want, columns)
    several = line_dedup.line_dedup(docs, block_bytes=1)
    assert sorted((r["doc_id"], r["text"]) for r in several.collect()) == sorted((r["doc_id"], r["text"]) for r in line_dedup.line_dedup(docs).collect())
    assert line_dedup.report(odd).count() == odd.count() and line_dedup.report(docs.limit(0)).count() == 0


def test_perfect_hash():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 1 << 63, (2, 20_000)).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, (2, 20_000)).astype(np.uint64)
    b[:50] = 7
    a[:50] = np.arange(50, dtype=np.uint64)
    counts = np.arange(1, 20_001)
    top = 3
    number = (a >> np.uint64(61)).astype(int)
    built = [perfect_hash.build(k, a[number == k], b[number == k], counts[number == k]) for k in range(8)]
    index = perfect_hash.Index(built, top)
    assert (np.sort(index.place(a, b)) == np.arange(20_000)).all()
    assert (index.count(a, b) == counts).all()
    assert not index.count(a ^ np.uint64(1 << 20), b + np.uint64(1)).any()
    assert not perfect_hash.Index([], 0).count(a, b).any()


def test_substring_dedup(spark, docs, odd):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = by_sql(spark, docs, "op10_substring_dedup")
    assert any(r[2] for r in want)
    same(substring_dedup.report(docs), want, columns)
    small = substring_dedup.substring_dedup(docs, group=50)
    assert sorted(r["n_removed"] for r in small.collect()) == sorted(r[2] for r in want)
    assert substring_dedup.report(docs.limit(0)).count() == 0
    window, least = substring_dedup.WINDOW, {}
    rows = [(r["doc_id"], (r["text"] or "").encode().split()) for r in odd.collect()]
    key = lambda i: float("inf") if i is None else i
    for i, w in rows:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, float("inf")), key(i))
    brute = Counter()
    for i, w in rows:
        gone = {p for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < key(i) for p in range(k, k + window)}
        brute[(i, len(w), len(gone))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.report(odd).collect()) == brute


def test_substring_nodes():
    """Nodes at the window's depth against plain counting, where all paths have one hash, and where each has its own."""
    r = np.random.default_rng(1)
    ids = r.integers(0, 2, 400).astype(np.int32)
    first = np.arange(390)
    want = Counter(tuple(ids[i : i + 5]) for i in first)
    for path in (np.zeros(390, np.uint64), substring_dedup._sums(ids.astype(np.uint64), 5)[first]):
        order, begins = substring_dedup.nodes(ids, first, path, 5)
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], 390)
        assert sorted(order.tolist()) == first.tolist()
        assert {tuple(ids[order[a] : order[a] + 5]): b - a for a, b in zip(starts, ends, strict=True)} == want


def test_words_of_one_hash_are_told_apart():
    text = b"aa bb aa cc bb aa"
    hashes, starts, sizes = substring_dedup.words_of(text)
    for h in (hashes, np.zeros(6, np.uint64)):
        assert substring_dedup.numbered(text, h, starts, sizes)[0].tolist() == [0, 1, 0, 2, 1, 0]


def test_substring_groups_get_whole_runs():
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(60))).encode() for _ in range(30)]
    own = substring_dedup.suffixes(texts, 4)
    for full in (np.zeros(substring_dedup.COUNTERS, bool), np.ones(substring_dedup.COUNTERS, bool)):
        name = substring_dedup.prefix_of(own, full)
        by: dict = {}
        for i in range(len(own.first)):
            w = tuple(own.ids[own.first[i] : own.first[i] + 4])
            assert by.setdefault(w, name[i]) == name[i]
    group = substring_dedup.Group(4)
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(own.first) != 1) | (np.diff(own.text) != 0))))
    counts = np.diff(np.append(starts, len(own.first)))
    group.add(substring_dedup.packed_runs(own, starts, counts, np.arange(30, dtype=np.int64), np.zeros(30, np.int64), 4))
    ids, _, places = group.removed()
    words, least = [t.split() for t in texts], {}
    for i, w in enumerate(words):
        for k in range(len(w) - 3):
            least.setdefault(tuple(w[k : k + 4]), i)
    assert sorted(zip(ids.tolist(), places.tolist(), strict=True)) == [(i, k) for i, w in enumerate(words) for k in range(len(w) - 3) if least[tuple(w[k : k + 4])] < i]


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """prints: (id, fingerprint)."""
    out = {}
    for i, f in prints:
        seen, edge = {f}, [f]
        while edge:
            x = edge.pop()
            for _, y in prints:
                if y not in seen and (x ^ y).bit_count() <= 3:
                    seen.add(y)
                    edge.append(y)
        out[(i, f)] = min((j for j, y in prints if y in seen and j is not None), default=None)
    return out


def test_simhash(spark, docs, odd):
    for df, options in ((docs, {}), (odd, {}), (docs, {"long_list": 1}), (docs, {"few": 1})):
        prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
        want = brute_components(prints)
        got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash.near_duplicates(df, **options).collect()]
        assert sorted(got, key=str) == sorted(((*k, want[k]) for k in prints), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("long_list", [1, 40, 4096])
def test_simhash_links_of_chains(spark, long_list):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = set(base)
    for b in base:
        for _ in range(60):
            for bit in r.sample(range(64), r.randrange(1, 5)):
                b ^= 1 << bit
            prints.add(b)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = components.components(simhash.links(simhash.index(df, long_list), long_list)).collect()
    want = brute_components([(p - (1 << 64) if p >> 63 else p, p) for p in prints])
    root = {r["node"]: r["root"] for r in found}
    assert all(root.get(i, i) == w for (i, _), w in want.items())


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    root = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in pairs if a is not None and a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root[x] for x in linked}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def labelled(spark):
    r = random.Random(4)
    bad, fine = ["idiotic", "trashy", "morons"], [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "so", "tu") for c in ("pe", "di", "vo")]
    rows, labels = [], []
    for i in range(600):
        toxic, junk = i % 4 == 0, i % 5 == 0
        words = [r.choice(fine) for _ in range(60)]
        if toxic:
            words[::15] = [r.choice(bad) for _ in words[::15]]
        text = " ".join(w.upper() + "!!" for w in words) if junk else " ".join(words) + "."
        rows.append((i, text))
        labels.append((i, 0 if junk else 1, 1 if toxic else 0))
    return frame(spark, [*rows, (1000, None), (1001, ""), (None, "x"), (5, "again")]), spark.createDataFrame([*labels, (2000, 1, 1), (7, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, module, label):
    docs, labels = labelled(spark)
    got = module.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    assert module.report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in module.report(docs.limit(5), labels.limit(0)).collect()} == {0.5}


def test_toxicity_of_misspellings(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    seen = spark.createDataFrame([(1, "kara idiotics losodi"), (2, "kara losodi mirape")], "doc_id bigint, text string")
    a, b = [r["score"] for r in toxicity.score(seen, model).orderBy("doc_id").collect()]
    assert a > 0.5 > b


def test_bpe(spark, docs, odd):
    own = bpe.codec()
    got = {r["doc_id"]: r for r in bpe.report(docs).collect()}
    for i, t in texts():
        ids = own.library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(t or "")
    assert bpe.report(odd).count() == odd.count() and bpe.report(docs.limit(0)).count() == 0
    back = bpe.decode(bpe.encode(docs)).selectExpr("coalesce(text, '') = decode(decoded, 'UTF-8') AS ok").distinct().collect()
    assert [r["ok"] for r in back] == [True]


def test_bpe_of_long_texts():
    own = bpe.codec()
    r = random.Random(1)
    mixed = "".join(r.choice(["abc", " the", "  ", "\n", "é", "12", "'s", "!?", " 𝔘", " "]) for _ in range(60_000))
    for t in (mixed, "word " * 30_000, "x" * 3_000 + " " * 2_500 + "tail"):
        assert own.encode(t) == own.library.encode_ordinary(t)
    for piece in (b"abcabcabd" * 60, "éàü".encode() * 90, b"aaaaaaaaaaaaaaab" * 30, b" " * 777):
        assert own.merge(piece) == own.library._encode_single_piece(piece)
    assert own.decode(own.encode("y" * 250_000)).decode() == "y" * 250_000


def test_mixing_lm(spark, docs, odd):
    import zlib

    for df in (docs, odd):
        rows = [(r["doc_id"], low(r["text"]).encode()) for r in df.select("doc_id", "text").collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        c, ends = Counter(), 0
        for i, t in rows:
            if not held(i):
                c.update(t.split())
                ends += 1
        n, v = sum(c.values()) + ends, len(c) + 1
        part = lambda k: np.log10((k + 0.1) / (n + 0.1 * (v + 1)))
        want = sorted((str(i), len(t.split()) + 1, sum(c[w] > 0 for w in t.split()) + 1, n, round(sum(part(c[w]) for w in t.split()) + part(ends), 4)) for i, t in rows)
        before, mixing_lm.HOT_WORDS = mixing_lm.HOT_WORDS, 5
        try:
            got = mixing_lm.report(df).collect()
        finally:
            mixing_lm.HOT_WORDS = before
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] < 0 for r in got)
    assert mixing_lm.report(docs.limit(0)).count() == 0


def test_mixing_lm_is_a_distribution():
    """The probabilities of all texts of one byte, and of all that begin with it, add up to the code's whole."""
    counts = np.zeros((256, 257), np.int64)
    counts[97, [97, 98, 256]] = 50, 30, 10
    learner = mixing_lm.Learner(mixing_lm.code(counts))
    learner.read([b"abab", b"aab", b"b"] * 200)
    model = learner.model
    model.odds = np.stack([np.round(mixing_lm.odds_of(c) * mixing_lm.STEP).astype(np.int8) for c in learner.counts])
    cat = np.array([0] * 6 + [97], np.int16)
    total = 0.0
    for s in range(257):
        cat[-1] = s
        b = mixing_lm.bits_of(cat, mixing_lm.contexts(cat), np.array([6]), model.tree)
        mixed = sum(model.odds[k][x].astype(float) / mixing_lm.STEP * model.weights[k][b.node] for k, x in enumerate(b.slots)).astype(np.float32)
        total += float(np.exp(-np.log1p(np.exp(-b.sign * model.refine(mixed, b))).sum()))
    assert abs(total - 1) < 1e-4
    likely, other = mixing_lm.log_probabilities(model, [b"abab", b"zzzz"])
    assert likely > other


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav>
<header class="top">Site</header><div class="cookie-notice">cookies</div>%s<aside>side</aside><form><p>send</p></form>
<section id="comments"><article><p>reader says</p></article></section><footer>&copy; host</footer><script>var t="</p>";</script></body></html>"""


def test_page_text(spark):
    article = "<article><header><h1>Caf&eacute; &amp; co</h1></header><p><b>One\n two<br>three<p>1 &lt; 2 <a title='x>y'>link</a></article>"
    bare = "<div><p>Shared line</p><p>Own %s</p><p>Other shared</p></div>"
    rows = [(1, "http://h.org/a", PAGE % article), (2, "http://h.org/b/1", PAGE % bare % "x"), (3, "http://h.org/b/2", PAGE % bare % "y"), (4, "http://alone.org/", PAGE % bare % "z"), (5, None, None), (6, "", ""), (None, "odd", "plain"), (1, "http://h.org/a", PAGE % article)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in page_text.main_text(pages).collect()), key=str)
    one = "Café & co\n\nOne two three\n\n1 < 2 link"
    want = [(1, one), (1, one), (2, "Own x"), (3, "Own y"), (4, "Shared line\n\nOwn z\n\nOther shared"), (5, ""), (6, ""), (None, "plain")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert page_text.main_text(pages.limit(0)).count() == 0


def test_page_text_against_all_pairs(spark):
    """Differencing against a plain version that looks at all pages of a host, and at all their lines."""
    r = random.Random(3)
    rows = []
    for i in range(90):
        host = r.choice(["a.org", "b.org", "C.org", f"solo{i}.org"])
        own = [f"<p>{r.choice('uvwxyz')}</p>" for _ in range(r.randrange(6))]
        rows.append((i, f"http://{host}/{r.randrange(30)}", "<nav>home</nav><div>top</div>" + "".join(own) + (f"<article><p>top</p><p>text {i}</p></article>" if i % 3 == 0 else "") + "<div>end</div>"))
    rows += [(200 + i, "http://b.org/7", rows[1][2]) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    keyed = pages.selectExpr("*", "xxhash64(page_id, url, html) AS row").collect()
    parsed = {x["row"]: page_text.lines_of(x["html"].encode()) for x in keyed}
    place = {x["row"]: (x["url"].split("/")[2].lower(), "/" + x["url"].split("/", 3)[3], x["row"]) for x in keyed}
    want = {}
    for x in keyed:
        row, (lines, kinds) = x["row"], parsed[x["row"]]
        other = [y for y in place if place[y][0] == place[row][0] and parsed[y][0] != lines]
        before, after = max((place[y] for y in other if place[y] < place[row]), default=None), min((place[y] for y in other if place[y] > place[row]), default=None)
        near = [y for y in (before, after) if y]
        gone = []
        if near:
            best = max(near, key=lambda y: len(os.path.commonprefix([place[row][1], y[1]])))[2]
            gone = [i for i in page_text.shared_lines(lines, parsed[best][0]) if kinds[i] != page_text.MAIN]
        want[x["page_id"]] = ("\n\n".join(page_text.text_of(lines, kinds, gone)), len(gone))
    got = {x["page_id"]: (x["text"], x["n_shared"]) for x in page_text.main_text(pages).collect()}
    assert got == want and any(k for _, k in want.values())
    assert all("top" not in t for i, (t, _) in got.items() if i < 90 and i % 3 and f"solo{i}.org" not in rows[i][1])


def test_page_lines():
    lines = lambda page: page_text.lines_of(page)[0]
    assert lines(b"<p title=it's>one</p><p class='x' data-y=\"a>b\" it's>two</p>a < b") == ["one", "two", "a < b"]
    own = page_text.lines_of(b"<article><p class=social>a</p><p id='ad-hoc'>b</p><div class='ad-slot'>c</div></article><div id=ad-hoc>d</div>")
    assert own[0] == ["a", "b", "c", "d"] and own[1].tolist() == [page_text.MAIN, page_text.MAIN, page_text.OTHER, page_text.PLAIN]


@pytest.mark.parametrize("square", [1, 20, 1 << 24])
def test_longest_common_subsequence(monkeypatch, square):
    monkeypatch.setattr(page_text, "SQUARE", square)
    r = random.Random(0)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        found = page_text.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == size[-1][-1] and all(any(a[i] == y for y in rest) for i in found)
