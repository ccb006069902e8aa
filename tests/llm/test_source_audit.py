"""Shares of terms by source against SQL, and counted terms against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from changeloom.llm import source_audit
from tests.llm.test_operators import by_sql, low

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows(n=160, seed=4):
    r = random.Random(seed)
    vocab = ["a", "An", "THE", "four", "five5six", "seven", "eightlet", "ninechars", "sixteencharacter", "x" * 17, "Y" * 40, "z" * 130, "é", "Été", "слово", "ein-zwei", "\u0085"]
    out = []
    for i in range(n):
        text = " ".join(r.choice(vocab) + r.choice(["", "", ",", "\n", "1"]) for _ in range(r.randrange(0, 25)))
        out.append((i, text, r.choice(["en", "en", "de"]), f"s{r.randrange(5)}"))
    odd = [(n, None, None, None), (n + 1, "the An", None, "s1"), (None, "the", "en", None), (3, "the", "en", "s1"), (n + 2, "the " * 50_000, "en", "s2"), (n + 3, "q" * 300_000, "de", "s9"), (n + 4, "", "xx", "s1"), (n + 5, "1 2", "xx", "s2"), (n + 6, None, "yy", "only")]
    return out + odd


def frame(spark, given):
    return spark.createDataFrame([(*r, "x", 1) for r in given], SCHEMA).repartition(4)


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()), key=str)


def test_as_sql(spark):
    docs = frame(spark, rows())
    got = result(source_audit.audit(docs))
    assert {r[0] for r in got if r[2] == "pair"} == {"en", "de", "xx", ""} and ("xx", "s1", "pair", "s2", 0, 1) in got
    assert got == by_sql(spark, docs, "op13_source_audit")
    assert result(source_audit.audit(docs, block=3, tile=2)) == got
    assert result(source_audit.audit(docs.limit(0))) == []


def test_top(spark):
    docs = frame(spark, rows())
    whole = result(source_audit.audit(docs))
    assert result(source_audit.audit(docs, top=2)) == [r for r in whole if r[2] == "pair" or r[5] <= 2]


def test_counted_by_buckets():
    r = random.Random(9)
    letters = "aZé字b"
    texts = ["".join(r.choice(letters + " 1") for _ in range(400)) + " " + "".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(40)]
    texts += ["", "end", "z" * 129, "ab ab", "ab"]
    groups = np.sort(np.array([r.randrange(3) for _ in texts]))
    want, docs = Counter(), defaultdict(set)
    for i, t in enumerate(texts):
        for term in TERM.findall(t):
            key = (low(term).encode(), int(groups[i]))
            want[key] += 1
            docs[key].add(i)
    got = {}
    for terms, g, n, d in source_audit.counted([t.encode() for t in texts], groups):
        for x in zip(terms, g.tolist(), n.tolist(), d.tolist()):
            assert x[:2] not in got
            got[x[:2]] = x[2:]
    assert got == {k: (want[k], len(docs[k])) for k in want}


def test_radix_order_is_stable():
    r = np.random.default_rng(3)
    for width, words in ((2, 1), (4, 1), (8, 1), (16, 2)):
        keys = [r.integers(0, 1 << 64, 999, np.uint64) for _ in range(words)]
        if width < 8:
            keys = [k >> np.uint64(64 - 8 * width) << np.uint64(64 - 8 * width) for k in keys]
        keys[0][::3] = keys[0][0]
        assert (source_audit.radix_order(keys, width) == np.lexsort(keys[::-1])).all()
