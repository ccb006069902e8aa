"""The pipeline's near-duplicates against all pairs by exact similarity of 5-word shingles."""

import random

import numpy as np

import corpus_pipeline
from changeloom.llm import similar
from tests.llm.test_operators import frame


def brute(texts):
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and (sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in sets}


def near_texts():
    r = random.Random(3)
    rows = []
    for f in range(60):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(120, 400))]
        rows.append(words)
        for _ in range(3):
            copy = list(words)
            for at in r.sample(range(len(copy)), max(1, len(copy) // r.choice([45, 60, 90, 200]))):
                copy[at] = f"x{r.randrange(5000)}"
            rows.append(copy)
    return [*enumerate(" ".join(w) for w in rows), (900, None), (901, " "), (902, "one two"), (903, "One  two"), (904, "one three")]


def test_near_copies_by_similarity(spark):
    texts = near_texts()
    want = brute(texts)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(frame(spark, texts)).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 3 and all(got[i] == want[i] for i in range(900, 905) if i in got)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, texts), "").collect()}
    least = {i for i in want if want[i] == i}
    assert least <= kept and len(kept - least) <= 3


def test_one_first_text_does_not_decide(spark):
    """Texts that are near the bucket's first one without being similar enough are still linked with each other."""
    words = [f"w{i}" for i in range(400)]
    chain = [list(words)]
    for step in range(1, 5):
        chain.append([f"y{i}" if i % 61 == 7 and i < 91 * step else w for i, w in enumerate(words)])
        chain.append([f"z{step}x{i}" if i in (100 * step - 30, 100 * step - 60, 100 * step - 90) else w for i, w in enumerate(chain[-1])])
    texts = [(i, " ".join(w)) for i, w in enumerate(chain)]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(frame(spark, texts)).collect()}
    assert got == brute(texts)


def test_whole_fingerprints_let_similar_sets_through():
    """Sets at 0.8 of FEW shingles or more differ in few enough bits, whether they are of one size or one holds the other."""
    r = np.random.default_rng(1)
    words = similar.words_of(20, 127)
    most, lost = similar.most_differing(64 * words), 0
    for n in (similar.FEW, 40, 100, 700):
        both = -(-8 * n // 9)
        for _ in range(60):
            x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            for other in (np.concatenate((x[:both], x[n : 2 * n - both])), x[: -(-4 * n // 5)]):
                lost += int((similar.long_fingerprint(x[:n], words) != similar.long_fingerprint(other, words)).sum()) > most
    assert lost <= 1


def test_each_unlinked_pair_is_tested_once(spark):
    """A pair shares many lists and comes from the first; pairs of one label, and those that aren't similar, don't come."""
    bits, lists = 20, 127
    r = np.random.default_rng(2)
    x = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = {1: x[:300], 2: x[4:304], 3: x[6:306], 4: np.concatenate((x[:200], x[310:400])), 5: x[2:302]}
    rows = []
    for node, own in sets.items():
        made = np.packbits(similar.long_fingerprint(own, similar.words_of(bits, lists))).tobytes()
        key, fp = similar.keys(own, bits, lists)
        rows += [(int(k), node, fp, len(own), 5 if node == 1 else node, bytearray(made)) for k in key]
    frame_ = spark.createDataFrame(rows, "key bigint, node bigint, fp bigint, n bigint, label bigint, whole binary")
    got = sorted(tuple(r) for r in similar.unlinked(frame_, bits, lists).collect())
    assert got == [(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)]


def test_lists_are_byte_positions():
    """A list is some whole bytes of the fingerprint, whatever the number of texts, and no position is in two lists."""
    own = np.random.default_rng(6).integers(0, 2**63, 90, dtype=np.uint64)
    for n in (1, 10**5, 10**6, 10**7, 10**9):
        bits, lists = similar.shape(n)
        assert bits % 8 == 0
        words = similar.words_of(bits, lists)
        whole = np.packbits(similar.long_fingerprint(own, words))
        key = similar.buckets(np.unpackbits(whole), bits, lists)
        for at in (0, 2, bits // 8 * lists - 1):
            other = whole.copy()
            other[at] ^= 9
            changed = np.flatnonzero(similar.buckets(np.unpackbits(other), bits, lists) != key)
            assert changed.tolist() == [at // (bits // 8)]


def test_shared_bytes_are_tallied(spark):
    """Sets of one list whose last 64 bits are near are retained if enough positions share their byte."""
    r = np.random.default_rng(7)
    marks = np.repeat(r.integers(-(2**62), 2**62, 4)[None], 4, axis=0)
    marks[1] ^= np.frombuffer(b"\x01" * 32, np.int64)  # no byte shared with 0: 8 bits of the last 64 differ
    marks[2] ^= np.frombuffer(b"\x01" * 30 + b"\0\0", np.int64)  # two shared
    marks[3] ^= np.frombuffer(b"\x02" * 31 + b"\0", np.int64)  # one shared with 0 and 2, none with 1
    rows = spark.createDataFrame([(7, i, 50, *m) for i, m in enumerate(marks.tolist())], "key bigint, node bigint, n bigint, m0 bigint, m1 bigint, m2 bigint, m3 bigint")
    assert sorted((x["node"], x["first"]) for x in similar.candidates(rows).collect()) == [(0, 0), (1, 1), (2, 0)]


def test_few_similar_sets_are_lost_by_the_tally():
    r = np.random.default_rng(8)
    bits, lists = similar.shape(10**5)
    lost = tried = 0
    for n in (9, 18, 45, 90, 400):
        both = -(-8 * n // 9)
        for _ in range(60):
            x = r.integers(0, 2**63, 2 * n, dtype=np.uint64)
            (_, a), (_, b) = (similar.placed(s, bits, lists) for s in (x[:n], np.concatenate((x[:both], x[n : 2 * n - both]))))
            tried, lost = tried + 1, lost + int(np.count_nonzero((a ^ b).view(np.uint8) == 0) < similar.SHARED)
    assert lost <= tried // 100
