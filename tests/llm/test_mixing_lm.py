"""What the language model learns from, and when it moves."""

import re

import numpy as np

from changeloom.llm import mixing_lm


def test_weights_learn_from_every_text():
    counts = np.zeros((256, 257), np.int64)
    learner = mixing_lm.Learner(mixing_lm.code(counts))
    learner.seen = 1e9
    learner.read([b"abab", b"aab", b"b"] * 50)
    assert learner.refining[0].sum() == learner.counts[0].sum() > 0


def test_weights_move_within_an_ordinary_text():
    counts = np.zeros((256, 257), np.int64)
    counts[97, [97, 98, 256]] = 50, 30, 10
    learner = mixing_lm.Learner(mixing_lm.code(counts))
    learner.read([b"abab", b"aab", b"b"] * 200)
    model = learner.model
    model.odds = np.stack([np.round(mixing_lm.odds_of(c) * mixing_lm.STEP).astype(np.int8) for c in learner.counts])
    text, rate = b"abba" * 75, mixing_lm.RATE
    online = mixing_lm.log_probabilities(model, [text])
    try:
        mixing_lm.RATE = 0.0
        still = mixing_lm.log_probabilities(model, [text])
    finally:
        mixing_lm.RATE = rate
    assert online != still


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(mixing_lm, "SHARD", 20_000)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' and ', id % 11, ' more, '), cast(5 + id % 60 AS int)) AS text")
    one, two = ({r["doc_id"]: r["score"] for r in mixing_lm.report(docs.repartition(n)).collect()} for n in (2, 7))
    assert one == two and len(one) == 300


def plain_score(model, text):
    """The model's log10 probability of a short text, bit by bit."""
    total, symbols = 0.0, [0] * 6 + [*text.lower(), mixing_lm.END]
    cat = np.array(symbols, np.int16)
    hashed = mixing_lm.contexts(cat)
    for at in range(6, len(cat)):
        before, symbol = symbols[at - 1] & 255, symbols[at]
        sym = before * 257 + symbol
        start = int(model.tree.start[sym])
        for k in range(start, start + int(model.tree.length[sym])):
            node, sign = int(model.tree.node[k]), float(model.tree.sign[k])
            odds = sum(float(model.weights[p, node]) * int(model.odds[p, int(h[at]) ^ int(model.tree.offset[k])]) / mixing_lm.STEP for p, h in enumerate(hashed))
            bucket = int(min(7.99, max(-7.99, odds)) * mixing_lm.BUCKETS / 16 + mixing_lm.BUCKETS / 2)
            refined = (odds + float(model.refined[before, bucket])) / 2
            total -= np.log10(1 + np.exp(-sign * refined))
    return total


def test_scores_against_a_plain_version():
    counts = np.ones((256, 257), np.int64)
    learner = mixing_lm.Learner(mixing_lm.code(counts))
    learner.read([b"the cat sat on the mat", b"a dog and a cat", b"", None] * 40)
    model = learner.model
    model.odds = np.stack([np.round(mixing_lm.odds_of(c) * mixing_lm.STEP).astype(np.int8) for c in learner.counts])
    texts = [b"The cat sat", b"", b"zebra \xc3\xa9", b"on the mat and a dog"]
    assert np.allclose(mixing_lm.log_probabilities(model, texts), [plain_score(model, t) for t in texts], rtol=1e-3)


def test_words_of_many_texts_are_hashed_at_once():
    texts = [b"The cat\tsat", None, b"", b" \n ", b"cat " * 20_000, b"x" * 100_000 + b" the", b"cat"]
    hashes, n = mixing_lm.hashed_words(texts)
    plain = [re.findall(rb"[^\x20\x09-\x0D]+", (t or b"").lower()) for t in texts]
    assert n.tolist() == [len(x) for x in plain]
    pairs = set(zip((w for x in plain for w in x), hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_bits_in_pieces_are_counted_as_they_are_one_by_one(monkeypatch):
    counts = np.ones((256, 257), np.int64)
    texts = [b"the cat sat on the mat", b"", None, b"a dog and a cat"] * 3
    monkeypatch.setattr(mixing_lm, "AT_ONCE", 7)
    learner = mixing_lm.Learner(mixing_lm.code(counts))
    learner.read(texts)
    tree, plain = learner.model.tree, np.zeros_like(learner.counts)
    for t in texts:
        symbols = [0] * 6 + [*(t or b""), mixing_lm.END]
        hashed = mixing_lm.contexts(np.array(symbols, np.int16))
        for at in range(6, len(symbols)):
            sym = symbols[at - 1] * 257 + symbols[at]
            for k in range(int(tree.start[sym]), int(tree.start[sym]) + int(tree.length[sym])):
                for p, h in enumerate(hashed):
                    plain[p, int(h[at]) ^ int(tree.offset[k]), int(tree.sign[k] > 0)] += 1
    assert (plain == learner.counts).all()
