"""The pipeline's stages, each against a plain version over what it gets."""

import corpus_pipeline
from changeloom.llm import bpe
from tests.llm.test_operators import brute_components, brute_fingerprint, labelled

PASSAGE = "mira neso kara lotu pedi vora kasope milodi nerapa sotuvo kadire"


def test_pipeline(spark, tmp_path):
    docs, labels = labelled(spark)
    docs = docs.select("doc_id", "text").filter("doc_id is null or doc_id < 200").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "cast(length(text) AS bigint) AS n_chars")
    more = [(300 + i, f"Kara unique{i} words{i} in line{i}\nShared footer line") for i in range(12)] + [(320, f"so it goes {PASSAGE} and on"), (321, None)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in more], docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
        assert name == "bpe" or at.columns == columns
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    ids = {r["doc_id"] for r in kept["toxicity"]}
    wrong = [i for i in range(200) if (i in ids) == bool(truth[i])]
    assert len(wrong) < 10 and 305 in ids
    lines = {r["doc_id"]: r["text"] for r in kept["line_dedup"]}
    assert lines[301] == "Kara unique1 words1 in line1" and lines[321] is None and len(lines) == len(ids)
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in kept["line_dedup"] if r["doc_id"] is not None]
    every = [(r["doc_id"], brute_fingerprint(r["text"])) for r in kept["line_dedup"]]
    want = brute_components(every)
    assert sorted(r["doc_id"] for r in kept["simhash"] if r["doc_id"] is not None) == sorted({i for i, f in prints if want[(i, f)] == i})
    assert {r["doc_id"] for r in kept["simhash"]} - {r["doc_id"] for r in kept["decontamination"]} == {320}
    text = {r["doc_id"]: r["text"] or "" for r in kept["decontamination"]}
    for r in kept["bpe"]:
        assert r["round_trip"] and r["ids"] == bpe.codec().library.encode_ordinary(text[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["bpe"])
