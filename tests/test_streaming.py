"""Streams, read from files in batches."""

from changeloom.streaming import follow


def run(query):
    q = query.start()
    q.processAllAvailable()
    q.stop()


def test_new_commits_once(spark, tmp_path):
    schema = "repo string, hash string, ts timestamp, subject string"
    spark.createDataFrame([("r", "h1", None, "a")], schema).selectExpr("repo", "hash", "timestamp'2026-01-01' AS ts", "subject").write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("r", "h1", None, "a"), ("r", "h2", None, "b")], schema).selectExpr("repo", "hash", "timestamp'2026-01-01' AS ts", "subject").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run(follow.append_history(stream, f"{tmp_path}/out", f"{tmp_path}/check"))
    assert sorted(r["hash"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["h1", "h2"]


def test_activity_and_bounded_log(spark, tmp_path):
    rows = spark.range(10).selectExpr("'k' AS who", "timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 20 AS int)) AS ts", "concat('line ', id) AS line")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run(follow.activity(stream(), "ts", ["who"]).writeStream.format("memory").queryName("seen").outputMode("complete"))
    assert sorted(r["count"] for r in spark.table("seen").collect()) == [1, 3, 3, 3]
    run(follow.bounded_log(stream(), "who", "line", 4).writeStream.format("memory").queryName("log").outputMode("update"))
    last = spark.table("log").collect()[-1]
    assert len(last["lines"]) == 4 and last["dropped"] == 6


def test_the_oldest_log_goes(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in follow.STATE_STORE}
    for k, v in follow.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        batches = [[("o", "t1", "a"), ("o", "t2", "b"), ("p", "t9", "z")], [("o", "t1", "c"), ("o", "t1", "d"), ("o", "t3", "e")], [("o", "t2", "f"), ("o", "t1", "g")]]
        for rows in batches:
            spark.createDataFrame(rows, "who string, thread string, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("who string, thread string, line string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
        run(follow.bounded_logs(stream, "who", "thread", "line", 2, 2).writeStream.format("memory").queryName("logs").outputMode("update"))
        seen = {}
        for r in spark.table("logs").collect():
            seen.setdefault((r["who"], r["thread"]), []).append(None if r["evicted"] else (r["lines"], r["dropped"]))
        assert seen[("o", "t1")] == [(["a"], 0), (["c", "d"], 1), (["d", "g"], 2)]
        assert seen[("o", "t2")] == [(["b"], 0), None, (["f"], 0)]  # evicted for t3, then anew
        assert seen[("o", "t3")] == [(["e"], 0), None] and seen[("p", "t9")] == [(["z"], 0)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
