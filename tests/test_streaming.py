from plumbline.streaming.watch import start

TABLE = "| a | n |\n|--|--|\n| x | 1 |\n| y | 2 |\n| total | {} |"


def test_batches(spark, tmp_path):
    schema = "path string, text string"
    got = []

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(1, [("a.md", TABLE.format(3)), ("b.md", TABLE.format(4))])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = start(stream, lambda df, i: got.extend((i, r.path, r.direction) for r in df.collect()), str(tmp_path / "cp"))
    try:
        query.processAllAvailable()
        put(2, [("c.md", TABLE.format(2)), ("d.md", None)])
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(p for _, p, _ in got) == ["b.md", "c.md"] and len({i for i, _, _ in got}) == 2
