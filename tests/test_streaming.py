from pyspark.sql import functions as F

from corpusqa.streaming import run_changes, run_gate, section_stream


def test_gate_sees_changed_sections_only(spark, tmp_path):
    schema = "corpus STRING, seq BIGINT, text STRING"
    spark.createDataFrame([("b", 1, "same"), ("b", 2, "old")], schema).write.parquet(str(tmp_path / "snap"))
    spark.createDataFrame([("b", 1, "same"), ("b", 2, "new"), ("b", 3, "added")], schema).write.parquet(str(tmp_path / "in"))
    query = run_gate(section_stream(spark, str(tmp_path / "in")), str(tmp_path / "snap"), lambda df: df.select("corpus", "seq", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 3]


def test_each_change_is_told_once(spark, tmp_path):
    """Three batches, each from a new query on the same checkpoint."""
    schema = "corpus STRING, seq BIGINT, text STRING, rev BIGINT"
    batches = [
        [("b", 1, "x", 1), ("b", 2, "y", 1), ("b", 2, "older", 0), ("c", 1, None, 1)],
        [("b", 1, "x", 2), ("b", 2, "z", 2), ("b", 3, "new", 1)],
        [("b", 1, "x2", 3), ("b", 2, "z", 3), ("b", 3, "new", 2), ("c", 1, "", 2)],
    ]
    told = [[("b", 1, "added", "x"), ("b", 2, "added", "y"), ("c", 1, "added", "")], [("b", 2, "modified", "z"), ("b", 3, "added", "new")], [("b", 1, "modified", "x2")]]
    seen = 0
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_changes(stream, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("batch", "corpus", "seq", "status", "text").collect())
        new = sorted(r[1:] for r in found)
        for r in told[0 if not i else i]:
            assert r in new
        assert len(new) - seen == len(told[i])
        seen = len(new)
