from pyspark.sql import functions as F

from quillframe.streaming.rows import document_stream, elapsed, latency, stream_rows


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        (src / f"{n}.txt").write_text(f"PO Number: {n}\n")
    seen = []
    docs = document_stream(spark, str(src))

    def on_row(row):
        seen.append(row["PO Number"])
        raise RuntimeError("ignored")

    sink = str(tmp_path / "out")
    stream_rows(docs, sink, str(tmp_path / "ck"), on_row, value_columns=["PO Number"]).awaitTermination()
    rows = spark.read.parquet(sink)
    assert sorted(seen) == ["0", "1", "2"] and rows.count() == 3 and rows.select("batch_id").distinct().count() == 3
    assert latency(rows).first()["rows"] == 3
    (src / "9.txt").write_text("PO Number: 9\n")
    stream_rows(docs, sink, str(tmp_path / "ck"), value_columns=["PO Number"]).awaitTermination()
    assert spark.read.parquet(sink).count() == 4


def test_elapsed(spark):
    df = spark.createDataFrame([(65,), (3661,), (360061,)], "s int")
    assert [r[0] for r in df.select(elapsed(F.col("s"))).collect()] == ["01:05", "01:01:01", "100:01:01"]
