import pytest
from pyspark.sql import functions as F

from lexdrift.operators import sketch, tokens
from lexdrift.sources.staging import listed
from lexdrift.streaming import counts

SF = "/root/testdata/sf0.001"


def table(df):
    return sorted(map(tuple, df.collect()))


def stream_of(spark, df, path):
    df.repartition(4).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_sketch_of_a_stream_is_that_of_a_batch(spark, tmp_path):
    base = f"file://{tmp_path}"
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("key"), "ts")
    stream = stream_of(spark, events, f"{base}/in")
    p = sketch.SketchParams(width=50, depth=3)
    assert counts.read_sketch(spark, f"{base}/out") is None
    q = counts.sketch_stream(stream, p, f"{base}/out", f"{base}/check")
    q.processAllAvailable()
    q.stop()
    want = table(sketch.build(events.select("key"), p, "stream").select("sketch", "row", "bucket", "cnt"))
    assert table(counts.read_sketch(spark, f"{base}/out")) == want
    assert counts.compact_sketch(spark, f"{base}/out") == 3
    assert table(counts.read_sketch(spark, f"{base}/out")) == want
    w = counts.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("wi").start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("wi").columns == ["window", "key", "n"]


def test_words_of_a_stream_that_is_killed_and_goes_on(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = tokens.corpus_lines(stream_of(spark, docs, f"{base}/docs"), "lang")
    want = table(tokens.word_counts(tokens.corpus_lines(docs, "lang")))
    plain, calls = tokens.word_counts, []

    def fails(batch, min_length):
        calls.append(1)
        if len(calls) == 3:  # the third batch is written, and the query dies before that is known
            plain(batch, min_length).write.mode("overwrite").parquet(f"{base}/out/delta/{2:012d}")
            raise RuntimeError("killed")
        return plain(batch, min_length)

    monkeypatch.setattr(tokens, "word_counts", fails)
    q = counts.word_stream(lines, f"{base}/out", f"{base}/check")
    with pytest.raises(Exception, match="killed"):
        q.processAllAvailable()
    monkeypatch.setattr(tokens, "word_counts", plain)
    assert counts.compact_words(spark, f"{base}/out") == 2
    q = counts.word_stream(lines, f"{base}/out", f"{base}/check")
    q.processAllAvailable()
    q.stop()
    assert table(counts.read_words(spark, f"{base}/out")) == want


def test_a_crash_in_compaction_loses_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = [[("a", "x", 1), ("a", "y", 2)], [("a", "x", 4)], [("b", "x", 8)], [("a", "x", 16)]]
    for k, r in enumerate(rows):
        spark.createDataFrame(r, "slice string, word string, n long").write.parquet(f"{path}/delta/{k:012d}")
    want = [("a", "x", 21), ("a", "y", 2), ("b", "x", 8)]
    assert table(counts.read_words(spark, path)) == want
    half = f"{path}/base/{2:012d}"
    spark.createDataFrame([("a", "x", 99)], "slice string, word string, n long").write.parquet(half)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{half}/_SUCCESS")
    hidden.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hidden, False)
    assert table(counts.read_words(spark, path)) == want  # a table that isn't whole doesn't count
    assert counts.compact_words(spark, path) == 3
    assert table(counts.read_words(spark, path)) == want and listed(spark, f"{path}/delta") == [f"{3:012d}"]
    spark.createDataFrame([("a", "y", 5)], "slice string, word string, n long").write.parquet(f"{path}/delta/{4:012d}")
    assert counts.compact_words(spark, path) == 1 and counts.compact_words(spark, path) == 0
    assert table(counts.read_words(spark, path)) == [("a", "x", 21), ("a", "y", 7), ("b", "x", 8)]
    # Deltas that were summed and not yet deleted aren't counted twice.
    spark.createDataFrame([("a", "x", 16)], "slice string, word string, n long").write.parquet(f"{path}/delta/{3:012d}")
    assert table(counts.read_words(spark, path)) == [("a", "x", 21), ("a", "y", 7), ("b", "x", 8)]
