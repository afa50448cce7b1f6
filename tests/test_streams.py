"""Streams in several batches give what one batch gives, and a batch that runs again doubles nothing."""

import pytest
from pyspark.sql import functions as F

from strataloom.streaming import jobs


def files(spark, tmp_path, batches, schema):
    """One Parquet file a batch, in order of time written."""
    like = spark.createDataFrame([], schema)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return jobs.source(spark, f"{tmp_path}/in", like)


def test_gaps_over_batches_out_of_order(spark, tmp_path):
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    batches = [[(1, day(1)), (1, day(3)), (2, day(2))], [(1, day(2)), (2, day(1, 12))], [(1, day(9)), (2, day(9))], [(None, day(28))]]
    stream = files(spark, tmp_path, batches, "k bigint, at string").select("k", F.col("at").cast("timestamp").alias("at"))
    rows = jobs.drain(jobs.arrival_gaps(stream, "k", "at", "5 days"), "append").where("key is not null").collect()
    got = sorted((r.key, r.gap_seconds / 3600) for r in rows)
    assert got == [(1, 24.0), (1, 24.0), (1, 144.0), (2, 12.0), (2, 168.0)]


def test_growth_and_retractions_by_batch(spark, tmp_path):
    batches = [[("en", "a b a", 1), ("fr", "x", 1)], [("en", "b c", 1)], [("en", "a b a", -1)]]
    stream = files(spark, tmp_path, batches, "lang string, text string, delta int")
    rows = jobs.changes(stream.select(F.col("lang").alias("by"), F.explode(F.split("text", " ")).alias("tok"), "delta")).collect()
    last = {(r.by, r.all_total, r.all_uniq) for r in rows if r.batch == max(x.batch for x in rows if x.by == r.by)}
    assert last == {("en", 2, 2), ("fr", 1, 1)}
    assert sum(r.total for r in rows) == 3 and min(r.uniq for r in rows) >= -1


def test_a_batch_that_runs_again_overwrites_itself(spark, tmp_path):
    stream = files(spark, tmp_path, [[(1,)], [(2,)], [(3,)]], "k bigint")

    def twice(batch, folder, number):
        for _ in range(2):  # as after a driver lost between the write and the commit
            batch.write.mode("overwrite").parquet(folder)

    path, last = jobs.run_batches(stream, "append", twice)
    assert last == 2 and sorted(r.k for r in spark.read.option("recursiveFileLookup", True).parquet(path).collect()) == [1, 2, 3]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_an_empty_stream_gives_no_rows(spark, tmp_path, mode):
    stream = files(spark, tmp_path, [[]], "k bigint")
    out = stream if mode == "append" else stream.groupBy("k").count()
    assert jobs.drain(out, mode).count() == 0


def test_growth_goes_on_from_the_checkpoint(spark, tmp_path):
    """Two runs over one checkpoint give what one pass over all gives; the second run reads no old file and passes no old term on."""
    texts = ["a b a", "b c d", "a e", "", "c f g f", "a b h"]
    rows = [(k, "x" if k != 3 else None, t) for k, t in enumerate(texts)]
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run(part):
        frame = spark.createDataFrame(part, "doc_id bigint, lang string, text string")
        frame.coalesce(1).write.mode("append").parquet(source)
        found = jobs.first_occurrences(jobs.source(spark, source, frame), "lang", "doc_id", shards=3)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.tok, r.doc, r.pos) for r in spark.read.parquet(out).collect())

    assert run(rows[:3]) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 2), ("e", 2, 1)]
    assert run(rows[3:]) == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 2), ("e", 2, 1), ("f", 4, 1), ("g", 4, 2), ("h", 5, 2)]


def test_counts_of_batches_add_up(spark):
    docs = spark.createDataFrame([(k, "a b " * (k % 3) + f"w{k}") for k in range(40)], "doc_id bigint, text string")
    stream = jobs.landed(docs, 8, 2)
    got = jobs.drain_counts(jobs.ngrams(stream, 2), "ngram", "freq")
    assert sorted(got.collect()) == sorted(jobs.ngram_counts(docs, 2).collect())
    assert jobs.drain_counts(jobs.ngrams(jobs.landed(docs.limit(0)), 2), "ngram", "freq").count() == 0


def test_a_batch_is_not_one_file(spark, tmp_path):
    from strataloom.plans import extended_queries as eq

    spark.range(100).withColumn("text", F.lit("a b")).write.parquet(f"{tmp_path}/documents.parquet")
    files = []
    jobs.run_batches(eq._stream(spark, tmp_path, "documents"), "append", lambda batch, folder, _: files.append(len({r[0] for r in batch.select(F.input_file_name()).distinct().collect()})))
    assert len(files) == 4 and set(files) == {spark.sparkContext.defaultParallelism}
