"""Incremental forms as Structured Streaming: token counts, vocabulary growth, arrival gaps, time windows.

Each takes a streaming DataFrame; ``drain`` runs one to the end of what is there and returns the result
table, so that the same code serves a long-running query and a test.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from strataloom.functions import text as tx
from strataloom.operators.prefix import running_sums
from strataloom.session import drop_path, shared_path


def source(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def landed(table: DataFrame, files: int = 4, files_per_trigger: int = 1, closing: DataFrame | None = None) -> DataFrame:
    """A table written to a folder of the shared place and read from there as a stream, some files at a time; ``closing`` rows come last."""
    folder = shared_path(table.sparkSession, "stream-in")
    table.repartition(files).write.parquet(folder)
    if closing is not None:
        closing.select(*table.columns).coalesce(1).write.mode("append").parquet(folder)
    return source(table.sparkSession, folder, table, files_per_trigger)


def landed_in_order(table: DataFrame, order: str, batches: int, files: int = 4) -> DataFrame:
    """A table as a stream of so many batches of ``files`` files, each batch a range of ``order`` (by its approximate quantiles), written one after the other."""
    folder = shared_path(table.sparkSession, "stream-in")
    bounds = sorted(set(table.agg(F.percentile_approx(order, [k / batches for k in range(1, batches)])).first()[0] or []))
    for low, high in itertools.pairwise([None, *bounds, None]):
        part = table
        if low is not None:
            part = part.where(F.col(order) > F.lit(low))
        if high is not None:
            part = part.where((F.col(order) <= F.lit(high)) | (F.col(order).isNull() if low is None else F.lit(False)))
        part.repartition(files).write.mode("append").parquet(folder)
    return source(table.sparkSession, folder, table, files)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is available; in append mode the rows, in complete mode the last table.

    Each batch overwrites a folder of its own number, so a batch that is run again after a failure doubles nothing.
    """
    path, last = run_batches(stream, mode, lambda batch, folder, _: batch.write.mode("overwrite").parquet(folder))
    spark = stream.sparkSession
    if last is None:
        return spark.createDataFrame([], stream.schema)
    if mode == "append":
        return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last:09d}")


def run_batches(stream: DataFrame, mode: str, work: Callable[[DataFrame, str, int], None]) -> tuple[str, int | None]:
    """Run ``work(batch, folder of its number, number)`` over all that is available; the common folder and the last number."""
    spark = stream.sparkSession
    path, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        work(batch, f"{path}/{number:09d}", number)
        last.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    drop_path(spark, state)
    return path, max(last, default=None)


def drain_counts(rows: DataFrame, by: str, count: str) -> DataFrame:
    """``(by, count)`` after the last batch of a stream of rows to be counted.

    A batch adds a table of its own counts, which a batch that runs again overwrites; so it costs what it brings, holds no state, and does not write
    again what came before, as complete mode does. The tables are added up at the end.
    """
    path, last = run_batches(rows, "append", lambda batch, folder, _: batch.groupBy(by).agg(F.count("*").alias(count)).write.mode("overwrite").parquet(folder))
    spark, kind = rows.sparkSession, f"`{by}` {rows.schema[by].dataType.simpleString()}, `{count}` bigint"
    found = spark.createDataFrame([], kind) if last is None else spark.read.schema(kind).option("recursiveFileLookup", True).parquet(path)
    return found.groupBy(by).agg(F.sum(count).alias(count))


def token_counts(docs: DataFrame) -> DataFrame:
    """Running term frequency."""
    return docs.select(F.explode(tx.tokens(F.col("text"))).alias("tok")).groupBy("tok").agg(F.count("*").alias("tf"))


def ngrams(docs: DataFrame, n: int) -> DataFrame:
    """A row for each n-gram."""
    return docs.select(F.explode(tx.ngrams(tx.tokens(F.col("text")), n)).alias("ngram"))


def ngram_counts(docs: DataFrame, n: int) -> DataFrame:
    return ngrams(docs, n).groupBy("ngram").agg(F.count("*").alias("freq"))


def vocabulary_counts(docs: DataFrame, by: str) -> DataFrame:
    """Running frequency of each group's tokens: the state that vocabulary growth needs, a row for each token."""
    return docs.select(by, F.explode(tx.tokens(F.col("text"))).alias("tok")).groupBy(by, "tok").agg(F.count("*").alias("n"))


def vocabulary_growth(counts: DataFrame, by: str) -> DataFrame:
    """``(by, total, uniq)`` of a table of ``vocabulary_counts`` as it stands after a batch."""
    return counts.groupBy(by).agg(F.sum("n").alias("total"), F.count("*").alias("uniq"))


def arrival_gaps(events: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """``(key, ts, gap_seconds)``: time since the key's event before, in order of time whatever the order of arrival.

    An event waits in the key's state until the watermark, ``delay`` behind the latest event, has passed it, so
    events that come up to ``delay`` late still stand in their place; later ones are dropped. The state holds the
    last event given out and those that wait. Times are whole microseconds.
    """
    kind = events.schema[key].dataType.simpleString()

    def step(keys, batches, state: GroupState):
        last, waiting = state.get if state.exists else (None, [])
        mark = state.getCurrentWatermarkMs() * 1000
        waiting = [*waiting]
        if not state.hasTimedOut:
            for rows in batches:
                waiting += [t for t in rows["at"].tolist() if t > mark]
        waiting.sort()
        ready = bisect.bisect_right(waiting, mark)
        given = ([] if last is None else [last]) + waiting[:ready]
        last, waiting = (given[-1] if given else None), waiting[ready:]
        state.update((last, waiting))
        if waiting:  # comes back once the watermark has passed the first
            state.setTimeoutTimestamp(waiting[0] // 1000 + 1)
        yield pd.DataFrame({"key": [keys[0]] * (len(given) - 1), "at": given[1:], "gap_seconds": [(b - a) / 1e6 for a, b in itertools.pairwise(given)]})

    t = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).alias("key"), t.alias("ts"), F.unix_micros(t).alias("at")).withWatermark("ts", delay)
    gaps = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, at bigint, gap_seconds double", "last bigint, waiting array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return gaps.select("key", F.timestamp_micros("at").alias("ts"), "gap_seconds")


def growth(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """``(by, batch, total, uniq, all_total, all_uniq)``: tokens and new tokens of each batch of a stream, and both up to it.

    What was seen is a table of tokens in the shared folder, a folder for each batch, which a batch that runs again
    overwrites; a batch's tokens meet it in one join.
    """
    return changes(docs.select(F.col(by).alias("by"), F.explode(tx.tokens(F.col(text))).alias("tok"), F.lit(1).alias("delta"))).withColumnRenamed("by", by)


def changes(rows: DataFrame) -> DataFrame:
    """The same for a stream of signed changes ``(by, tok, delta)``: a token counts as long as its sum is above 0."""
    spark = rows.sparkSession
    seen = shared_path(spark, "stream-seen")
    kind = f"by {rows.schema['by'].dataType.simpleString()}, tok string, n bigint"

    def work(batch: DataFrame, folder: str, number: int) -> None:
        own = batch.groupBy("by", "tok").agg(F.sum("delta").alias("n"))
        own.write.mode("overwrite").parquet(f"{seen}/batch={number}")
        own = spark.read.schema(kind).parquet(f"{seen}/batch={number}")
        before = spark.read.schema(f"{kind}, batch bigint").parquet(seen).where(F.col("batch") < number).groupBy("by", "tok").agg(F.sum("n").alias("m"))
        now = own.join(before, ["by", "tok"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
        step = (F.col("m") + F.col("n") > 0).cast("int") - (F.col("m") > 0).cast("int")
        now.groupBy("by").agg(F.sum("n").alias("total"), F.sum(step).alias("uniq")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(folder)

    path, last = run_batches(rows, "append", work)
    schema = f"by {rows.schema['by'].dataType.simpleString()}, total bigint, uniq bigint, batch int"
    out = spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    drop_path(spark, seen)
    over = Window.partitionBy("by").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row for each batch
    return out.select("by", "batch", "total", "uniq", F.sum("total").over(over).alias("all_total"), F.sum("uniq").over(over).alias("all_uniq"))


def tumbling_counts(events: DataFrame, ts: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Extension: events of each window."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", delay)
    return rows.groupBy(F.window("__t", width).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def session_counts(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Extension: events of each session of a key. Works on tables and streams."""
    rows = events.withColumn("__t", F.col(ts).cast("timestamp"))
    return rows.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


class _Seen(StatefulProcessor):
    """Keeps the terms of a key that were there before, in the state store, and passes each on the first time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getMapState("seen", "tok string", "here boolean")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802  the interface's name
        parts = [part.sort_values(["doc", "pos"]).drop_duplicates("tok") for part in rows]  # a part is an Arrow batch
        least = pd.concat(parts).sort_values(["doc", "pos"]).drop_duplicates("tok")
        fresh = [not self._seen.containsKey((tok,)) for tok in least["tok"]]
        found = least[fresh]
        for tok in found["tok"]:
            self._seen.updateValue((tok,), (True,))
        if len(found):
            names = pd.DataFrame({"by": [key[0]] * len(found), "tok": list(found["tok"])}, dtype=object)
            yield names.assign(doc=found["doc"].to_numpy(), pos=found["pos"].to_numpy())

    def close(self) -> None:
        pass


def first_occurrences(docs: DataFrame, by: str, doc: str, text: str = "text", shards: int = 64) -> DataFrame:
    """``(by, tok, doc, pos)`` of each term's first place, for each key ``by`` (null: empty): in the batch that brings it, by least doc; ``pos`` counts the doc's different terms.

    A key's terms are dealt to ``shards`` by hash, each with a set of its own in the state store. So a batch costs what it brings, whatever came
    before, and one key fills many tasks. A term goes to its shard once a document. Null docs are left out.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the only one that keeps maps
    rows = docs.where(F.col(doc).isNotNull()).select(F.coalesce(F.col(by), F.lit("")).alias("by"), F.col(doc).cast("bigint").alias("doc"), F.posexplode(F.array_distinct(tx.tokens(F.col(text)))).alias("pos", "tok"))
    dealt = rows.select("by", F.pmod(F.xxhash64("tok"), F.lit(shards)).cast("int").alias("shard"), "tok", "doc", "pos")
    return dealt.groupBy("by", "shard").transformWithStateInPandas(_Seen(), "by string, tok string, doc bigint, pos int", "Append", "None")


def growth_by_document(docs: DataFrame, by: str, doc: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Streams of ``first_occurrences`` and of ``(by, doc, n)``, each document's number of terms: what a growth curve is the running sums of."""
    sizes = docs.where(F.col(doc).isNotNull()).select(F.coalesce(F.col(by), F.lit("")).alias("by"), F.col(doc).cast("bigint").alias("doc"), F.size(tx.tokens(F.col(text))).cast("bigint").alias("n"))
    return first_occurrences(docs, by, doc, text), sizes


def growth_curve(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(by, doc, total, uniq)``: terms and different terms of a key up to each document, from what the streams gave."""
    fresh = found.groupBy("by", "doc").agg(F.count("*").alias("fresh"))
    rows = sizes.groupBy("by", "doc").agg(F.sum("n").alias("n")).join(fresh, ["by", "doc"], "left").fillna(0, ["fresh"])
    return running_sums(rows, ["by"], "doc", {"n": "total", "fresh": "uniq"}).select("by", "doc", "total", "uniq")
