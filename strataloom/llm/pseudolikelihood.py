"""Language-model scoring by masked pseudo-likelihood.

Tokens are words (runs of letters, marks and digits), single other marks, and single characters
of scripts written without blanks. The most frequent words of the whole corpus are tokens of
their own; every other word is one of ``hashed`` tokens, by its hash, so that rare words and other
scripts stay apart. Every token is predicted from the two before and the two after it by a small
network: their embeddings, a hidden layer, then a softmax over classes of tokens and one over
the tokens of the class. The product sums to 1 over all tokens, so scores are exact conditional
log-probabilities, and a document's score is their sum.

All documents train it. Words are counted over the whole corpus, within batches first; the
counts choose the vocabulary and start the output biases. Then each document's tokens are cut
into chunks, dealt by a hash to slices of about ``slice_tokens`` and to rounds; a slice's part of a
round is one row of a written table. The number of slices follows the number of tokens, so
training never depends on partitions, executors or their number. In each round every slice takes
Adam steps in numpy from the common weights, and the results are averaged by tokens: as integers,
whose sums are the same in any order. The driver gets one row for each block of weights, whose
size depends neither on the corpus nor on its vocabulary. A last pass scores every document.

Defined results: null, empty and blank texts have no tokens, a sum of 0 and no mean (null); very
long texts are read whole, in as many chunks as they take; equal texts train as
often as they stand, by a weight; of words of equal counts the
first in byte order are tokens; without any token the network keeps its first weights; an empty
table gives no rows; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import arrow_rows, bounded_batches, gathered, map_texts, texts
from strataloom.session import materialize, shared_path

WINDOW = 2
#: What stands alone: any character that is no letter, mark, digit or blank, and letters of scripts without blanks between words.
_ALONE = r"([^\p{L}\p{N}\p{M}\s]|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: Words of more bytes are never tokens of their own.
_LONGEST = 64
_CHUNK = 4096
_SCALE = 1 << 24
_UNIT = 1024


_POWERS = np.cumprod(np.full(1 << 12, 0x9E3779B97F4A7C15, np.uint64))


def hashes(found: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of each word, over its UTF-8 bytes; of longer words the powers come round again."""
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    if data is None or not len(found):
        return np.zeros(len(found), np.uint64)
    size = np.diff(ends)
    place = np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)
    value = (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)) * _POWERS[place % len(_POWERS)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
    out = sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def words(column: pa.Array) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The different words of all texts, the number of each word where it stands, and how many words each text has; null is empty."""
    try:
        column.validate(full=True)
        column = pc.fill_null(column, "")
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        column = pa.array(texts(column), pa.string())
    lists = pc.utf8_split_whitespace(pc.replace_substring_regex(column, _ALONE, r" \1 "))
    ends = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values[ends[0] : ends[-1]].dictionary_encode()
    at, different = coded.indices.to_numpy(), coded.dictionary
    some = at != pc.index(different, "").as_py()  # blanks at a text's ends leave empty words
    before = np.concatenate(([0], np.cumsum(some)))
    return different, at[some], np.diff(before[ends - ends[0]])


@dataclass
class Vocabulary:
    """Known words, numbered by falling count, then ``hashed`` numbers for all others."""

    known: pa.Array
    hashed: int
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.counts)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts, and how many each text has."""
        different, at, sizes = words(column)
        number = pc.index_in(different, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        other = len(self.known) + (hashes(different) % np.uint64(self.hashed)).astype(np.int64)
        return np.where(number < 0, other, number).astype(np.uint16)[at], sizes


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, n, hash)`` over all documents."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("word").aggregate([("n", "sum"), ("hash", "min")]).rename_columns(["word", "n", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in gathered(batches, text_col):
            different, at, _ = words(batch.column(0))
            held.append(pa.table({"word": different, "n": np.bincount(at, minlength=len(different)), "hash": hashes(different).view(np.int64)}).filter(pc.field("n") > 0))
            rows += held[-1].num_rows
            if rows > 1 << 20:
                held = [summed(held)]
                rows = held[0].num_rows
                if rows > 1 << 19:
                    yield from held[0].to_batches(1 << 14)
                    held, rows = [], 0
        if held:
            yield from summed(held).to_batches(1 << 14)

    return bounded_batches(docs).select(text_col).mapInArrow(run, "word string, n bigint, hash bigint").groupBy("word").agg(F.sum("n").alias("n"), F.min("hash").alias("hash"))


def vocabulary(counted: DataFrame, size: int = 2048, hashed: int = 512) -> Vocabulary:
    """The ``size - hashed`` most frequent words of ``(word, n, hash)``; the driver gets ``size`` rows."""
    if hashed & (hashed - 1) or size > 0xFFFF:
        raise ValueError("hashed is a power of two, size below 65,536")
    bucket = F.pmod("hash", F.lit(hashed)).cast("int")
    held = counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect()
    best = counted.where(F.octet_length("word") <= _LONGEST).orderBy(F.desc("n"), "word").limit(size - hashed).collect()
    counts = np.zeros(size, np.int64)
    for k, r in enumerate(best):
        counts[k] = r.n
    others = np.zeros(hashed, np.int64)
    for r in held:
        others[r.bucket] = r.n
    for r in best:
        others[r.hash % hashed] -= r.n
    counts[len(best) : len(best) + hashed] = others
    return Vocabulary(pa.array([r.word for r in best], pa.string()), hashed, counts)


class Network:
    """Weights: embeddings; hidden layer; classes; the tokens of each class. The last row of each layer is its bias."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def begin(cls, counts: np.ndarray, classes: int = 32, width: int = 8, hidden: int = 24, seed: int = 7) -> Network:
        """Random weights; the biases give every token its share of ``counts``."""
        draw = np.random.default_rng(seed)
        each = -(-len(counts) // classes)
        share = np.zeros(classes * each) + 0.5
        share[: len(counts)] += counts
        share = share.reshape(classes, each)
        total = share.sum(axis=1)
        normal = lambda scale, *shape: draw.standard_normal(shape) * scale
        embed, w1 = normal(0.5, classes * each + 1, width), normal((2 * WINDOW * width) ** -0.5, 2 * WINDOW * width + 1, hidden)
        w2, w3 = (normal(0.1 * hidden**-0.5, *shape) for shape in ((hidden + 1, classes), (classes, hidden + 1, each)))
        w1[-1], w2[-1], w3[:, -1] = 0, np.log(total / total.sum()), np.log(share / total[:, None])
        return cls([w.astype(np.float32) for w in (embed, w1, w2, w3)])

    @property
    def border(self) -> int:
        """The number that stands before and after a text."""
        return len(self.weights[0]) - 1

    @staticmethod
    def _exp(z: np.ndarray, layer: np.ndarray) -> np.ndarray | float:
        """Exponentials in place; what was taken off each row before, which is nothing as long as no value can overflow (inputs are at most 1)."""
        top = 0.0
        if np.abs(layer).sum(axis=-2).max() > 80:
            top = z.max(axis=1)
            z -= top[:, None]
        np.exp(z, out=z)
        return top

    def _forward(self, context: np.ndarray, token: np.ndarray):
        """Windows are taken in order of their token's class, which ``order`` gives."""
        embed, w1, w2, w3 = self.weights
        classes, _, each = w3.shape
        order = np.argsort((token // each).astype(np.uint16), kind="stable")
        context, token = context[order], token[order]
        kind, place = np.divmod(token, each)
        ends = np.searchsorted(kind, np.arange(classes + 1))
        rows = np.arange(len(token))
        x = np.ones((len(token), len(w1)), embed.dtype)
        x[:, :-1] = embed[context].reshape(len(token), -1)
        h = np.ones((len(token), len(w2)), embed.dtype)
        np.tanh(x @ w1, out=h[:, :-1])
        e = h @ w2
        log = e[rows, kind]
        log -= self._exp(e, w2)
        total = e.sum(axis=1)
        inner = np.empty((len(token), each), e.dtype)
        for k in range(classes):
            a, b = ends[k], ends[k + 1]
            if a < b:
                np.matmul(h[a:b], w3[k], out=inner[a:b])
        log += inner[rows, place]
        log -= self._exp(inner, w3)
        inner_total = inner.sum(axis=1)
        log -= np.log(total * inner_total)
        return order, context, kind, place, ends, x, h, e, total, inner, inner_total, log

    def log_probability(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given its context."""
        out = np.zeros(len(token))
        for at in range(0, len(token), 1 << 12):
            found = self._forward(context[at : at + (1 << 12)], token[at : at + (1 << 12)])
            out[at + found[0]] = found[-1]
        return out

    def gradient(self, context: np.ndarray, token: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss, each window weighted by ``n``."""
        embed, w1, w2, w3 = self.weights
        order, context, kind, place, ends, x, h, e, total, inner, inner_total, _ = self._forward(context, token)
        share = (n[order] / n.sum()).astype(embed.dtype)
        rows = np.arange(len(kind))
        e *= (share / total)[:, None]
        e[rows, kind] -= share
        inner *= (share / inner_total)[:, None]
        inner[rows, place] -= share
        dh, d3 = e @ w2.T, np.zeros_like(w3)
        for k in range(len(w3)):
            a, b = ends[k], ends[k + 1]
            if a < b:
                np.matmul(h[a:b].T, inner[a:b], out=d3[k])
                dh[a:b] += inner[a:b] @ w3[k].T
        d2 = h.T @ e
        dh, h = dh[:, :-1], h[:, :-1]
        dh = dh * (1 - h * h)
        dx = (dh @ w1[:-1].T).reshape(-1, embed.shape[1])
        flat = context.reshape(-1)
        de = np.stack([np.bincount(flat, dx[:, k], len(embed)) for k in range(dx.shape[1])], axis=1).astype(embed.dtype)
        return [de, x.T @ dh, d2, d3]

    def fit(self, context: np.ndarray, token: np.ndarray, n: np.ndarray, rate: float, batch: int = 4096) -> None:
        """One pass of Adam over the windows, neighbours in different batches of ``batch`` at most; slopes far below 1e-5 hardly count, so the last bits of sums do not spread."""
        mean, square = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
        steps = -(-len(token) // batch)
        for step in range(1, steps + 1):
            own = slice(step - 1, None, steps)
            for w, g, m, v in zip(self.weights, self.gradient(context[own], token[own], n[own]), mean, square, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in self.weights])

    def filled(self, flat: np.ndarray) -> Network:
        at, out = 0, []
        for w in self.weights:
            out.append(flat[at : at + w.size].reshape(w.shape).astype(w.dtype))
            at += w.size
        return Network(out)


def windows(ids: np.ndarray, sizes: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and tokens of texts that stand one after the other in ``ids``."""
    n = len(ids)
    padded = np.full(n + WINDOW * (len(sizes) + 1), border, np.int32)
    at = np.arange(n) + np.repeat(WINDOW * np.arange(1, len(sizes) + 1), sizes)
    padded[at] = ids
    return _around(padded, at)


def _around(padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    context = np.empty((len(at), 2 * WINDOW), np.int32)
    for column, k in enumerate(k for k in range(-WINDOW, WINDOW + 1) if k):
        context[:, column] = padded[at + k]
    return context, padded[at]


def chunks(docs: DataFrame, known: Vocabulary, text_col: str = "text") -> DataFrame:
    """``(key, ids, n)``: the tokens of all documents in chunks, with ``WINDOW`` more on either side, and how often each stands.

    Equal texts have equal chunks, of which one stays with their number: a group of copies is no hot key.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text"):
            ids, sizes = sent.value.encode(batch.column(1))
            border = np.full(WINDOW, 0xFFFF, np.uint16)
            keys, parts, at = [], [], 0
            for key, size in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                own = np.concatenate((border, ids[at : at + size], border))
                at += size
                for k, start in enumerate(range(0, size, _CHUNK)):
                    keys.append(key ^ k * 0x9E3779B97F4A7 if k else key)
                    parts.append(own[start : min(start + _CHUNK, size) + 2 * WINDOW].astype("<u2").tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["key", "ids"])

    rows = bounded_batches(docs).select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "key bigint, ids binary").groupBy("key", "ids").agg(F.count("*").alias("n"))


def dealt(parts: DataFrame, slices: int, rounds: int) -> DataFrame:
    """``(round, slice, held)``: one row for each slice's part of a round, its chunks in a fixed order."""
    cut = parts.withColumn("slice", F.pmod(F.xxhash64("key", F.lit("slice")), F.lit(slices))).withColumn("round", F.pmod(F.xxhash64("key", F.lit("round")), F.lit(rounds)).cast("int"))
    return cut.groupBy("round", "slice").agg(F.sort_array(F.collect_list(F.struct("key", "ids", "n"))).alias("held"))


def _windows_of(parts: list[np.ndarray], n: list[int], border: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of chunks, each of which brings its own context, and their weights."""
    sizes = np.array([len(p) - 2 * WINDOW for p in parts])
    whole = np.concatenate(parts).astype(np.int32)
    whole[whole == 0xFFFF] = border
    at = np.arange(sizes.sum()) + np.repeat(WINDOW * (2 * np.arange(len(parts)) + 1), sizes)
    return *_around(whole, at), np.repeat(np.array(n, np.float64), sizes)


def train(groups: DataFrame, network: Network, rounds: int, rate: float = 0.02, blocks: int = 16) -> Network:
    """Fit to the rows of ``dealt`` by rounds of local steps in every slice and averaging."""
    spark = groups.sparkSession
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(network)
        step = rate / (1 + k / 2)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, step=step) -> Iterator[pa.RecordBatch]:
            start, total, units = sent.value, None, 0
            for batch in batches:
                for held in batch.column(0):
                    rows = held.values
                    parts = [np.frombuffer(x, "<u2") for x in rows.field("ids").to_pylist()]
                    context, token, n = _windows_of(parts, rows.field("n").to_pylist(), start.border)
                    own = start.filled(start.flat())
                    own.fit(context, token, n, step)
                    weight = -(-int(n.sum()) // _UNIT)
                    flat = np.rint(own.flat().astype(np.float64) * _SCALE).astype(np.int64) * weight
                    total, units = flat if total is None else total + flat, units + weight
            if total is not None:
                cut = np.array_split(total, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in cut], pa.binary()), pa.array([units] * blocks, pa.int64())], ["block", "sums", "units"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, list] = {}
            for batch in batches:
                for block, sums, units in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = totals.setdefault(block, [0, 0])
                    own[0], own[1] = own[0] + np.frombuffer(sums, "<i8"), own[1] + units
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array([*totals], pa.int32()), pa.array([s.astype("<i8").tobytes() for s, _ in totals.values()], pa.binary()), pa.array([u for _, u in totals.values()], pa.int64())], ["block", "sums", "units"])

        schema = "block int, sums binary, units bigint"
        with arrow_rows(spark, 16):
            trained = groups.where(F.col("round") == k).select("held").mapInArrow(run, schema)
            rows = sorted(trained.repartition(blocks, "block").mapInArrow(summed, schema).collect())  # one row for each block
        if rows:
            network = network.filled(np.concatenate([np.frombuffer(r.sums, "<i8") / (r.units * _SCALE) for r in rows]))
    return network


def fit(docs: DataFrame, rounds: int = 8, slice_tokens: int = 1 << 21, size: int = 2048, hashed: int = 512, rate: float = 0.02, text_col: str = "text") -> tuple[Vocabulary, Network]:
    """Vocabulary and network of all of ``docs``."""
    counted = materialize(count_words(docs, text_col), "pll-words")
    known = vocabulary(counted, size, hashed)
    slices = max(1, round(int(known.counts.sum()) / slice_tokens))
    groups = dealt(chunks(docs, known, text_col), slices, rounds)
    path = shared_path(docs.sparkSession, "pll-chunks")
    groups.write.partitionBy("round").parquet(path)  # a round reads its own folder
    groups = docs.sparkSession.read.schema(groups.schema).parquet(path)
    return known, train(groups, Network.begin(known.counts), rounds, rate)


def score(docs: DataFrame, known: Vocabulary, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, pll, pll_mean)``: the summed log-probability of each document and its mean by token."""
    sent = docs.sparkSession.sparkContext.broadcast((known, network))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        known, network = sent.value
        ids, sizes = known.encode(batch.column(1))
        logs = network.log_probability(*windows(ids, sizes, network.border))
        ends = np.concatenate(([0], np.cumsum(logs)))[np.cumsum(sizes)]
        sums = np.diff(ends, prepend=0.0).round(4)
        means = np.round(sums / np.maximum(sizes, 1), 6)
        return {"doc_id": batch.column(0), "n_tokens": pa.array(sizes), "pll": pa.array(sums), "pll_mean": pa.array(means, mask=sizes == 0)}

    return map_texts(docs, [id_col, text_col], text_col, f"doc_id {kind}, n_tokens bigint, pll double, pll_mean double", work)


def fit_and_score(docs: DataFrame, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, train and score over all of ``docs``."""
    known, network = fit(docs, rounds, text_col=text_col)
    return score(docs, known, network, id_col, text_col)
