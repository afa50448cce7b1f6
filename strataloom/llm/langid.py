"""Language identification by nearest centroid.

A text's vector holds the counts of its letter n-grams (one to three letters, word borders
included), hashed to ``size`` places, damped by a logarithm, weighted by inverse document
frequency and brought to length 1. Each language has several centroids, found by spherical
k-means within its training rows. A text gets the language of the centroid of highest cosine.
It is rejected if that cosine lies below what texts of that length reach with a language that is not
theirs: a low quantile of the cosines of training rows, thinned to that many n-grams, to the nearest
centroid of another language. The rows' own cosines would not do, since a corpus lies far nearer to its own centroids
than other prose in its languages; and how near two languages are hardly changes with the sample.

The classifier is fitted on a bounded sample: at most ``per_language`` rows of each language,
those of least hash of doc_id. Only their hashed counts go to the driver. Everything else runs
over all rows, and a text, however long, is read whole.

Defined results: a null text and one without a letter is ``und`` with score 0 and rejected;
ties go to the first language in alphabetical order; repeated rows repeat; without training
rows every text is ``und``; with rows of one language only texts without a letter are rejected; an empty table gives no rows; a null doc_id counts as an empty
string in the split; other columns are not read, but ``keep_known`` returns them as they are.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import keep_rows, map_texts, texts

UNKNOWN = "und"
#: lengths with a bound of their own: a power of two n-grams up to the next
LEVELS = 16
#: share of rows that lie further than the bound from every other language
LOW = 0.03
#: fewer rows than this have no low quantile: longer texts take the bound of the level below
FEW = 20


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for all but letters, a 0 at either end."""
    codes = np.frombuffer(f"\0{text.lower()}\0".encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(_is_letter()[codes], codes, 0).astype(np.uint32)


def counts(batch: list[str], size: int) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    out = np.zeros((len(batch), size), np.float32)
    mask = np.uint32(size - 1)
    for begin in range(0, len(batch), 64):
        rows = [_letters(t) for t in batch[begin : begin + 64]]
        codes = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows), dtype=np.int64) * size, [len(r) for r in rows])
        letter = codes > 0
        one = codes * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ codes[1:]) * np.uint32(0x85EBCA6B)
        three = (two[:-1] ^ codes[2:]) * np.uint32(0xC2B2AE35)
        found = []
        for hashed, use in ((one, letter), (two, letter[:-1] | letter[1:]), (three, letter[1:-1])):
            at = np.flatnonzero(use)
            h = hashed[at]
            found.append(row[at] + ((h ^ (h >> np.uint32(15))) & mask))
        out[begin : begin + len(rows)] = np.bincount(np.concatenate(found), minlength=len(rows) * size).reshape(len(rows), size)
    return out


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    bounds: np.ndarray

    def vectors(self, found: np.ndarray) -> np.ndarray:
        x = np.log1p(found) * self.weights
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores from 0 to 1, and whether each text is rejected."""
        names, scores, rejected = [], np.zeros(len(batch)), np.ones(len(batch), bool)
        for begin in range(0, len(batch), 256):
            found = counts(batch[begin : begin + 256], len(self.weights))
            some = found.any(axis=1)
            if not len(self.owner):
                names += [UNKNOWN] * len(found)
                continue
            cosine = self.vectors(found) @ self.centroids.T
            best = cosine.argmax(axis=1)
            score = np.where(some, np.clip(cosine.max(axis=1), 0, 1), 0)
            names += [self.languages[self.owner[b]] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
            scores[begin : begin + len(found)] = score
            rejected[begin : begin + len(found)] = ~some | (score < self.bounds[level(found)])
        return names, scores, rejected


def level(found: np.ndarray) -> np.ndarray:
    """The place in bounds for each row's number of n-grams."""
    return np.log2(np.clip(found.sum(axis=1, dtype=np.float64), 1, 1 << (LEVELS - 1))).astype(int)


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one starts at the row furthest from all."""
    centres = x.mean(axis=0, keepdims=True)
    centres /= np.maximum(np.linalg.norm(centres), 1e-12)
    for _ in range(min(k, len(x)) - 1):
        centres = np.vstack((centres, x[(x @ centres.T).max(axis=1).argmin()]))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = x[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def train(found: np.ndarray, labels: list[str], clusters: int = 3) -> Model:
    languages = sorted(set(labels))
    seen = (found > 0).sum(axis=0)
    model = Model(languages, (np.log((1 + len(found)) / (1 + seen)) + 1).astype(np.float32), np.zeros((0, found.shape[1]), np.float32), np.zeros(0, np.int64), np.zeros(LEVELS))
    if not len(found):
        return model
    x = model.vectors(found)
    label = np.array([languages.index(name) for name in labels])
    for k in range(len(languages)):
        centres = _cluster(x[label == k], clusters)
        model.centroids = np.vstack((model.centroids, centres.astype(np.float32)))
        model.owner = np.concatenate((model.owner, np.full(len(centres), k)))
    if len(languages) > 1:
        model.bounds = _between(model, found, label)
    return model


def _between(model: Model, found: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each level the ``LOW`` quantile of the rows' cosines to the nearest other language, thinned to the least length of the level."""
    draw, total, out = np.random.default_rng(0), found.sum(axis=1), np.zeros(LEVELS)
    for k in range(LEVELS):
        cosines = []
        for begin in range(0, len(found), 256):
            at = begin + np.flatnonzero(total[begin : begin + 256] >= 1 << k)
            row, place = np.nonzero(found[at])
            held = found[at[row], place].astype(np.int64)
            thin = np.zeros((len(at), found.shape[1]), np.float32)
            thin[row, place] = draw.binomial(held, (1 << k) / total[at[row]])
            cosine = np.where(model.owner == label[at][:, None], -1, model.vectors(thin) @ model.centroids.T).max(axis=1, initial=-1)
            cosines.append(cosine[thin.any(axis=1)])
        cosines = np.concatenate(cosines)
        out[k] = np.quantile(cosines, LOW) if len(cosines) >= FEW else out[max(k, 1) - 1]
    return out


def held_out(doc_id: Column) -> Column:
    """Is crc32(doc_id as text) divisible by 5?"""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, per_language: int = 300, size: int = 16384, clusters: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on at most ``per_language`` rows of each language, none of them held out."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(F.col(id_col)))
    totals = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    if not totals:
        return train(np.zeros((0, size), np.float32), [], clusters)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1 << 40))
    # a quarter more than wanted, of which the least are taken
    limits = {name: int(min(1.0, 1.25 * per_language / n + 20 / n) * (1 << 40)) for name, n in totals.items()}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col(lang_col)]
    sample = rows.where(draw < limit).select(draw.alias("draw"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        found = counts(texts(batch.column(2)), size)
        at = [np.flatnonzero(r) for r in found]
        return {
            "draw": batch.column(0),
            "lang": batch.column(1),
            "places": pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
            "counts": pa.array([r[a] for r, a in zip(found, at, strict=True)], pa.list_(pa.float32())),
        }

    drawn = map_texts(sample, ["draw", "lang", "text"], "text", "draw bigint, lang string, places array<int>, counts array<float>", work, 1 << 18).collect()
    drawn.sort(key=lambda r: (r.lang, r.draw, r.places, r.counts))
    left, kept = dict.fromkeys(totals, per_language), []
    for r in drawn:
        if left[r.lang]:
            left[r.lang] -= 1
            kept.append(r)
    found = np.zeros((len(kept), size), np.float32)
    for row, r in zip(found, kept, strict=True):
        row[r.places] = r.counts
    some = found.any(axis=1)
    return train(found[some], [r.lang for r, s in zip(kept, some, strict=True) if s], clusters)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``; of a row only its text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> dict:
        names, scores, rejected = sent.value.predict(texts(batch.column(2)))
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores.astype(float)), "rejected": pa.array(rejected)}

    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("__held_out"), F.col(text_col))
    return map_texts(rows, [id_col, "__held_out", text_col], text_col, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean", work, 1 << 20)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not reject."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    return keep_rows(docs, text_col, lambda batch: ~sent.value.predict(texts(batch.column(at)))[2], 1 << 20)
