"""Token ids in bit-packed files: fixed width, blocks at known offsets, random access.

A file holds the documents of one ascending range of doc_id. Its layout, all numbers
little-endian: an 8-byte magic; seven 64-bit numbers (bits per id, ids per block, documents,
ids, blocks, bytes of the document index, bytes of the block offsets); the document index
(doc_id, a null flag and the number of ids of each document, as 64-bit columns); the byte
offset of each block from the first one; the blocks. Every id takes the minimum bits of the
vocabulary, and a block packs ids from the lowest bit up, padded to whole 64-bit words.

Executors write each file under a temporary name in the shared folder and rename it, so a task
that runs again overwrites its own file with the same bytes. Only one row for each file goes
to the driver: its name and counts, from which the running starts are summed.

Defined results: null and empty texts hold the end id alone; repeated rows stay, in order of
doc_id, then hash of the text, then text; null doc_ids come first and doc_ids are longs; a very
long text is encoded whole and may span blocks, never files; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import bounded_batches, gathered, texts
from strataloom.llm.pretokens import PieceMemory
from strataloom.session import shared_path

MAGIC = b"TOKPACK1"
_HEAD = struct.Struct("<8s7q")


def min_bits(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` each; every 64 of them fill exactly ``bits`` words of 64 bits."""
    rows = -(-len(ids) // 64)
    padded = np.zeros(rows * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes = padded.reshape(rows, 64).T  # lanes[k, r] is id 64 * r + k
    words = np.zeros((bits, rows), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        words[word] |= lanes[k] << np.uint64(shift)
        if shift + bits > 64:
            words[word + 1] |= lanes[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The inverse of ``pack``."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits).T
    lanes = np.empty((words.shape[1], 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = words[word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[:, k] = value & mask
    return lanes.reshape(-1)[:count]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    if path.startswith(("s3a://", "s3n://")):  # what Spark calls them; pyarrow knows one name
        path = "s3" + path[3:]
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{os.path.abspath(path)}")


class Writer:
    """Gathers the documents of one file; ``close`` writes it."""

    def __init__(self, bits: int, block: int = 1 << 16):
        if block % 64:
            raise ValueError("a block holds a multiple of 64 ids")
        self.bits, self.block = bits, block
        self.docs: list[int] = []
        self.nulls: list[int] = []
        self.counts: list[int] = []
        self.blocks: list[bytes] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, stop, self.block):
            self.blocks.append(pack(ids[at : min(at + self.block, stop)], self.bits))
        self.waiting, self.n_waiting = ([ids[stop:]], len(ids) - stop) if stop < len(ids) else ([], 0)

    def close(self, path: str) -> tuple[int, int]:
        """Write the file; the numbers of documents and ids."""
        self._flush(True)
        index = np.array([self.docs, self.nulls, self.counts], "<i8").tobytes()
        offsets = np.cumsum([0] + [len(b) for b in self.blocks]).astype("<i8").tobytes()
        ids = sum(self.counts)
        where, name = _open(path)
        where.create_dir(os.path.dirname(name), recursive=True)
        part = f"{name}.{os.getpid()}-{os.urandom(4).hex()}.part"
        with where.open_output_stream(part) as out:
            out.write(_HEAD.pack(MAGIC, self.bits, self.block, len(self.docs), ids, len(self.blocks), len(index), len(offsets)))
            for data in (index, offsets, *self.blocks):
                out.write(data)
        where.move(part, name)
        return len(self.docs), ids


class Reader:
    """Random access to one file."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.file = where.open_input_file(name)
        magic, self.bits, self.block, n_docs, self.n_ids, self.n_blocks, index, offsets = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.docs, self.nulls, self.counts = np.frombuffer(self._at(_HEAD.size, index), "<i8").reshape(3, n_docs)
        self.offsets = np.frombuffer(self._at(_HEAD.size + index, offsets), "<i8")
        self.base = _HEAD.size + index + offsets
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def read(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from the file's ``start``-th on; only their blocks are read."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        data = self._at(self.base + int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        have = min((last + 1) * self.block, self.n_ids) - first * self.block
        ids = unpack(data, self.bits, have)  # every block but the file's last fills its words exactly
        return ids[start - first * self.block :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.counts[k]))

    def close(self) -> None:
        self.file.close()


class _Tokenizer:
    """The tokenizers library on one vocabulary file, asked once for each remembered piece of text."""

    def __init__(self, path: str, remembered: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.length = np.zeros(self.size, np.int64)
        for token, k in self.whole.get_vocab(with_added_tokens=True).items():
            self.length[k] = len(token)  # in the byte alphabet a character is a byte
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces = PieceMemory(self._pieces, remembered)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # pieces that start with a blank follow each other without a change to how they are split
        flat, counts = [], []
        for some in itertools.batched(pieces, 1 << 14):
            ids = self._ids("".join(some))
            sizes = np.array([len(p) if p.isascii() else len(p.encode()) for p in some], np.int64)
            ends = np.searchsorted(np.cumsum(self.length[ids]), np.cumsum(sizes)) + 1
            flat.append(ids)
            counts.append(np.diff(ends, prepend=0))
        return np.concatenate(flat), np.concatenate(counts)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of ``column``, without special tokens of its own accord; null is empty."""
        try:
            column.validate(full=True)
            column = pc.fill_null(column, "")
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            column = pa.array(texts(column), pa.string())
        whole = np.zeros(len(column), bool)  # the library cuts special tokens out first
        for s in self.special:
            whole |= pc.match_substring(column, s).to_numpy(zero_copy_only=False)
        flat, ends, unsafe = self.pieces.encode(pc.if_else(pa.array(whole), "", column))
        begins = np.concatenate(([0], ends))[:-1]
        whole |= unsafe
        return [self._ids(column[k].as_py()) if w else flat[a:b] for k, (a, b, w) in enumerate(zip(begins.tolist(), ends.tolist(), whole.tolist(), strict=True))]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> _Tokenizer:
    """The tokenizer of a file, made once in each process."""
    return _Tokenizer(path)


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None, files: int | None = None, block: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Write all documents to files in ``folder`` by ascending id; ``(file, documents, ids)`` of each in order."""
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col(id_col).asc_nulls_first(), F.xxhash64(text_col).asc())  # the same within files as between them
    ranged = docs.select(id_col, text_col).repartitionByRange(files, *order).sortWithinPartitions(*order, F.col(text_col).asc_nulls_first())
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        writer = Writer(min_bits(max(own.size, (end_id or 0) + 1)), block)
        part = None
        for batch in gathered(batches, text_col):
            part = batch.column(2)[0].as_py()
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                writer.add(doc_id, np.concatenate((ids, tail)))
        if part is not None:
            name = f"{folder}/part-{part:06d}.tok"
            n_docs, n_ids = writer.close(name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], ["part", "file", "n_docs", "n_ids"])

    rows = bounded_batches(ranged).mapInArrow(run, "part int, file string, n_docs bigint, n_ids bigint").collect()  # a row for each file
    return [(r.file, r.n_docs, r.n_ids) for r in sorted(rows)]


def read(spark, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files of ``write``."""
    rows, start = [], 0
    for file, _, n_ids in manifest:
        rows.append((file, start))
        start += n_ids
    named = spark.createDataFrame(rows, "file string, start bigint").repartition(max(1, len(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = Reader(file)
                at = 0
                while at < len(source.docs):  # some documents at a time, as many as hold about a million ids
                    stop = max(at + 1, int(np.searchsorted(source.starts, source.starts[at] + (1 << 20), side="right")) - 1)
                    first = int(source.starts[at])
                    ids = source.read(first, int(source.starts[stop]) - first).astype("<u4")
                    ends = source.starts[at : stop + 1] - first
                    crcs = [zlib.crc32(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(source.docs[at:stop], mask=source.nulls[at:stop].astype(bool)), pa.array(begin + source.starts[at:stop]), pa.array(source.counts[at:stop]), pa.array(crcs, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = stop
                source.close()

    return named.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def pack_and_read(docs: DataFrame, path: str, end_id: int | None = None, files: int | None = None) -> DataFrame:
    """Write all documents' ids to the shared folder and return what reading the files gives."""
    spark = docs.sparkSession
    return read(spark, write(docs, path, shared_path(spark, "tokens"), end_id, files))
