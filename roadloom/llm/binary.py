"""Token ids in files: blocks with one id array and Elias-Fano coded document boundaries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadloom.llm.encoder import encoder
from roadloom.llm.store import parts

#: A block is closed when it has so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Every so many values the select structure remembers where the one-bit stands.
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence: the low bits of each value as they are, the high bits in unary; about 2 + log2(u / n) bits a value."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        width = max(0, int(v[-1]).bit_length() - n.bit_length()) if n else 0
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        low = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        return cls(n, width, np.packbits(low.astype(np.uint8), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The ``i``-th value, from the nearest sample before it."""
        high = np.frombuffer(self.high, np.uint8)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        word = high[byte] & (0xFF << (at & 7) & 0xFF)
        while (ones := int(word).bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = high[byte]
        bits = np.flatnonzero(np.unpackbits(np.uint8(word), bitorder="little"))
        return ((byte * 8 + int(bits[left]) - i) << self.width) | self._low(i, i + 1)[0]

    def _low(self, lo: int, hi: int) -> list[int]:
        if not self.width:
            return [0] * (hi - lo)
        first, last = lo * self.width, hi * self.width
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
        return (bits.reshape(-1, self.width).astype(np.int64) << np.arange(self.width)).sum(1).tolist()

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.width) + np.array(self._low(0, self.n), np.int64)


FORMAT = "part int, block int, first long, n_docs long, doc_ids array<long>, n_ids long, id_bytes int, ids binary, width int, low binary, high binary, samples binary"
ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col="doc_id", text_col="text") -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the ids to ``path`` in ascending order of the id.

    A file row is a block: the ids of whole documents as one little-endian array (two bytes an id where the vocabulary allows it),
    Elias-Fano coded boundaries, and the number of ids before it in its part.  Blocks are numbered by (part, block) in order; parts are ranges of the id.
    Null ids come first; rows that share an id follow each other in order of their text.  Other columns are not looked
    at; an empty table writes files without rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text").alias("tie")
    rows = rows.repartitionByRange(4 * parts(spark), "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, ids, held, n = TaskContext.get().partitionId(), 0, 0, [], [], 0
        enc = encoder(vocabulary)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"

        def packed():
            ef = EliasFano.of(np.cumsum([len(x) for x in held]))
            flat = np.concatenate(held).astype(kind)
            row = {"part": part, "block": block, "first": first, "n_docs": len(ids), "doc_ids": ids, "n_ids": len(flat), "id_bytes": flat.itemsize, "ids": flat.tobytes(), "width": ef.width, "low": ef.low, "high": ef.high, "samples": ef.samples}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, got in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist()), strict=True):
                    if held and n + len(got) + 1 > BLOCK_IDS:
                        yield packed()
                        block, first, ids, held, n = block + 1, first + n, [], [], 0
                    ids.append(doc_id)
                    held.append(np.append(got, np.uint32(end_id)))
                    n += len(got) + 1
        if held:
            yield packed()

    rows.mapInArrow(run, FORMAT).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files, in any order; ids are little-endian unsigned
    32-bit integers, and ids_crc32 is their checksum.  Without ``with_ids`` the ids stay in the task.

    start counts the ids of all documents before it.  A block knows its place in its part; what is summed in one window and
    broadcast is one number for each part that ``write`` made, whatever the input.
    """
    blocks = spark.read.schema(FORMAT).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = EliasFano(r["n_docs"], r["width"], r["low"], r["high"], r["samples"]).all()
                starts = np.append(0, ends[:-1])
                ids = np.frombuffer(r["ids"], f"<u{r['id_bytes']}").astype("<u4")
                raw = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["before"] + r["first"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.join(F.broadcast(before), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
