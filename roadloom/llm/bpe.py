"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.encoder import gather, tokenizer
from roadloom.llm.store import give_back, parts, rows_of, tidied

#: Bytes of text in a block; its distinct words and their ids are what a task holds at once.
BLOCK_BYTES = 24 << 20
#: Words in a part of a block; a row of places has no more.
PART_WORDS = 1 << 16
#: Ids that are written out at once.
SPELLED_IDS = 1 << 16

BLOCK = "kind string, bucket int, block long, doc_ids array<long>, places binary, sizes binary, blob binary"
ARROW = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("places", pa.binary()), ("sizes", pa.binary()), ("blob", pa.binary())])


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def _planes(values: np.ndarray) -> bytes:
    """Small integers by byte plane: the planes of zeros vanish when the shuffle compresses them."""
    return values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class _Block:
    """The documents of a block while they are read: their ids, the number of words of each, and the numbers of all words in parts
    of equal length.  The parts are counted as they fill up, and kept only where they are asked for."""

    def __init__(self, keep: bool):
        self.keep, self.ids, self.sizes, self.bytes = keep, [], [], 0
        self.found, self.count, self.parts = _Places(), np.zeros(0, np.int64), []
        self.part, self.at = np.empty(PART_WORDS, np.int32), 0

    def add(self, doc_id: int | None, body: bytes | None) -> None:
        words = body.split() if body else []
        own = np.fromiter(map(self.found.__getitem__, words), np.int32, len(words))
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.bytes += len(body or b"")
        while len(own):
            some = own[: PART_WORDS - self.at]
            self.part[self.at : self.at + len(some)] = some
            self.at += len(some)
            own = own[len(some) :]
            if self.at == PART_WORDS:
                self.close()

    def close(self) -> None:
        part, self.at = self.part[: self.at], 0
        count = np.bincount(part, minlength=len(self.found))
        count[: len(self.count)] += self.count
        self.count = count
        if self.keep:
            self.parts.append(part)
            self.part = np.empty(PART_WORDS, np.int32)


def _split(kind: str, buckets: int):
    """Cut a partition into blocks.  Kind 'words': the distinct words of a block, a row for each bucket.  Kind 'docs': the place of
    every word of a block in its list of distinct words, in rows that 'bucket' numbers; the first has the ids of the documents and the
    number of words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        number, block = TaskContext.get().partitionId() << 32, _Block(kind == "docs")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for i, body in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    block.add(i, body)
                    if block.bytes >= BLOCK_BYTES:
                        yield emit(number, block)
                        number, block = number + 1, _Block(kind == "docs")
                        give_back()
        if block.ids:
            yield emit(number, block)
            del block
            give_back()

    def emit(number: int, block: _Block) -> pa.RecordBatch:
        """The words of a block, or their places; what is no longer needed is emptied on the way."""
        block.close()
        if kind == "docs":
            block.found.clear()
        by_count = np.argsort(-block.count, kind="stable")
        if kind == "docs":
            rank = np.empty(len(by_count), np.uint32)
            rank[by_count] = np.arange(len(by_count), dtype=np.uint32)
            return places(number, block, rank)
        distinct = list(block.found)
        block.found.clear()
        distinct = [distinct[i] for i in by_count.tolist()]
        home = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % buckets
        order = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[order], np.arange(buckets + 1))
        rows = []
        for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if hi > lo:
                own = [distinct[i] for i in order[lo:hi].tolist()]
                sizes = np.fromiter(map(len, own), "<u4", len(own))
                rows.append({"kind": kind, "bucket": b, "block": number, "places": _planes(np.diff(order[lo:hi], prepend=0)), "sizes": _planes(sizes), "blob": b"".join(own)})
        return pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def places(number: int, block: _Block, rank: np.ndarray) -> pa.RecordBatch:
        """The rows share one buffer, which is written part by part."""
        parts = block.parts
        ends = 4 * np.cumsum([0, *map(len, parts)])
        raw, n = np.empty(ends[-1], np.uint8), len(parts)
        for k, (lo, hi) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            raw[lo:hi].reshape(4, -1)[:] = rank[parts[k]].astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T
            parts[k] = None
        rest = [None] * (n - 1)
        columns = [[kind] * n, range(n), [number] * n, [block.ids, *rest], None, [np.array(block.sizes, "<u4").tobytes(), *rest], [None] * n]
        arrays = [pa.array(c, f.type) if c is not None else None for c, f in zip(columns, ARROW, strict=True)]
        arrays[4] = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw)])
        return pa.RecordBatch.from_arrays(arrays, schema=ARROW)

    return run


def _encode(path: str):
    """One bucket of the table of distinct words: encode each once, and send the ids to the blocks that have it."""

    def run(table: pa.Table) -> pa.Table:
        return tidied(work, table)

    def work(table: pa.Table) -> pa.Table:
        rows, found = table.to_pylist(), _Places()
        asked = []
        for r in rows:
            blob, ends = r["blob"], np.cumsum(_unplaned(r["sizes"])).tolist()
            asked.append(np.fromiter((found[blob[a:b]] for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends)))
        words = [w.decode() for w in found]
        flat, sizes = [], []
        for at in range(0, len(words), 2000):
            got = [e.ids for e in tokenizer(path).encode_batch_fast(words[at : at + 2000], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(got), np.uint32))
            sizes += map(len, got)
        sizes = np.array(sizes, np.int64)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        starts = np.cumsum(sizes) - sizes
        out = [{"kind": "ids", "bucket": 0, "block": r["block"], "places": r["places"], "sizes": _planes(sizes[a]), "blob": _compact(gather(flat, starts, sizes, a))} for r, a in zip(rows, asked, strict=True)]
        return pa.Table.from_pylist(out, schema=ARROW)

    return run


def _compact(ids: np.ndarray) -> bytes:
    """A byte with the width, then the ids."""
    wide = len(ids) and int(ids.max()) >= 1 << 16
    return (b"\4" if wide else b"\2") + ids.astype("<u4" if wide else "<u2").tobytes()


def _loose(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint32)


def _assemble(path: str, with_ids: bool):
    """One block: put the ids of the words, and the pieces of the ids, where the words stood."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(ids: pa.Table, places: pa.Table) -> pa.Table:
        return tidied(work, ids, places)

    def work(ids: pa.Table, places: pa.Table) -> pa.Table:
        words = sum(x.as_buffer().size // 4 for x in ids.column("places"))
        sizes, starts, flat, base = np.zeros(words, np.int64), np.zeros(words, np.int64), [], 0
        for at, n, own in zip(*(ids.column(c) for c in ("places", "sizes", "blob")), strict=True):
            at, n, own = np.cumsum(_unplaned(at.as_buffer())), _unplaned(n.as_buffer()), _loose(own.as_buffer())
            sizes[at], starts[at] = n, base + np.cumsum(n) - n
            flat.append(own)
            base += len(own)
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        place, first = _in_order(places)
        piece, out, at = pieces(path), [], 0
        for doc_id, n in zip(places.column("doc_ids")[first].as_py(), np.frombuffer(places.column("sizes")[first].as_py(), "<u4").tolist(), strict=True):
            ids = gather(flat, starts, sizes, place[at : at + n])  # a word of other white space alone has no id
            at += n
            text = list(_spelled(piece, ids)) if with_ids else _spelled(piece, ids)
            said = hashlib.sha256()
            for some in text:
                said.update(some)
            out.append({"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4", copy=False)).hexdigest(), "decoded_sha256": said.hexdigest()})
            if with_ids:
                out[-1] |= {"ids": ids.astype(np.int32), "decoded": b"".join(text).decode()}
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _in_order(rows: pa.Table) -> tuple[np.ndarray, int]:
    """The places of a block's words, and which row is its first."""
    parts, raw = rows.column("bucket").to_pylist(), rows.column("places")
    order = sorted(range(len(parts)), key=parts.__getitem__)
    ends = np.cumsum([0, *(raw[i].as_buffer().size // 4 for i in order)])
    place = np.empty(ends[-1], np.uint32)
    for i, lo, hi in zip(order, ends[:-1], ends[1:], strict=True):
        place[lo:hi] = _unplaned(raw[i].as_buffer())
    return place, order[0]


def _spelled(piece: list[bytes], ids: np.ndarray) -> Iterator[bytes]:
    """The decoded text, some ids at a time."""
    for at in range(0, len(ids), SPELLED_IDS):
        text = b" ".join(map(piece.__getitem__, ids[at : at + SPELLED_IDS].tolist()))
        yield b" " + text if at else text


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """The id-to-piece table; its size is that of the vocabulary, whatever the corpus."""
    t = tokenizer(path)
    return [(t.id_to_token(i) or "").encode() for i in range(t.get_vocab_size())]


def encode(docs: DataFrame, path: str, id_col="doc_id", text_col="text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded.

    The ids are those of the tokenizers library for the whole text (null: empty) with add_special_tokens=False, and decoded is its
    decode(ids, skip_special_tokens=False), for a tokenizer without decoder that drops white space, as word_bpe_49k.json does.
    Blocks of documents are cut into words; the distinct words of all blocks meet in buckets, where each is encoded once.  The ids
    return to the blocks and are put back by position; decoding joins them with the id-to-piece table.  A word is in a bucket once
    for each block at most, however frequent.  Repeated rows and ids are rows of their own, other columns are not
    looked at, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    buckets, rows = 4 * parts(spark), rows_of(docs, id_col, text_col)
    words = rows.mapInArrow(_split("words", buckets), BLOCK).groupBy("bucket").applyInArrow(_encode(path), BLOCK)
    places = rows.mapInArrow(_split("docs", buckets), BLOCK)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"
    out = words.groupBy("block").cogroup(places.groupBy("block")).applyInArrow(_assemble(path, with_ids), schema)
    return out if with_ids else out.drop("ids", "decoded")


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the whole vocabulary."""
    return spark.createDataFrame([(i, p.decode()) for i, p in enumerate(pieces(path))], "id int, piece string")


def decode(encoded: DataFrame, path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(doc_id, decoded) of arrays of ids: a join with the id-to-piece table (bounded by the vocabulary, hence broadcast), put
    back in order.  Ids outside the vocabulary and null arrays add nothing."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"), F.monotonically_increasing_id().alias("row"))
    each = rows.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "id"))
    named = each.join(F.broadcast(piece_table(encoded.sparkSession, path)), "id", "left")
    group = named.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("p"))
    return group.select("doc_id", F.concat_ws(" ", "p.piece").alias("decoded"))
