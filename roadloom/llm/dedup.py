"""Exact copies, found by full comparison in Patricia tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.llm.store import WHITE, give_back, parts, stored

#: Bytes of text that the tries of a task hold; beyond it the largest subtree is handed on and freed.
TRIE_BYTES = 64 << 20


class Trie:
    """A compressed radix trie over byte strings.  A node is [label, children by first byte, owner or None]."""

    def __init__(self):
        self.root, self.held = [b"", {}, None], {}

    def owner(self, key: bytes) -> list:
        """The terminal node's owner record, an empty list when the key is new."""
        node, i = self.root, 0
        while i < len(key):
            child = node[1].get(key[i])
            if child is None:
                leaf = [key[i:], {}, None]
                node[1][key[i]] = leaf
                self.held[key[0]] = self.held.get(key[0], 0) + len(key) - i + 200
                node, i = leaf, len(key)
                break
            if not key.startswith(child[0], i):
                child = self._split(node, child, key, i)
            node, i = child, i + len(child[0])
        if node[2] is None:
            node[2] = []
        return node[2]

    @staticmethod
    def _split(node, child, key, i):
        lo, hi = 1, min(len(child[0]), len(key) - i)  # the first byte is equal
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if key.startswith(child[0][:mid], i) else (lo, mid - 1)
        upper = [child[0][:lo], {child[0][lo]: child}, None]
        child[0] = child[0][lo:]
        node[1][key[i]] = upper
        return upper

    def take(self, first: int | None = None) -> Iterator[tuple[bytes, list]]:
        """Hand over and free a subtree of the root, or everything."""
        for byte in [first] if first is not None else list(self.root[1]):
            todo = [(b"", self.root[1].pop(byte))]
            self.held.pop(byte, None)
            while todo:
                above, (label, children, owner) = todo.pop()
                if owner is not None:
                    yield above + label, owner
                todo += [(above + label, c) for c in children.values()]
        if first is None and self.root[2] is not None:
            yield b"", self.root[2]
            self.root[2] = None

    def spill(self, most: int) -> Iterator[tuple[bytes, list]]:
        """While the trie is larger than ``most`` bytes: its largest subtree."""
        while sum(self.held.values()) > most:
            yield from self.take(max(self.held, key=self.held.get))


def _better(a: tuple, b: tuple) -> tuple:
    """More code points, then the smaller id (null last), then the earlier row."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    return min(a, b, key=key)


LOCAL = "n_bytes long, content_hash long, sha string, body binary, points long, doc_id long, tag long, n long, members array<struct<doc_id:long,tag:long>>"
ARROW_LOCAL = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("points", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("tag", pa.int64())])))])
OWNERS = "sha string, points long, doc_id long, tag long, n long"
ARROW_OWNERS = pa.schema([("sha", pa.string()), ("points", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n", pa.int64())])


def _insert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one task, one row for each distinct text, with the rows that have it."""
    trie = Trie()

    def rows(found):
        out, size = [], 0
        for key, (best, members) in found:
            out.append({"n_bytes": len(key), "content_hash": xxhash.xxh3_64_intdigest(key) - (1 << 63), "sha": hashlib.sha256(key).hexdigest(), "body": key, "points": best[0], "doc_id": best[1], "tag": best[2], "n": len(members), "members": members})
            size += len(key)
            if size > 8 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_LOCAL)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW_LOCAL)

    for batch in batches:
        for doc_id, body, points, tag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            owner, row = trie.owner((body or b"").translate(None, WHITE)), (points, doc_id, tag)
            if not owner:
                owner += [row, []]
            owner[0] = _better(owner[0], row)
            owner[1].append({"doc_id": doc_id, "tag": tag})
        yield from rows(trie.spill(TRIE_BYTES))
    yield from rows(trie.take())
    give_back()


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of (length, content hash): whole texts meet in the trie, each terminal node keeps its owner."""
    trie = Trie()

    def rows(found):
        out = [{"sha": sha, "points": best[0], "doc_id": best[1], "tag": best[2], "n": n} for _, (best, n, sha) in found]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW_OWNERS)

    for batch in batches:
        for body, sha, points, doc_id, tag, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            owner, row = trie.owner(body), (points, doc_id, tag)
            if not owner:
                owner += [row, 0, sha]
            owner[0] = _better(owner[0], row)
            owner[1] += n
        yield from rows(trie.spill(TRIE_BYTES))
    yield from rows(trie.take())
    give_back()


def copies(docs: DataFrame, id_col="doc_id", text_col="text", tag: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_tag.

    Texts are equal when they are identical without white space (space and U+0009 to U+000D); a null text counts as
    empty, and all empty texts are equal.  Of equal texts the row with the most code points stays, then the one with the
    smallest id (null last); of rows that agree in all that, one.  ``tag`` (a long) tells rows apart for the caller; rows with the
    same tag are kept or dropped together.  Other columns are not looked at; an empty table gives an empty one.

    Every task inserts its rows into a trie and hands on each distinct text once, so that a hot group is at most one row per
    task in the shuffle; member lists stay behind.  Partitions by length and content hash insert the whole byte strings
    again; terminal nodes hold the owner.  A trie beyond TRIE_BYTES hands on its largest subtree and frees it; what it held is
    merged by fingerprint afterwards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("body"), F.char_length(text).cast("long").alias("points"), (F.monotonically_increasing_id() if tag is None else tag).alias("tag"))
    local = stored(rows.mapInArrow(_insert, LOCAL), "texts")
    dealt = local.repartition(parts(spark), "n_bytes", "content_hash")
    owners = dealt.select("body", "sha", "points", "doc_id", "tag", "n").mapInArrow(_own, OWNERS)
    first = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("u"), "doc_id", "tag")
    owners = owners.groupBy("sha").agg(F.min(first).alias("best"), F.sum("n").alias("group_size"))
    members = local.select("sha", "members").join(owners, "sha").withColumn("member", F.explode("members"))
    return members.select(
        F.col("member.doc_id").alias("doc_id"),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("member.tag") == F.col("best.tag")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("member.tag").alias("row_tag"),
    )
