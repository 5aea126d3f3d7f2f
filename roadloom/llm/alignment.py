"""Cross-tokenizer alignment: tokens of two vocabularies that cover the same bytes, counted by external merging of runs."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.encoder import CHAIN, MEMORY, gather
from roadloom.llm.store import give_back, stored, tidied

#: Characters of text that close a block of documents.
BLOCK_CHARS = 8 << 20
#: Radix partitions of the pair records, by the id of the first vocabulary.
BUCKETS = 32
#: Runs that one task merges, on average; more runs are merged in further levels.
FAN = 16
#: Pairs in a compressed frame of a run; of each run that is merged, one frame is open.
FRAME = 1 << 15
#: Pieces learned at a time, and links of a group from which equal ones are counted before they are written out.
LEARN, LARGE = 20_000, 1 << 12
_GAP = re.compile(r"(?<=\S) (?=\S)")


# ------------------------------------------------------------------------------------------------ tokens and groups


def _byte_level() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=1)
def first_side(path: str):
    """A byte-level tokenizer that takes the strings of special tokens for text, and the bytes of its ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t, byte = Tokenizer.from_file(path), _byte_level()
    t.encode_special_tokens = True
    spelled = {i: bytes(byte[c] for c in token) for token, i in t.get_vocab(with_added_tokens=False).items()}
    return t, spelled


@lru_cache(maxsize=1)
def second_side(path: str):
    """A sentencepiece model and the bytes of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled[i] = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    return model, spelled


def cut(text: str) -> list[str]:
    """A text in pieces, cut at every single space between two characters that are no white space.  Both vocabularies begin a token
    with that space, so tokens and groups of the text are those of its pieces, each with a space before it."""
    words = text.split(" ")
    return words if " ".join(text.split()) == text else _GAP.split(text)


def linked(groups: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times): every token of the first side with every one of the second that has the same group number; groups
    ascend from 0 on both sides, and each has tokens of both.  Pairs may repeat, but in a large group the equal ones come as one."""
    (group_a, group_b), (ids_a, ids_b) = groups, ids
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    n_a, n_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    large = n_a * n_b > LARGE
    here = ~large[group_a]
    repeat = n_b[group_a[here]]
    within = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    group = np.repeat(group_a[here], repeat)
    pair = np.repeat(ids_a[here] << 32, repeat) | ids_b[first_b[group] + within]
    many = [(group, pair, np.ones(len(pair), np.int64))]
    for g in np.flatnonzero(large).tolist():
        x, k = np.unique(ids_a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, m = np.unique(ids_b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        many.append((np.full(len(x) * len(y), g), ((x << 32)[:, None] | y).ravel(), (k[:, None] * m).ravel()))
    group, pair, times = (np.concatenate(x) for x in zip(*many, strict=True))
    order = np.argsort(group, kind="stable")
    return group[order], pair[order], times[order]


def written(groups: tuple[np.ndarray, np.ndarray], ids: tuple[np.ndarray, np.ndarray], cuts: np.ndarray) -> list[str]:
    """The groups as text, ``a1,a2|b1;a3|b2,b3``, cut before the group numbers ``cuts``."""
    group, side = np.concatenate(groups), np.repeat([0, 1], [len(g) for g in groups])
    order = np.argsort(2 * group + side, kind="stable")
    own = (2 * group + side)[order]
    mark = np.where(np.diff(own, append=-1) == 0, 0, 1 + own % 2)
    parts = [f"{i}{m}" for i, m in zip(np.concatenate(ids)[order].tolist(), map(",|;".__getitem__, mark.tolist()), strict=True)]
    at = np.searchsorted(own, 2 * cuts).tolist()
    return ["".join(parts[lo:hi])[:-1] for lo, hi in zip(at, [*at[1:], len(parts)], strict=True)]


def _widths(spelled: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(spelled) + 1, np.int64)
    out[list(spelled)] = [len(x) for x in spelled.values()]
    return out


class _Numbered(dict):
    def __missing__(self, key):
        at = self[key] = len(self)
        return at


class Aligner:
    """Aligns pieces of text, each distinct one once per worker."""

    def __init__(self, path_a: str, path_b: str):
        (self.a, self.bytes_a), (self.b, self.bytes_b) = first_side(path_a), second_side(path_b)
        self.widths = tuple(_widths(x) for x in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        """Pieces and pairs get new numbers; the pairs of a piece are a slice of ``pair`` and ``times``."""
        self.pieces, self.pairs, self.written = _Numbered(), _Numbered(), []
        self.tokens = np.zeros((0, 4), np.int64)  # tokens of both sides, groups, and whether the bytes agree
        self.pair, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each text with a space before it; None where they don't spell it."""
        found = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, e, ids_b in zip(texts, found, self.b.encode(texts, num_threads=1) if texts else [], strict=True):
            raw, ids_a = b" " + text.encode(), e.ids
            if b"".join(map(self.bytes_a.__getitem__, ids_a)) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
                yield np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            else:
                yield None

    def learn(self) -> None:
        """Tokens, groups and pairs of the pieces that came since the last time.  Pieces without white space at their ends are
        encoded many to a text; where that can't be cut into pieces again, one by one."""
        while new := list(islice(self.pieces, len(self.written), len(self.written) + LEARN)):
            sizes = np.array([len(p.encode()) + 1 for p in new], np.int64)
            plain = [i for i, p in enumerate(new) if not p[0].isspace() and not p[-1].isspace()]
            alone = sorted(set(range(len(new))) - set(plain))
            done = []  # (pieces, their ids)
            chains = [plain[i : i + CHAIN] for i in range(0, len(plain), CHAIN)]
            for chain, got in zip(chains, self._texts([" ".join([new[i] for i in c]) for c in chains]), strict=True):
                ends = np.cumsum(sizes[chain])
                if got and all(np.isin(ends, np.cumsum(w[x])).all() for w, x in zip(self.widths, got, strict=True)):
                    done.append((chain, got))
                else:
                    alone += chain
            done += [([i], got) for i, got in zip(alone, self._texts([new[i] for i in alone]), strict=True) if got]
            self._add(new, sizes, done)

    def _add(self, new: list[str], sizes: np.ndarray, done: list) -> None:
        """Line up the tokens of all pieces in ``done``; the others have none."""
        tokens, count, texts = np.zeros((len(new), 4), np.int64), np.zeros(len(new), np.int64), [""] * len(new)
        order = np.array([i for chain, _ in done for i in chain], np.int64)
        pair = times = np.zeros(0, np.int64)
        if len(order):
            ids = tuple(np.concatenate([got[side] for _, got in done]) for side in (0, 1))
            ends = tuple(np.cumsum(w[x]) for w, x in zip(self.widths, ids, strict=True))
            both = np.intersect1d(*ends, assume_unique=True)
            groups = tuple(np.searchsorted(both, e) for e in ends)
            piece = np.searchsorted(np.cumsum(sizes[order]), both)  # of each group
            tokens[order] = np.stack([*(np.bincount(piece[g], minlength=len(order)) for g in groups), np.bincount(piece), np.ones(len(order), np.int64)], axis=1)
            for i, text in zip(order.tolist(), written(groups, ids, np.searchsorted(piece, np.arange(len(order)))), strict=True):
                texts[i] = text
            group, pair, times = linked(groups, ids)
            count[order] = np.bincount(piece[group], minlength=len(order))
        distinct, inverse = np.unique(pair, return_inverse=True)
        numbers = np.fromiter(map(self.pairs.__getitem__, distinct.tolist()), np.int64, len(distinct))
        starts = np.zeros(len(new), np.int64)
        starts[order] = len(self.pair) + np.cumsum(count[order]) - count[order]
        self.pair, self.times = np.concatenate([self.pair, numbers[inverse]]), np.concatenate([self.times, times])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, count])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.written += texts

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the numbers of its pieces, all of them learned."""
        if len(self.pieces) > MEMORY:
            self.forget()
        cuts = [cut(t) if t else [] for t in texts]
        out = [np.fromiter(map(self.pieces.__getitem__, c), np.int64, len(c)) for c in cuts]
        self.learn()
        return out


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


# ------------------------------------------------------------------------------------------------ runs


def packed(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """A run: ascending keys with a number each, in zstd frames."""
    out = []
    for keys, numbers in parts:
        for at in range(0, len(keys), FRAME):
            k, n = keys[at : at + FRAME], numbers[at : at + FRAME]
            raw = np.diff(k, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
            body = zstandard.compress(raw, 1)
            out += [struct.pack("<I", len(body)), body]
    return b"".join(out)


def frames(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = 0
    while at < len(run):
        (n,) = struct.unpack_from("<I", run, at)
        raw = np.frombuffer(zstandard.decompress(run[at + 4 : at + 4 + n]), np.uint8).reshape(2, 8, -1)
        both = [np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw]
        yield np.cumsum(both[0]), both[1]
        at += 4 + n


def merged(runs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs merged, numbers of equal keys summed, in ascending order.

    The heap holds the last key of each run's open frame.  Up to the smallest of them every key of every run is at hand: that
    much is taken from all open frames at once, and the runs whose frame has come to its end open their next one.
    """
    sources = [frames(r) for r in runs]
    held, heap = {}, []

    def refill(i: int) -> None:
        frame = next(sources[i], None)
        if frame is None:
            held.pop(i, None)
        else:
            held[i] = frame
            heapq.heappush(heap, (int(frame[0][-1]), i))

    for i in range(len(sources)):
        refill(i)
    while heap:
        last = heap[0][0]
        keys, numbers = [], []
        for i, (k, n) in list(held.items()):
            to = int(np.searchsorted(k, last, side="right"))
            keys.append(k[:to])
            numbers.append(n[:to])
            held[i] = k[to:], n[to:]
        keys, numbers = np.concatenate(keys), np.concatenate(numbers)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)
        yield keys, np.add.reduceat(numbers[order], first)
        while heap and heap[0][0] == last:
            refill(heapq.heappop(heap)[1])


def answered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers become 2 * count + 1 where the count is the highest of its first id, 2 * count elsewhere.  Keys come by first id,
    so that its highest count is known when the next one begins; only one first id is held back."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done(k, n):
        first = np.flatnonzero(np.diff(k >> 32, prepend=-1))
        top = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(k))))
        return k, 2 * n + (n == top)

    for k, n in parts:
        keys, counts = np.concatenate([keys, k]), np.concatenate([counts, n])
        open_from = int(np.searchsorted(keys, (keys[-1] >> 32) << 32))
        if open_from:
            yield done(keys[:open_from], counts[:open_from])
            keys, counts = keys[open_from:], counts[open_from:]
    if len(keys):
        yield done(keys, counts)


# ------------------------------------------------------------------------------------------------ Spark


BLOCK = "block long, bucket int, run binary, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary"
ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("run", pa.binary()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()), ("links", pa.binary())])
RUN = "bucket int, node long, child long, run binary"
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _links(place: np.ndarray, times: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Ascending places and how often each is linked; small numbers as planes of bytes."""
    both = np.concatenate([np.diff(place, prepend=0), times]).astype("<i8")
    return tool.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes())


def _unlinked(raw: bytes, tool: zstandard.ZstdDecompressor) -> np.ndarray:
    both = np.ascontiguousarray(np.frombuffer(tool.decompress(raw), np.uint8).reshape(8, -1).T).view("<i8").reshape(2, -1)
    return np.stack([np.cumsum(both[0]), both[1]])


def _blocks(path_a: str, path_b: str, with_groups: bool):
    """Documents in blocks.  A row for each document: its numbers and its distinct pairs, as places in the block's ascending list of
    pairs.  A row for each bucket: the run of that list, with the number of documents of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        tool, zstd = aligner(path_a, path_b), zstandard.ZstdCompressor(level=1)

        def emit() -> Iterator[pa.RecordBatch]:
            places = tool.places(texts)
            known = np.fromiter(tool.pairs, np.int64, len(tool.pairs))
            used = np.zeros(len(known), bool)
            whole = [len(p) > 0 and bool(tool.tokens[p, 3].all()) for p in places]  # else the text has no tokens at all
            for p in (p for p, good in zip(places, whole, strict=True) if good):
                used[gather(tool.pair, tool.starts, tool.sizes, p)] = True
            used = np.flatnonzero(used)
            used = used[np.argsort(known[used])]
            keys, counts, rank = known[used], np.zeros(len(used), np.int64), np.zeros(len(known), np.int64)
            rank[used] = np.arange(len(used))
            rows = []
            for i, p, good in zip(ids, places, whole, strict=True):
                row = {"block": block, "doc_id": i, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "groups": "" if with_groups else None}
                if good:
                    own, times = rank[gather(tool.pair, tool.starts, tool.sizes, p)], gather(tool.times, tool.starts, tool.sizes, p)
                    order = np.argsort(own, kind="stable")
                    own, first = np.unique(own[order], return_index=True)
                    times = np.add.reduceat(times[order], first)
                    counts[own] += 1
                    text = ";".join([tool.written[x] for x in p.tolist()])
                    n_a, n_b, n_groups = tool.tokens[p, :3].sum(0).tolist()
                    row |= {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": int(times.sum()), "groups_sha256": hashlib.sha256(text.encode()).hexdigest(), "links": _links(own, times, zstd)}
                    if with_groups:
                        row["groups"] = text
                rows.append(row)
                if len(rows) == 512:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows = []
            home = (keys >> 32) % BUCKETS
            rows += [{"block": block, "bucket": int(b), "run": packed([(keys[home == b], counts[home == b])])} for b in np.unique(home)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 64
                if size >= BLOCK_CHARS:
                    yield from emit()
                    block, ids, texts, size = block + 1, [], [], 0
                    give_back()
        if ids:
            yield from emit()
            ids, texts = [], []
            give_back()

    return run


def _up(table: pa.Table) -> pa.Table:
    run = packed(merged(table.column("run").to_pylist()))
    return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "node": table.column("node")[:1], "child": table.column("node")[:1], "run": pa.array([run], pa.binary())})


def _root(table: pa.Table) -> pa.Table:
    (run,) = table.column("run").to_pylist()
    return table.set_column(3, "run", pa.array([packed(answered(frames(run)))], pa.binary()))


def _down(answer: pa.Table, children: pa.Table) -> pa.Table:
    """The pairs of every child with the counts of the whole corpus; a node's own pairs are a superset of each child's."""
    keys, numbers = (np.concatenate(x) for x in zip(*frames(answer.column("run")[0].as_py()), strict=True))

    def found(run: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, _ in frames(run):
            yield k, numbers[np.searchsorted(keys, k)]

    runs = [packed(found(r)) for r in children.column("run").to_pylist()]
    n = len(runs)
    return pa.table({"bucket": children.column("bucket").cast(pa.int32()), "node": children.column("child"), "child": children.column("child"), "run": pa.array(runs, pa.binary())}) if n else children


def _rows(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one block: the counts of their pairs, summed over the links."""
    runs = [frame for r in answers.column("run").to_pylist() for frame in frames(r)]
    keys, numbers = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 2
    numbers = numbers[np.argsort(keys)]
    best, total, tool = [], [], zstandard.ZstdDecompressor()
    for raw in docs.column("links").to_pylist():
        place, times = _unlinked(raw, tool) if raw else np.zeros((2, 0), np.int64)
        own = numbers[place]
        best.append(int(times @ (own & 1)))
        total.append(int(times @ (own >> 1)))
    out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": docs.column("groups_sha256"), "groups": docs.column("groups")})


def _tree(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs, from the blocks' own up to one run for each bucket, and that run with its answers."""
    runs = blocks.where("bucket IS NOT NULL").select("bucket", F.col("block").alias("child"), "run")
    levels, width = [], runs.agg(F.count_distinct("child")).first()[0]
    while True:
        width = math.ceil(width / FAN)
        # blocks are dealt by a hash, nodes by their number
        node = F.pmod(F.col("child") if levels else F.xxhash64("child"), F.lit(max(1, width))).alias("node")
        levels.append(runs.select("bucket", node, "child", "run"))
        runs = stored(levels[-1].groupBy("bucket", "node").applyInArrow(lambda t: tidied(_up, t), RUN), "runs").select("bucket", "child", "run")
        if width <= 1:
            break
    top = runs.select("bucket", F.lit(0).cast("long").alias("node"), "child", "run")
    return levels, top.groupBy("bucket").applyInArrow(_root, RUN)


def _counted(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, with_groups: bool) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_blocks(path_a, path_b, with_groups), BLOCK), "aligned")
    return blocks, *_tree(blocks)


def align(docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text", with_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with
    ``with_groups`` groups, written ``a1,a2|b1;a3|b2,b3``.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, ``path_b`` a sentencepiece model; both encode space and text, the
    strings of special tokens as text.  Byte offsets where tokens of both end cut them into groups; tokens of one group are linked,
    every occurrence with every other.  A pair's count is the number of rows that hold it linked.

    Blocks of documents write runs of (pair, documents), in ascending order and compressed, one for each radix of the first id.
    Runs meet FAN by FAN in a tree, each node merging its children with a heap of open frames; at the top a pair has its count
    and, since pairs come by first id, the highest of that id.  The answers stream down the same tree to the blocks that asked.
    A pair is in a block's run once, however frequent, so that no key gathers rows; a node holds one frame of each child going up and
    the pairs of one bucket going down, whose number the two vocabularies bound.  All levels are written to the shared folder.

    Null and empty texts, and those whose tokens do not spell space and text again (U+2581 in the text), have no tokens: zeros
    and ''.  Rows that share an id count on their own; other columns are not looked at; an empty table gives an empty one.
    A very long text ends its block; its work is one task's.
    """
    blocks, levels, answers = _counted(docs, path_a, path_b, id_col, text_col, with_groups)
    for level in reversed(levels):
        answers = stored(answers.groupBy("bucket", "node").cogroup(level.groupBy("bucket", "node")).applyInArrow(lambda a, c: tidied(_down, a, c), RUN), "answers")
    out = blocks.where("bucket IS NULL").drop("bucket", "run").groupBy("block").cogroup(answers.select("bucket", F.col("node").alias("block"), "run").groupBy("block")).applyInArrow(lambda b, a: tidied(_rows, b, a), ROW)
    return out if with_groups else out.drop("groups")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(a_id, b_id, documents, best): every linked pair of ids with the number of rows that hold it; best where no other pair of
    that a_id is in more.  Nulls, repeats and empty tables as in ``align``."""
    answers = _counted(docs, path_a, path_b, id_col, text_col, False)[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_run in batch.column(0).to_pylist():
                for keys, numbers in frames(packed_run):
                    yield pa.RecordBatch.from_arrays([pa.array(keys >> 32, pa.int64()), pa.array(keys & 0xFFFFFFFF, pa.int64()), pa.array(numbers >> 1, pa.int64()), pa.array((numbers & 1).astype(bool))], ["a_id", "b_id", "documents", "best"])

    return answers.select("run").mapInArrow(run, "a_id long, b_id long, documents long, best boolean")
