"""Near-duplicate documents: an exact Jaccard join on word shingles by T-occurrence search (DivideSkip)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.graph import components
from roadloom.llm.store import give_back, parts, rows_of, stored, tidied

#: Words in a block of documents that one step of a task holds in memory.
BLOCK_WORDS = 1_000_000
#: Shingles of the documents that one search task holds in memory; larger groups are dealt into pairs of blocks.
GROUP_SHINGLES = 4_000_000
#: Weight of a binary probe against a merge step when the long lists are chosen.
PROBE_WEIGHT = 0.01
NOBODY = np.uint32(0xFFFFFFFF)

BLOCK = "kind string, bucket int, block long, ids array<long>, ns binary, sigs binary, hashes binary, refs binary"


def need(n, percent: int):
    """How many shingles a partner of a set of ``n`` must share with it at least."""
    return (percent * n + 99) // 100


def components_of(docs: DataFrame, id_col="doc_id", text_col="text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case; a set holds the distinct shingles of ``k`` words, or
    the whole sequence where there are fewer.  Two documents are linked when 100 * |A and B| >= percent * |A or B|;
    component_id is the smallest doc_id that can be reached.  Documents without words or text have no set, a null class_id,
    and are linked with nothing.  Repeated rows and ids are rows of their own; a null id never becomes a component_id
    unless the whole component has none.  Other columns of ``docs`` are not looked at; an empty table gives an empty one.

    1. Blocks of documents are reduced to distinct sets, and a set's shingles are sent to hash buckets.  A shingle that occurs
       in a block more than once needs no answer; others learn whether any other block has them.  What is unique in
       the corpus cannot link anything and goes no further.
    2. A set of n shingles needs T = ceil(percent * n / 100) shared ones.  Sets with fewer shared ones are dropped; lists of the
       others are counted, and each set's shingles are sorted by the length of their lists.
    3. Sets that meet in a short list (one of their n - T + 1 rarest) are sent to the group of that list's pivot.  Within a group
       the short lists are merged with threshold T - L and the L long ones probed by binary search (``linked``).
    4. A group hands on a spanning star of each of its components, never all pairs.  Groups beyond GROUP_SHINGLES
       are dealt into blocks, one task for each pair of blocks, so that no task holds a whole hot group.
    """
    spark = docs.sparkSession
    buckets = 4 * parts(spark)
    dealt = rows_of(docs, id_col, text_col).mapInArrow(_blocks(k, buckets), BLOCK)
    met = dealt.groupBy("bucket").applyInArrow(_meet, BLOCK)
    out = stored(met.groupBy("block").applyInArrow(_gather(percent), "doc_id long, n long, sig binary, shared array<long>"), "shingles")
    rows, sets = out.where("shared is null").drop("shared"), out.where("shared is not null")

    sets = stored(sets.dropDuplicates(["sig"]).select("sig", "n", "shared", F.monotonically_increasing_id().alias("cid")), "sets")
    each = sets.select("cid", "n", F.explode("shared").alias("h"))
    length = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    lists = each.join(length, "h").groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    lists = lists.select("cid", "n", F.col("s.h").alias("s"), (F.size("s") - (F.expr(f"{percent} * n + 99").cast("long") / 100).cast("long") + 1).alias("short"))
    lists = stored(lists.where("short > 0"), "lists")

    index = lists.select("cid", F.explode(F.slice("s", F.lit(1), F.col("short").cast("int"))).alias("h"))
    rank = F.struct(F.xxhash64("cid").alias("x"), "cid")
    pivot = index.groupBy("h").agg(F.min(rank)["cid"].alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    member = index.join(pivot, "h").select("pivot", "cid").distinct()
    full = member.join(lists, "cid")
    total = member.join(lists.select("cid", F.size("s").alias("m")), "cid").groupBy("pivot").agg(F.sum("m").alias("m"))
    total = total.select("pivot", F.ceil(F.col("m") / GROUP_SHINGLES).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("blocks")).cast("int")
    full = full.join(total, "pivot").withColumn("mine", mine)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("i"), F.greatest(o, "mine").alias("j")))
    full = full.withColumn("at", F.explode(pairs)).select("pivot", "at.i", "at.j", "cid", "n", "s")
    edges = full.groupBy("pivot", "i", "j").applyInArrow(linked(percent), "a long, b long")

    root = components(edges)
    sig = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("low"))
    known = sets.join(root, sets.cid == root.node).select("sig", "root").join(sig, "sig")
    best = known.groupBy("root").agg(F.min("low").alias("best"))
    known = known.join(best, "root").select("sig", "best")
    sig = sig.join(known, "sig", "left").select(F.col("sig").alias("class_id"), F.coalesce("best", "low").alias("component_id"))
    found = rows.join(sig, rows.sig == sig.class_id, "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class_id")


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(bodies: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    words, seen = [b.lower().split() for b in bodies], _WordHash()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((seen[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    with np.errstate(over="ignore"):
        mixed = np.zeros(max(0, len(flat) - k + 1), np.uint64)
        for i in range(k):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + flat[i : i + len(mixed)])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= k:
            out.append(np.unique(mixed[at : at + n - k + 1]))
        elif n:  # the whole sequence as one, told apart by its length
            out.append(np.array([xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _planes(values: np.ndarray) -> bytes:
    """Integers by byte plane, so that planes of zeros vanish when the shuffle compresses them."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _listed(hashes: np.ndarray, refs: np.ndarray) -> dict[str, bytes]:
    """Ascending hashes as their differences, and the set that each belongs to, where NOBODY becomes 0."""
    return {"hashes": _planes(np.diff(hashes, prepend=np.uint64(0))), "refs": _planes(refs + np.uint32(1))}


def _hashes(row: dict) -> np.ndarray:
    return np.cumsum(_unplaned(row["hashes"], np.uint64), dtype=np.uint64)


def _refs(row: dict) -> np.ndarray:
    return _unplaned(row["refs"], np.uint32) - np.uint32(1)


def _row(kind, bucket, block, ids=None, ns=None, sigs=None, hashes=None, refs=None):
    raw = lambda x: None if x is None else x.tobytes()
    lists = {"hashes": None, "refs": raw(refs)} if hashes is None else _listed(hashes, refs)
    return {"kind": kind, "bucket": int(bucket), "block": block, "ids": ids, "ns": raw(ns), "sigs": sigs} | lists


ARROW_BLOCK = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("ns", pa.binary()), ("sigs", pa.binary()), ("hashes", pa.binary()), ("refs", pa.binary())])


def _blocks(k: int, buckets: int):
    """Cut a partition into blocks of documents.  A block becomes one row 'docs' (ids, and for each the position of
    its set), one row 'sets' (size and fingerprint of each set), one row 'known' (shingles that several sets of the block
    have), and a row 'ask' for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, bodies, words = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                bodies.append(body or b"")
                words += len(bodies[-1]) // 6 + 1
                if words >= BLOCK_WORDS:
                    yield from emit(block, ids, bodies)
                    block, ids, bodies, words = block + 1, [], [], 0
                    give_back()
        if ids:
            yield from emit(block, ids, bodies)
            ids, bodies = [], []
            give_back()

    def emit(block, ids, bodies):
        place, sets, refs, sigs = {}, [], [], []
        for s in shingles(bodies, k):
            sig = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""
            if sig not in place:
                place[sig] = len(sets)
                sets.append(s)
                sigs.append(sig.ljust(16, b"\0"))
            refs.append(place[sig])
        sizes = np.array([len(s) for s in sets], np.uint32)
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)[order]
        first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        run_length = np.diff(np.append(first, len(flat)))
        many = np.repeat(run_length > 1, run_length)
        where = block % buckets
        yield batch([_row("docs", where, block, ids, refs=np.array(refs, np.uint32)), _row("sets", where, block, ns=sizes, sigs=b"".join(sigs)), _row("known", where, block, hashes=flat[many], refs=owner[many])])
        asks, who = flat[first], np.where(run_length > 1, NOBODY, owner[first])
        cut = np.searchsorted((asks >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
        yield batch([_row("ask", b, block, hashes=asks[lo:hi], refs=who[lo:hi]) for b, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if hi > lo])

    def batch(rows):
        return pa.RecordBatch.from_pylist(rows, schema=ARROW_BLOCK)

    return run


def _meet(table: pa.Table) -> pa.Table:
    return tidied(_met, table)


def _met(table: pa.Table) -> pa.Table:
    """One bucket: of the shingles asked for, send back those that more than one block has."""
    kinds = np.array(table.column("kind").to_pylist())
    asked = np.flatnonzero(kinds == "ask")
    out = [table.filter(pa.array(kinds != "ask"))]
    if len(asked):
        rows = table.take(pa.array(asked))
        asks = rows.select(["hashes", "refs"]).to_pylist()
        hashes, refs = [_hashes(r) for r in asks], np.concatenate([_refs(r) for r in asks])
        del asks
        source = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        flat = np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        shared = np.zeros(len(flat), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        shared &= refs != NOBODY
        blocks, back = rows.column("block").to_pylist(), []
        at = np.flatnonzero(shared)
        cut = np.searchsorted(source[at], np.arange(len(hashes) + 1))
        for s, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if hi > lo:
                back.append(_row("known", 0, blocks[s], hashes=flat[at[lo:hi]], refs=refs[at[lo:hi]]))
        out.append(pa.Table.from_pylist(back, schema=ARROW_BLOCK))
    return pa.concat_tables([t.cast(ARROW_BLOCK) for t in out])


def _gather(percent: int):
    """One block: a row for each document, and a row with the shared shingles of each set that has enough of them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("shared", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        return tidied(work, table)

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        docs, sets = (next(r for r in rows if r["kind"] == k) for k in ("docs", "sets"))
        n = np.frombuffer(sets["ns"], np.uint32).astype(np.int64)
        sigs = [sets["sigs"][i * 16 : i * 16 + 16] if n[i] else None for i in range(len(n))]
        known = [r for r in rows if r["kind"] == "known"]
        refs = np.concatenate([_refs(r) for r in known])
        hashes = np.concatenate([_hashes(r) for r in known]).view(np.int64)
        order = np.argsort(refs, kind="stable")
        cut = np.searchsorted(refs[order], np.arange(len(n) + 1))
        at = np.frombuffer(docs["refs"], np.uint32).tolist()
        plain = pa.Table.from_pydict({"doc_id": docs["ids"], "n": n[at].tolist(), "sig": [sigs[r] for r in at], "shared": [None] * len(at)}, schema=schema)
        keep = [r for r in range(len(n)) if n[r] and cut[r + 1] - cut[r] >= need(int(n[r]), percent)]
        held = pa.Table.from_pydict({"doc_id": [None] * len(keep), "n": [int(n[r]) for r in keep], "sig": [sigs[r] for r in keep], "shared": [hashes[order[cut[r] : cut[r + 1]]] for r in keep]}, schema=schema)
        return pa.concat_tables([plain, held])

    return run


def linked(percent: int):
    """T-occurrence search among the sets of one group.

    The shingles of a set come sorted by the length of their lists, shortest first.  Of its lists the L longest are
    set aside; the others are merged, and sets found fewer than T - L times are out.  The rest are looked up in the long lists
    by binary search, and leave as soon as they cannot reach the overlap that both sizes ask for.  Pairs that are connected
    already need no check.  Returns (smallest set, other set) for each component.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cid")
        cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
        sets = table.column("s").combine_chunks()
        bounds, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        bounds = bounds.astype(np.int64)
        parent = list(range(len(cid)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        _, term = np.unique(flat[bounds[0] : bounds[-1]], return_inverse=True)
        bounds = bounds - bounds[0]
        owner = np.repeat(np.arange(len(cid)), np.diff(bounds))[np.argsort(term, kind="stable")]
        start = np.append(0, np.cumsum(np.bincount(term)))
        longest = int(np.diff(start).max())
        for x in range(1, len(cid)):
            mine, t = term[bounds[x] : bounds[x + 1]], need(int(n[x]), percent)
            n_long = min(t - 1, int(t / (PROBE_WEIGHT * math.log2(longest + 1) + 1)))
            split = len(mine) - n_long
            found = np.concatenate([owner[start[j] : start[j + 1]] for j in mine[:split]])
            count = np.bincount(found[found < x], minlength=x)
            c = np.flatnonzero(count >= t - n_long)
            c = c[percent * np.maximum(n[c], n[x]) <= 100 * np.minimum(n[c], n[x])]
            root = find(x)
            c = np.array([y for y in c.tolist() if find(y) != root], np.int64)
            goal = -(-percent * (n[c] + n[x]) // (100 + percent))
            hits, left = count[c], len(mine) - split
            for j in mine[split:].tolist():
                if not len(c):
                    break
                long = owner[start[j] : start[j + 1]]
                at = np.searchsorted(long, c)
                hits = hits + (long[np.minimum(at, len(long) - 1)] == c)
                left -= 1
                if left % 16 == 0:
                    stay = hits + left >= goal
                    c, hits, goal = c[stay], hits[stay], goal[stay]
            for y in c[hits >= goal].tolist():
                parent[max(find(x), find(y))] = min(find(x), find(y))
        roots = np.array([find(x) for x in range(len(cid))])
        other = np.flatnonzero(roots != np.arange(len(cid)))
        return pa.table({"a": pa.array(cid[roots[other]]), "b": pa.array(cid[other])})

    return run
