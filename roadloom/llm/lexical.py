"""Ranked lexical search for many queries at once, over partial sums that the queries share."""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.store import give_back, stored

#: Bytes of query text whose plan is handed to every task at once; more queries go in further waves, each over all documents.
WAVE_BYTES = 4 << 20
#: Bytes of text in a block of documents.
BLOCK_BYTES = 8 << 20
#: Documents whose partial sums a task holds at once, and numbers in that table.
LANE, CELLS = 1024, 1 << 22
#: Everything that is no part of a term becomes a space, A to Z their small letters; bytes above 0x7F belong to terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

PLAN = "wave int, items binary, plan binary"
BLOCK = "block long, counted long, terms long, doc_ids array<long>, lengths binary, cells binary, found array<int>, df array<long>"
ARROW = pa.schema([("block", pa.int64()), ("counted", pa.int64()), ("terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("cells", pa.binary()), ("found", pa.list_(pa.int32())), ("df", pa.list_(pa.int64()))])
HIT = "item_id long, doc_id long, score long"


def terms_of(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(_TERMS).split()


# ------------------------------------------------------------------------------------------------ the queries' plan


def mine(items: list[dict[int, int]]) -> tuple[list[list[int]], list[list[tuple[int, int]]]]:
    """Term sets that items share.  ``items`` gives each item's terms with their number of repeats.

    Returns nodes and roots.  Nodes below the number of terms are the terms; a later node is the sum of the nodes in its
    list, all of which come before it.  Roots lists for each item the (node, repeats) whose sum is its score.  First terms that always
    come together, equally often, become a node.  Then the nodes of each item stand in order of how many items have them, and
    neighbours that two items or more have next to each other become a node, again and again, until no two are left: the
    shared beginnings and runs of the items are summed once.
    """
    terms = 1 + max((t for item in items for t in item), default=-1)
    nodes: list[list[int]] = [[] for _ in range(terms)]
    where = defaultdict(list)
    for i, item in enumerate(items):
        for t, n in sorted(item.items()):
            where[t].append((i, n))
    together = defaultdict(list)
    for t, at in where.items():
        together[tuple(at)].append(t)
    rows: list[list[tuple[int, int]]] = [[] for _ in items]
    spread = Counter()
    for same in together.values():
        node = same[0]
        if len(same) > 1:
            node = len(nodes)
            nodes.append(same)
        spread[node] = len(where[same[0]])
        for i, n in where[same[0]]:
            rows[i].append((node, n))
    rows = [sorted(row, key=lambda x: (-spread[x[0]], x[0], x[1])) for row in rows]
    while True:
        pairs = Counter()
        for row in rows:
            pairs.update({(a, b) for (a, n), (b, m) in zip(row, row[1:], strict=False) if n == m})
        shared = {p: c for p, c in pairs.items() if c > 1}
        if not shared:
            return nodes, rows
        named: dict[tuple[int, int], int] = {}
        for at, row in enumerate(rows):
            out, i = [], 0
            while i < len(row):
                pair = (row[i][0], row[i + 1][0]) if i + 1 < len(row) and row[i][1] == row[i + 1][1] else None
                ahead = (row[i + 1][0], row[i + 2][0]) if pair and i + 2 < len(row) and row[i + 1][1] == row[i + 2][1] else None
                if shared.get(pair, 0) and shared[pair] >= shared.get(ahead, 0):
                    if pair not in named:
                        named[pair] = len(nodes)
                        nodes.append(list(pair))
                    out.append((named[pair], row[i][1]))
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            rows[at] = out


def _planned(table: pa.Table) -> pa.Table:
    """One wave of items: their ids, their terms and the query-sharing graph over them."""
    place: dict[bytes, int] = {}
    items = []
    for bodies in table.column("bodies").to_pylist():
        count = Counter(t for body in bodies for t in terms_of(body))
        items.append({place.setdefault(t, len(place)): n for t, n in sorted(count.items())})
    nodes, roots = mine(items)
    plan = {"terms": [t.decode() for t in place], "nodes": nodes[len(place) :], "roots": roots}
    packed = zstandard.compress(json.dumps(plan).encode())
    return pa.table({"wave": table.column("wave")[:1].cast(pa.int32()), "items": pa.array([json.dumps(table.column("item_id").to_pylist()).encode()], pa.binary()), "plan": pa.array([packed], pa.binary())})


def plans(items: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """(wave, items, plan): the items dealt to waves of about WAVE_BYTES of text; a wave is planned in one task."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("body"))
    each = stored(rows.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("body")).alias("bodies")), "items")
    size = each.agg(F.sum(F.aggregate("bodies", F.lit(0).cast("long"), lambda n, b: n + F.octet_length(b)))).first()[0] or 0
    waves = max(1, math.ceil(size / WAVE_BYTES))
    return stored(each.withColumn("wave", F.pmod(F.xxhash64("item_id"), F.lit(waves)).cast("int")).groupBy("wave").applyInArrow(_planned, PLAN), "plans")


# ------------------------------------------------------------------------------------------------ the documents' blocks


def _blocks(terms: list[str]):
    """Documents packed in blocks: lengths, and one cell (document, term, occurrences) for each term of the plan that a document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t.encode(): i for i, t in enumerate(terms)}
        block, ids, cells, sizes, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def emit():
            n = np.array(sizes, np.int64)
            doc = np.repeat(np.arange(len(cells), dtype=np.int64), [len(c) for c in cells])
            flat = np.fromiter((t for c in cells for t in c), np.int64, len(doc))
            key, tf = np.unique(doc * len(terms) + flat, return_counts=True)
            found, df = np.unique(key % max(1, len(terms)), return_counts=True)
            packed = zstandard.compress(np.concatenate([key // max(1, len(terms)), key % max(1, len(terms)), tf]).astype("<u4").tobytes(), 1)
            row = {"block": block, "counted": int((n > 0).sum()), "terms": int(n.sum()), "doc_ids": list(ids), "lengths": n.astype("<u4").tobytes(), "cells": packed, "found": found, "df": df}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            for i, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(body)
                ids.append(i)
                sizes.append(len(words))
                cells.append([t for t in map(place.get, words) if t is not None])
                held += len(body or b"") + 64
                if held >= BLOCK_BYTES:
                    yield emit()
                    block, ids, cells, sizes, held = block + 1, [], [], [], 0
                    give_back()
        if ids:
            yield emit()

    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def _hits(plan: dict, items: list, weight: np.ndarray, documents: int, length: int, k: int):
    """The best ``k`` documents of each item among those a task sees."""
    terms, nodes, roots = len(plan["terms"]), plan["nodes"], plan["roots"]
    lane = max(16, min(LANE, CELLS // max(1, terms + len(nodes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        least = np.zeros(len(items), np.int64)  # only scores above enter; of k equal ones, those with smaller ids

        def full(i: int) -> None:
            ids, scores = best[i]
            order = np.lexsort((ids, -scores))[:k]
            best[i] = ids[order], scores[order]
            if len(order) == k:
                least[i] = best[i][1][-1] - 1  # an equal score may still win by its id

        def lanes(ids, n, doc, term, gain):
            for lo in range(0, len(ids), lane):
                hi = min(lo + lane, len(ids))
                a, b = np.searchsorted(doc, (lo, hi))
                sums = np.zeros((terms + len(nodes), hi - lo), np.int64)
                sums[term[a:b], doc[a:b] - lo] = gain[a:b]
                for at, parts in enumerate(nodes, terms):
                    np.sum(sums[parts], axis=0, out=sums[at])
                for i, root in enumerate(roots):
                    if not root:
                        continue
                    once = [node for node, times in root if times == 1]
                    score = sums[once].sum(axis=0) if once else np.zeros(hi - lo, np.int64)
                    for node, times in root:
                        if times > 1:
                            score = score + times * sums[node]
                    hit = np.flatnonzero(score > least[i])
                    if len(hit):
                        best[i] = np.concatenate([best[i][0], ids[lo:hi][hit]]), np.concatenate([best[i][1], score[hit]])
                        full(i)

        for batch in batches:
            for r in batch.to_pylist():
                ids = np.array([_SMALLEST if x is None else x for x in r["doc_ids"]], np.int64)
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                doc, term, tf = np.frombuffer(zstandard.decompress(r["cells"]), "<u4").reshape(3, -1).astype(np.int64)
                m = 25 + (75 * n * documents) // max(1, length)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                lanes(ids, n, doc, term, gain)
        found = [(i, ids, scores) for i, (ids, scores) in enumerate(best) if len(ids)]
        if found:
            doc_ids = np.concatenate([x[1] for x in found])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([items[i] for i, ids, _ in found for _ in range(len(ids))], pa.int64()),
                    pa.array(doc_ids, pa.int64(), mask=doc_ids == _SMALLEST),
                    pa.array(np.concatenate([x[2] for x in found]), pa.int64()),
                ],
                ["item_id", "doc_id", "score"],
            )

    return run


_SMALLEST = -(1 << 63)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``k`` documents with the highest score above 0, equal scores by ascending
    id.

    Terms are runs of ASCII letters and digits and of all characters above U+007F, A to Z lower-cased; a document's score is the sum
    of weight times saturated frequency over the item's terms, repeats included.  Items are dealt to waves of bounded size (one, unless
    their text is large).  A wave's items are mined for term sets that several share; every task sums a shared set once for its
    documents and adds the items' scores up along the graph.  Documents are read once per wave and kept as blocks of term counts in
    the shared folder, from which N, L and the document frequencies are summed by Spark; what reaches the driver is a wave's plan and one
    frequency per term of it.  A task hands on at most ``k`` rows per item.

    Null and empty texts have no terms: such documents count in nothing and are never found, such items find nothing.  Rows
    that share a doc_id are documents of their own; a null doc_id comes before all others.  Different texts under one item_id make one
    item, equal rows of items count once.  Other columns are not looked at; an empty table on either side gives an empty one.
    One item is never divided: its distinct terms are handed to every task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    planned = plans(items, item_col, item_text)
    out = spark.createDataFrame([], HIT)
    for (wave,) in planned.select("wave").collect():
        row = planned.where(F.col("wave") == wave).first()
        plan, ids = json.loads(zstandard.decompress(row["plan"])), json.loads(row["items"])
        blocks = stored(rows.mapInArrow(_blocks(plan["terms"]), BLOCK), "term-blocks")
        documents, length = blocks.agg(F.sum("counted"), F.sum("terms")).first()
        each = blocks.select(F.explode(F.arrays_zip("found", "df")).alias("x")).groupBy("x.found").agg(F.sum("x.df").alias("df")).collect()
        df = np.zeros(len(plan["terms"]), np.int64)
        for found, n in each:
            df[found] = n
        weight = weights(df, documents or 0)
        hits = blocks.select("doc_ids", "lengths", "cells").mapInArrow(_hits(plan, ids, weight, documents or 0, length or 0, k), HIT)
        out = out.union(stored(hits, "hits"))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
