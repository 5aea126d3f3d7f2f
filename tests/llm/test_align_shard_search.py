"""Alignment, sharding and ranked search against brute force, and on nulls, ties, repeated rows, clashing columns and empty tables."""
import bisect
import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests_llm_rows import prose
from tokenizers import Tokenizer

from roadloom.llm import alignment, lexical, sharding
from roadloom.llm.queries import QUERIES
from roadloom.llm.store import shared_folder

BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
#: Columns whose names clash with those the operators use.
DOCS = "doc_id long, text string, shard int, slot string, block long, run string, n_a string, rank int, score string, wave int, size string"
LONG = prose(30000, 5)
ROWS = [
    (1, "The quick brown fox"), (2, "The quick brown fox"), (2, "The quick brown fox"), (3, None), (4, ""), (5, " "), (6, "\n two  spaces\t\r\n end "),
    (7, "<|endoftext|> and <s> </s> <0x41>"), (8, "low ▁ block"), (9, "naïve ﬁ Å 日本語 😀 \u0000  x　y"), (None, "no id"), (10, LONG),
    (11, "aaaa" * 3000), (12, "=" * 5000 + " " * 300 + "x"), (13, "\x1c x \x85 y"), (14, prose(400, 9)), (15, "THE QUICK brown-fox 12"),
]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 3, "s", 4, "r", "n", 1, "c", 0, "z") for r in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# ------------------------------------------------------------------------------------------------ alignment


def aligned(rows):
    """Whole texts through both libraries, every link written out."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    byte = alignment._byte_level()
    out, held, links = [], Counter(), []
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes(byte[c] for c in a.id_to_token(x)) for x in ids_a]
        raw_b = [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids_b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            ids_a = ids_b = raw_a = raw_b = []
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for x, e in zip(ids_a, ends_a):
            groups[bisect.bisect_left(cuts, e)][0].append(x)
        for x, e in zip(ids_b, ends_b):
            groups[bisect.bisect_left(cuts, e)][1].append(x)
        own = Counter()
        for x, y in groups:
            for p, n in Counter(x).items():
                for q, m in Counter(y).items():
                    own[p, q] += n * m
        held.update(own.keys())
        links.append(own)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append([i, len(ids_a), len(ids_b), len(groups), sum(own.values()), text])
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    for row, own in zip(out, links):
        row[5:5] = [sum(n for (p, q), n in own.items() if held[p, q] == best[p]), sum(n * held[k] for k, n in own.items())]
    return out, {(p, q, n, n == best[p]) for (p, q), n in held.items()}


@pytest.fixture(scope="module")
def whole():
    return aligned(ROWS)


@pytest.mark.parametrize("parts, fan", [(1, 16), (7, 2)])
def test_alignment_equals_both_libraries_on_whole_texts(spark, whole, monkeypatch, parts, fan):
    monkeypatch.setattr(alignment, "FAN", fan)                # seven blocks in pairs: three levels
    found = alignment.align(frame(spark, ROWS, parts), BYTE, PIECE, with_groups=True).drop("groups_sha256").collect()
    same([tuple(r) for r in found], [tuple(r) for r in whole[0]])


def test_alignment_digests(spark, whole):
    found = alignment.align(frame(spark, ROWS), BYTE, PIECE)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same([(r.doc_id, r.groups_sha256) for r in found.collect()], [(r[0], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in whole[0]])


def test_pair_counts(spark, whole):
    assert {tuple(r) for r in alignment.pair_counts(frame(spark, ROWS), BYTE, PIECE).collect()} == whole[1]


def test_alignment_of_nothing(spark, nothing):
    assert alignment.align(nothing, BYTE, PIECE).collect() == [] and alignment.pair_counts(nothing, BYTE, PIECE).collect() == []
    none = alignment.align(frame(spark, [(1, None), (2, "")]), BYTE, PIECE).collect()
    assert sorted(tuple(r) for r in none) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_large_groups_count_equal_links_once():
    ids = np.array([5] * 300 + [6] * 300), np.array([7] * 400)
    group, pair, times = alignment.linked((np.zeros(600, np.int64), np.zeros(400, np.int64)), ids)
    assert sorted(zip(pair.tolist(), times.tolist())) == [(5 << 32 | 7, 120_000), (6 << 32 | 7, 120_000)] and not group.any()


def test_merging_runs_of_many_frames(monkeypatch):
    monkeypatch.setattr(alignment, "FRAME", 7)
    r, want, runs = random.Random(1), Counter(), []
    for _ in range(9):
        some = {r.randrange(400) << 32 | r.randrange(3): r.randrange(1, 9) for _ in range(r.randrange(0, 200))}
        want.update(some)
        runs.append(alignment.packed([(np.array(sorted(some), np.int64), np.array([some[k] for k in sorted(some)], np.int64))]))
    parts = list(alignment.merged(runs))
    assert {int(k): int(n) for ks, ns in parts for k, n in zip(ks, ns)} == want
    assert (np.diff(np.concatenate([k for k, _ in parts])) > 0).all()
    top = defaultdict(int)
    for k, n in want.items():
        top[k >> 32] = max(top[k >> 32], n)
    found = {int(k): int(n) for ks, ns in alignment.answered(iter(parts)) for k, n in zip(ks, ns)}
    assert found == {k: 2 * n + (n == top[k >> 32]) for k, n in want.items()}
    assert list(alignment.merged([])) == [] and list(alignment.merged([b""])) == []


# ------------------------------------------------------------------------------------------------ sharding


def record(i, t):
    return i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())


def placed(spark, rows, shards=8, parts=3):
    found = sharding.records(frame(spark, rows, parts))
    path = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    sharding.save(sharding.first_map(spark, shards), path)
    sharding.save(sharding.rebalanced(sharding.load(spark, path), sharding.loads(found), shards), path)
    return found, path, sharding.assigned(found, sharding.load(spark, path)).collect()


MANY = ROWS + [(100 + i, prose(1 + i % 90, i)) for i in range(1500)] + [(50, "hot")] * 900


def test_shards_hold_nearly_equal_bytes_and_every_record_once(spark):
    found, path, rows = placed(spark, MANY)
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [record(*r) for r in MANY])
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    largest = max(len((t or "").encode()) + 1 for _, t in MANY)
    assert set(held) == set(range(8)) and max(held.values()) - min(held.values()) <= largest
    # apart from the shard with the longest text, all are nearly equal
    rest = sorted(held.values())[:-1] if largest > sum(held.values()) / 8 else held.values()
    assert max(rest) - min(rest) < 0.02 * max(rest)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.map_version for r in rows} == {1}
    hot = Counter(r.virtual_slot for r in rows if r.doc_id == 50)
    assert len(hot) == 900                                      # a repeated row is dealt round the slots


def test_a_record_keeps_its_slot_whatever_else_there_is(spark):
    at = {(r.doc_id, r.text_crc32): r.virtual_slot for r in sharding.records(frame(spark, ROWS[5:])).collect()}
    more = {(r.doc_id, r.text_crc32): r.virtual_slot for r in sharding.records(frame(spark, MANY, 5)).where("copies = 1").collect()}
    assert all(more[k] == v for k, v in at.items() if k in more)


def test_copies_beyond_the_number_of_slots(spark):
    n = sharding.SLOTS + 37
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    found = sharding.records(rows).collect()
    assert len(found) == sharding.SLOTS and Counter(r.copies for r in found) == {1: sharding.SLOTS - 37, 2: 37}


def test_growing_moves_slots_into_the_new_shard_only_and_versions_stay(spark):
    found, path, _ = placed(spark, MANY)
    old = {r.virtual_slot: r.shard for r in sharding.load(spark, path).collect()}
    assert sharding.save(sharding.grown(sharding.load(spark, path), sharding.loads(found), 8), path) == 2
    new = {r.virtual_slot: r.shard for r in sharding.load(spark, path).collect()}
    assert set(old) == set(new) == set(range(sharding.SLOTS))
    assert {new[s] for s in old if new[s] != old[s]} == {8}
    held = Counter()
    for r in found.collect():
        held[new[r.virtual_slot]] += r.size * r.copies
    assert held[8] > 0.8 * sum(held.values()) / 9
    assert {r.virtual_slot: r.shard for r in sharding.load(spark, path, 1).collect()} == old
    assert {r.shard for r in sharding.load(spark, path, 0).collect()} == set(range(8))


def test_a_version_is_written_once(spark):
    path = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    assert not sharding.exists(spark, path)
    sharding.save(sharding.first_map(spark, 2), path)
    with pytest.raises(Exception, match="(?i)exist"):
        sharding.first_map(spark, 3).write.parquet(f"{path}/version=0")


def test_shard_files_hold_the_rows_as_they_are(spark):
    found, path, rows = placed(spark, MANY[:200] + MANY[-60:])
    docs = frame(spark, MANY[:200] + MANY[-60:]).drop("shard")
    out = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, sharding.load(spark, path), out)
    back = spark.read.parquet(out)
    same([tuple(r) for r in back.select(*docs.columns).collect()], [tuple(r) for r in docs.collect()])
    same([(*record(r.doc_id, r.text), r.shard) for r in back.collect()], [(r.doc_id, r.size, r.text_crc32, r.shard) for r in rows])


def test_sharding_of_nothing(spark, nothing):
    assert sharding.records(nothing).collect() == []
    _, path, rows = placed(spark, [])
    assert rows == [] and sharding.load(spark, path).count() == sharding.SLOTS


def test_the_sharding_plan_has_no_python(spark):
    from pyspark.sql import SparkSession  # noqa: F401
    df = QUERIES["op12_virtual_slots"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|InPandas|CartesianProduct|NestedLoop", plan)


# ------------------------------------------------------------------------------------------------ ranked search


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def ranked(rows, items, k=10):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows]
    n_docs, length = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out, texts = [], defaultdict(set)
    for i, t in items:
        texts[i].add(t)
    for item, some in texts.items():
        asked = Counter(x for t in some for x in terms(t))
        scored = []
        for i, c, n in docs:
            score = 0
            for t, times in asked.items():
                if c[t]:
                    m = 25 + (75 * n * n_docs) // length
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


ITEMS = [
    (1, "the quick FOX"), (2, "Fox fox fox brown"), (3, None), (4, ""), (5, "!!! ..."), (6, LONG[:3000]), (7, prose(400, 9)[:500]), (8, "日本語 naïve x"),
    (9, "quick brown"), (9, "quick brown"), (9, "12 end"), (10, "nowhere found"), (None, "no id"), (11, "hot"), (12, "the quick brown"),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_search_equals_scoring_every_document(spark, parts):
    rows = ROWS + [(200 + i, prose(3 + i % 40, i % 7)) for i in range(60)] + [(300 + i, "hot tie") for i in range(40)]
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, rank int").repartition(3)
    same([tuple(r) for r in lexical.search(frame(spark, rows, parts), items).collect()], ranked(rows, ITEMS))


def test_more_queries_than_one_wave(spark, monkeypatch):
    monkeypatch.setattr(lexical, "WAVE_BYTES", 1500)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.plans(items).count() > 1
    same([tuple(r) for r in lexical.search(frame(spark, ROWS), items, k=3).collect()], ranked(ROWS, ITEMS, 3))


def test_search_of_nothing(spark, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(nothing, items).collect() == []
    assert lexical.search(frame(spark, ROWS), items.limit(0)).collect() == []
    assert lexical.search(frame(spark, [(1, None), (2, "")]), items).collect() == []


def test_mining_shares_sums_and_keeps_every_item_whole():
    r = random.Random(3)
    common = list(range(12))
    items = [dict.fromkeys(common[: r.randrange(4, 12)], 1) | {r.randrange(12, 60): r.randrange(1, 4) for _ in range(6)} for _ in range(40)] + [{}]
    nodes, roots = lexical.mine(items)
    worth = []
    for at, parts in enumerate(nodes):
        assert all(p < at for p in parts)
        worth.append(Counter({at: 1}) if not parts else sum((worth[p] for p in parts), Counter()))
    for item, root in zip(items, roots):
        total = Counter()
        for node, times in root:
            total.update({t: n * times for t, n in worth[node].items()})
        assert total == item
    sums = sum(len(p) for p in nodes) + sum(len(x) for x in roots)
    assert sums < 0.8 * sum(len(i) for i in items)             # fewer additions than item by item
    assert lexical.mine([]) == ([], [])
