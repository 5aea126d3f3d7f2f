"""Each operator against brute force, and on nulls, ties, repeated rows, clashing columns and empty tables."""
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from roadloom.llm import binary, bpe, chat, dedup, graph, hamming, jaccard, langid, lengths, maintext, mixing

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, `key` int, sig double"


def frame(spark, rows, parts=3):
    """Documents with columns whose names clash with those the operators use."""
    made = [(i, t, lang, src, len(t) if t else None, "x", None, 1, 0.5) for i, t, lang, src in rows]
    return spark.createDataFrame(made, DOCS).repartition(parts)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


BASE = prose(200, 1)
#: Nulls, empty and white texts, one word, exact copies, copies that differ in white space, near copies, a long text, repeated rows.
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace(" ", "\n ", 3), "en", None), (4, BASE + " tail", "en", "b"),
    (5, None, None, "b"), (6, "", "en", "b"), (7, " \n\t", None, None), (8, "One", "fr", "c"), (9, "one", "fr", "c"), (9, "one", "fr", "c"),
    (10, prose(4000, 2), "de", "a"), (None, BASE, None, "a"), (11, "a <|endoftext|>b  c d \x1c é É", "es", "d"), (12, BASE.upper(), "en", "a"),
    (13, prose(150, 3) + " " + BASE, "en", "c"), (14, " leading and trailing ", "en", "c"), (15, "12 34", None, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def white(t):
    return (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")


def classes(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = up[b], up[a]
            up = [new if u == old else u for u in up]
    low = {u: min((rows[i][0] for i in range(len(rows)) if up[i] == u and rows[i][0] is not None), default=None) for u in up}
    return sorted(((rows[i][0], len(sets[i]), low[up[i]]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80), (2, 50)])
def test_components_are_those_of_all_pairs(spark, k, percent, monkeypatch):
    r, rows = random.Random(k), list(ROWS)
    for i in range(60):  # a dense group in which not all are linked with each other
        words = BASE.split()
        for _ in range(r.randint(0, 14)):
            words[r.randrange(len(words))] = "w%d" % r.randrange(10**6)
        rows.append((100 + i, " ".join(words), "en", "a"))
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 4000)  # the group is dealt into pairs of blocks
    got = jaccard.components_of(frame(spark, rows, 5), k=k, percent=percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=repr) == classes(rows, k, percent)


@pytest.mark.parametrize("k", [1, 4, 5, 8])
def test_blocks_of_few_words_have_shingles(k):
    for sizes in itertools.product(range(10), repeat=2):
        bodies = [prose(n, i).encode() for i, n in enumerate(sizes)]
        assert [len(h) for h in jaccard.shingles(bodies, k)] == [len(c) for c in classes_sets(bodies, k)]


def classes_sets(bodies, k):
    for b in bodies:
        w = b.split()
        yield {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("n", range(6))
def test_components_of_one_short_document(spark, n):
    got = jaccard.components_of(frame(spark, [(1, prose(n, 1), "en", "a")], 1), k=5).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(1, int(n > 0), 1)]


def test_components_of_a_chain(spark):
    edges = spark.range(40).selectExpr("id + 1 AS a", "id AS b").union(spark.createDataFrame([(7, 7), (90, 80)], "a long, b long"))
    got = dict(map(tuple, graph.components(edges).collect()))
    assert got == dict.fromkeys(range(41), 0) | {90: 80, 80: 80}


def test_exact_copies(spark, docs, monkeypatch):
    for most in (dedup.TRIE_BYTES, 50):  # 50: every subtree is handed on at once
        monkeypatch.setattr(dedup, "TRIE_BYTES", most)
        got = dedup.copies(docs).collect()
        assert len(got) == len(ROWS)
        groups = defaultdict(list)
        for i, t, *_ in ROWS:
            groups[hashlib.sha256(white(t)).hexdigest()].append((-len(t or ""), i is None, i or 0, i))
        for r in got:
            own = groups[r["text_sha256"]]
            assert (r["keep_id"], r["group_size"]) == (min(own)[3], len(own))
        kept = [r["doc_id"] for r in got if r["kept"]]
        assert len(kept) == len(groups) and sorted(kept) == sorted(min(g)[3] for g in groups.values())


def test_trie_splits_and_hands_over():
    trie, keys = dedup.Trie(), [b"romane", b"romanus", b"roman", b"", b"rom\x00", b"\xff", b"romane"]
    for key in keys:
        trie.owner(key).append(key)
    trie.owner(b"romance").append(b"romance")
    found = dict(trie.take())
    assert set(found) == {*keys, b"romance"} and all(set(v) == {k} for k, v in found.items()) and len(found[b"romane"]) == 2


def test_bpe_is_the_librarys(spark, docs, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 2000)
    t = Tokenizer.from_file(WORD)
    want = []
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        said = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(said.encode()).hexdigest(), said))
    full = bpe.encode(docs, WORD, with_ids=True)
    got = full.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    joined = bpe.decode(full, WORD).collect()
    assert sorted(((r["doc_id"], r["decoded"]) for r in joined), key=repr) == sorted(((w[0], w[4]) for w in want), key=repr)


def test_token_files_are_the_librarys(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "BLOCK_IDS", 700)
    binary.write(docs, str(tmp_path / "ids"), BYTE, 2)
    got = binary.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    t, at = Tokenizer.from_file(BYTE), 0
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    want = sorted((zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, x, *_ in ROWS))
    assert sorted(r["ids_crc32"] for r in got) == want
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]


@pytest.mark.parametrize("values", [[1], [0, 0, 5], [3, 3, 900, 901, 10**6], list(range(1, 4000, 3)), [2**33, 2**33 + 1]])
def test_elias_fano_selects(values):
    ef = binary.EliasFano.of(np.array(values))
    assert ef.all().tolist() == values and [ef.select(i) for i in range(len(values))] == values


def test_histogram_answers_for_every_limit(spark, docs):
    t = Tokenizer.from_file(BYTE)
    n = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x, *_ in ROWS)
    absent = next(x for x in range(2, 10**4) if x not in n)
    asked = [1, absent, 50, n[-1], 10**6, 10**6]
    hist = lengths.histogram(lengths.counted(docs, BYTE), limits=asked, shares=[0.0, 0.5, 0.77, 1.0]).cache()
    assert {r["length"] for r in hist.collect()} == {*n, *asked}
    for r in hist.collect():
        m = r["length"]
        want = (n.count(m), m * n.count(m), sum(x >= m for x in n), sum(x for x in n if x >= m), sum(x <= m for x in n), sum(x for x in n if x <= m), sum(min(x, m) for x in n))
        assert tuple(r)[1:8] == want and r["is_limit"] == (m in asked)
    limits = {r["limit"]: tuple(r)[1:] for r in lengths.for_limits(hist).collect()}
    assert limits == {m: (sum(x > m for x in n), sum(min(x, m) for x in n), sum(max(0, x - m) for x in n)) for m in asked}
    shares = {r["share"]: r["length"] for r in lengths.quantiles(hist).collect()}
    assert shares == {s: n[max(math.ceil(s * len(n)), 1) - 1] for s in (0.0, 0.5, 0.77, 1.0)}


def test_nearest_codes_are_those_of_all_pairs(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=64).tolist()) for i in range(150)] + [(200 + i, [1.0] * 64) for i in range(30)]
    rows += [(300, None), (301, [1.0] * 63), (302, [float("nan")] * 64), (None, [1.0] * 64), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, code int")
    codes = {i: np.array(v) >= 0 for i, v in rows if i is not None and v and len(v) == 64 and v[0] == v[0]}
    got = defaultdict(list)
    for x in hamming.top_k(df, df.where("vec_id % 20 = 0"), 64, 7).collect():
        got[x["query_id"]].append((x["rank"], x["distance"], x["neighbor_id"]))
    assert set(got) == {i for i in codes if i % 20 == 0}
    for q, found in got.items():
        want = sorted((int((codes[q] != c).sum()), i) for i, c in codes.items() if i != q)[:7]
        assert sorted(found) == [(n + 1, d, i) for n, (d, i) in enumerate(want)]


def test_chats_are_read_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>[/ROLE]x", "", None, "plain é\U0001f600", "$1 \\ [ROLE]", "<s>[ROLE]user[/ROLE]hi</s>"]
    rows = [(i % 3 if i % 4 else None, i // 2, ("user", "assistant", None, "a</s>[/ROLE]b")[i % 4], t, 9) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by = defaultdict(list)
    for c, turn, role, text, _ in rows:
        by[c].append((turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [t[1:] for t in turns]
        assert got[c]["loss_text"] == "".join(t[2] for t in turns if t[1] == "assistant")
    assert "Python" not in made._jdf.queryExecution().toString()


def test_languages_are_told_apart(spark):
    words = {"en": "the of and to in that was with for", "de": "der die und zu den das nicht mit sich", "fr": "le la les et des est pour dans une", "es": "el los las y del que para con por"}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(words[lang].split()) for _ in range(30)), lang, "s") for i, lang in enumerate(list(words) * 30)]
    rows += [(500, None, "en", "s"), (501, "12 !", "en", "s"), (None, "the of and", None, "s"), (502, "", None, None)]
    df = frame(spark, rows)
    model = langid.fit(df, sample=20)
    got = {x["doc_id"]: x for x in langid.identify(df, model).collect()}
    for i, _, lang, _ in rows[:120]:
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[None]["lang_pred"] == "en" and not got[None]["held_out"]
    blind = langid.identify(df.withColumns({"lang": F.lit("xx"), "source": F.lit("xx")}), model)
    assert {x["doc_id"]: x["lang_pred"] for x in blind.collect()} == {i: x["lang_pred"] for i, x in got.items()}


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, full, left = {s: weights[i % 3] for i, s in enumerate(names)}, {}, sum(sizes.values())
    while True:
        open_, rest = [s for s in names if s not in full], left - sum(full.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark, docs):
    rows = ROWS + [(1000 + i, prose(40 + i, i), "en", "src%d" % (i % 7) if i % 5 else "big") for i in range(300)]
    df = frame(spark, rows)
    got = mixing.mix(df, block_words=4).collect()
    again = mixing.mix(df.repartition(7), block_words=4).collect()
    pick = lambda found: sorted(((r["doc_id"], r["size"], r["taken"]) for r in found), key=repr)
    assert pick(got) == pick(again) and len(got) == len(rows)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"]) == sorted((i, len((t or "").encode().split())) for i, t, *_ in rows if i)
    want = fill(sizes)
    for s in sizes:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 20
    slots = mixing.schedule(mixing.targets(spark.createDataFrame([("sa", "a", 3000), ("sb", "b", 9000)], "key string, source string, size long")), 4)
    first = slots.where("slot < 300").groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in first} == {"sa": pytest.approx(214, abs=3), "sb": pytest.approx(86, abs=3)}


def test_mixed_rows_hold_the_words_that_are_taken(spark):
    df = frame(spark, [(i, prose(30 + i, i), "en", "src%d" % (i % 4)) for i in range(80)])
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert dict(words) == {i: n for i, n in taken.items() if n}


def brute_cut(surplus, edges):
    best = None
    for side in itertools.product([False, True], repeat=len(surplus)):
        cost = sum(max(0, s) if not x else max(0, -s) for s, x in zip(surplus, side)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    r = random.Random(3)
    for _ in range(150):
        n = r.randint(1, 8)
        surplus = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(1, 6)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        side = maintext.minimum_cut(surplus, edges)
        cost = sum(max(0, s) if not x else max(0, -s) for s, x in zip(surplus, side)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost == brute_cut(surplus, edges)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header>Site</header><div class="cookie-notice"><p>We use cookies on this site, a lot of them.</p></div><article><h1>A  head</h1>
<p><b>First &amp; best<br>line.<p>Short.</p><script>var t="</p>";</script><ul><li>one<li>two</ul></article>
<aside class="sidebar"><p>Read this other article now, it is good.</p></aside><section id="comments"><p>A reader writes a long comment here.</p></section>
<form><p>Sign up for news.</p></form><footer>&copy; all</footer>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE, 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", "<p>no end", 3), (1, "u", PAGE, 3), (4, "u", "<article>" + "<p>word</p>" * 3000, 3)]
    got = maintext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[1] == "A head\n\nFirst & best line.\n\nShort.\n\none\n\ntwo"
    assert text[2] == text[3] == "" and text[4] == "\n\n".join(["word"] * 3000)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


TALE = " ".join(["This paragraph of the article has some words."] * 12)
SIDE = "<div class='sidebar'><p>Read this other story now, it is good.</p></div>"


@pytest.mark.parametrize("page", [
    "<div class='has-sidebar'><article><p>{}</p></article>" + SIDE + "</div>",
    "<div id='page' class='header-fixed'><article><p>{}</p></article>" + SIDE + "</div>",
    "<div class='nav-open'><div class='ads-on'><main><p>{}</p></main></div></div>" + SIDE,
    "<div class='layout with-sidebar'><div class='content'><p>{}</p></div>" + SIDE + "</div>",
    "<main class='sidebar-right'><p>{}</p>" + SIDE + "</main>",
    "<div class='comments-on'><main><p>{}</p></main></div>",
    "<main><article><p>{}</p><div class='comments'><article><p>A reader writes a long comment here.</p></article></div></article></main>",
    "<article><p>{}</p></article><section id='comments'><article><p>A reader writes a long comment here.</p></article></section>",
    "<article><p>{}</p></article><nav class='has-menu'><article><p>Go to another page of this site here.</p></article></nav>",
])
def test_wrappers_of_the_layout_keep_the_article(page):
    assert maintext.main_text(page.format(TALE)) == TALE


def test_empty_tables(spark, nothing, tmp_path):
    assert jaccard.components_of(nothing).isEmpty() and dedup.copies(nothing).isEmpty() and bpe.encode(nothing, WORD).isEmpty()
    assert langid.identify(nothing, langid.fit(nothing)).isEmpty() and mixing.mix(nothing).isEmpty() and mixing.mixed_rows(nothing).isEmpty()
    assert lengths.histogram(lengths.counted(nothing, BYTE)).isEmpty()
    (limit,) = lengths.histogram(lengths.counted(nothing, BYTE), limits=[9], shares=[0.5]).collect()
    assert tuple(limit) == (9, 0, 0, 0, 0, 0, 0, 0, True, [])
    binary.write(nothing, str(tmp_path / "none"), BYTE, 2)
    assert binary.read(spark, str(tmp_path / "none")).isEmpty()
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(chats)).isEmpty()
    assert maintext.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.top_k(vectors, vectors, 64).isEmpty()


PROSE = "<p>This is a long paragraph of real prose, with several words in it, and an end.</p>"


@pytest.mark.parametrize("page, found", [
    ("<form id='aspnetForm'><article>{}{}</article></form>", 2), ("<form><main>{}{}</main></form>", 2), ("<article class='post share-enabled'>{}</article>", 1),
    ("<article class='post comments-open'>{}</article>", 1), ("<article>{}<form><p>Sign up here for more of our news, please do it.</p></form></article>", 1),
    ("<div class='comments'><article class='comment'>{}</article></div>", 0), ("<article>{}</article><form>{}</form>", 1),
])
def test_forms_and_state_words_around_an_article(page, found):
    assert maintext.main_text(page.replace("{}", PROSE)).count("real prose") == found


def test_deep_pages_take_time_in_proportion():
    import time
    start = time.process_time()
    maintext.main_text("<div>x " * 30_000)
    maintext.main_text("<b>x</i> " * 30_000)
    assert time.process_time() - start < 8


class _FirstTask:
    @staticmethod
    def get():
        return _FirstTask()

    def partitionId(self):  # noqa: N802
        return 0


def test_jaccard_asks_compress_below_ten_bytes_a_shingle(monkeypatch):
    monkeypatch.setattr(jaccard, "TaskContext", _FirstTask)
    rng = random.Random(3)
    bodies = [" ".join(str(rng.randrange(10**6)) for _ in range(300)).encode() for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(bodies)], ["doc_id", "body"])
    rows = [r for b in jaccard._blocks(4, 8)([batch]) for r in b.to_pylist() if r["kind"] == "ask"]
    size = sum(len(pa.compress(r["hashes"] + r["refs"], codec="lz4", asbytes=True)) for r in rows)
    assert size < 10 * 300 * 297


def test_bpe_blocks_hold_numbers_of_words_and_not_their_texts(monkeypatch):
    monkeypatch.setattr(bpe, "TaskContext", _FirstTask)
    rng = random.Random(3)
    words = [b"%d" % rng.randrange(1000) for _ in range(5000)]
    bodies = pa.array([b" ".join(words[i % 50 :]) for i in range(400)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), bodies], ["doc_id", "body"])
    list(bpe._split("docs", 8)([batch.slice(0, 2)]))
    tracemalloc.start()
    (block,) = bpe._split("docs", 8)([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = sum(np.frombuffer(block.column("sizes")[0].as_py(), "<u4").tolist())
    assert n == sum(len(words) - i % 50 for i in range(400))
    assert peak < 18 * n


def test_bpe_steps_hold_little_beside_their_words(monkeypatch):
    monkeypatch.setattr(bpe, "TaskContext", _FirstTask)
    rng = random.Random(4)
    words = [b"%x" % rng.randrange(60_000) for _ in range(6000)]
    bodies = [b" ".join(words[i:]) for i in range(100)] + [None, b"", b" \n", "  one \xa0".encode()]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(103), None], pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "body"])
    n = sum(len((x or b"").split()) for x in bodies)

    def traced(work):
        tracemalloc.start()
        out = work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    list(bpe._split("words", 4)([batch.slice(0, 2)]))
    found, peak = traced(lambda: pa.Table.from_batches(bpe._split("words", 4)([batch])))
    assert peak < 9.5 * n
    places = pa.Table.from_batches(bpe._split("docs", 4)([batch]))
    assert places.num_rows == -(-n // (1 << 16)) and max(map(len, places["places"].to_pylist())) <= 4 << 16
    ids = pa.concat_tables([bpe._encode(WORD)(found.slice(i, 1)) for i in range(found.num_rows)])
    bpe.pieces(WORD)
    places = places.take(list(reversed(range(places.num_rows))))
    got, peak = traced(lambda: bpe._assemble(WORD, False)(ids, places))
    assert peak < 12 * n
    t = Tokenizer.from_file(WORD)
    for row, i, body in zip(got.to_pylist(), batch["doc_id"].to_pylist(), bodies, strict=True):
        want = t.encode((body or b"").decode(), add_special_tokens=False).ids
        said = t.decode(want, skip_special_tokens=False).encode()
        assert (row["doc_id"], row["n_tokens"]) == (i, len(want)) and row["decoded_sha256"] == hashlib.sha256(said).hexdigest()
        assert row["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
