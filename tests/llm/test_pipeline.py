"""Every stage of the pipeline on its own input, against brute force."""
from collections import Counter

import pytest

import corpus_pipeline
from tests_llm_rows import DOCS, prose

STAGES = dict(corpus_pipeline.STAGES)
BASE = prose(200, 1)
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.replace(" ", "\n ", 3), "en", None, 1), (4, BASE + " tail", "en", "b", 1), (5, None, None, "b", 1),
    (6, "", "en", "b", 1), (7, "1 2 3", "en", "b", 1), (8, "solo", "fr", "c", None), (8, "solo", "fr", "c", None), (None, "other words here", None, "c", 1),
] + [(20 + i, prose(60, 20 + i), ("en", "de")[i % 2], "src%d" % (i % 3), 5) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


def bag(df):
    return Counter(map(tuple, df.collect()))


def test_language_stage_drops_only_what_has_no_letter(spark, docs):
    out = STAGES["language_id"](spark, docs, "")
    assert out.columns == docs.columns and bag(out) == Counter(r for r in ROWS if r[1] and any(c.isalpha() for c in r[1]))


def test_dedup_stage_keeps_the_best_of_each(spark, docs):
    out = STAGES["exact_dedup"](spark, docs, "")
    best = {}
    for r in ROWS:
        k = "".join((r[1] or "").split())
        best[k] = min(best.get(k, r), r, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
    assert out.columns == docs.columns and bag(out) == Counter(best.values())


def test_near_duplicate_stage_keeps_the_smallest_id(spark, docs):
    out = STAGES["ngram_jaccard"](spark, docs, "")
    assert out.columns == docs.columns and bag(out) == Counter(r for r in ROWS if r[0] not in (2, 3, 4))


def test_near_duplicate_stage_tells_rows_apart_that_share_an_id(spark):
    rows = [(0, BASE, "en", "a", 1), (1, BASE, "en", "a", 1), (1, prose(90, 77), "en", "a", 1), (None, BASE + " end", "en", "a", 1), (5, BASE + " x", "en", "b", 2),
            (None, prose(80, 5), "en", "a", 1), (None, prose(80, 5) + " more", "en", "a", 1)]
    out = STAGES["ngram_jaccard"](spark, spark.createDataFrame(rows, DOCS), "")
    kept = bag(out)
    assert kept[rows[0]] == kept[rows[2]] == 1 and kept[rows[5]] + kept[rows[6]] == 1 and sum(kept.values()) == 3


def test_mix_stage_and_ids(spark, docs):
    out = STAGES["source_mix"](spark, docs, "")
    assert out.columns == docs.columns
    counts = Counter(r["doc_id"] for r in out.collect())
    assert max(counts.values()) <= 6 and set(counts) <= {r[0] for r in ROWS}
    ids = STAGES["bpe"](spark, out, "")
    assert Counter(r["doc_id"] for r in ids.collect()) == counts


def test_run_applies_all_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["n_tokens"] > 0 for r in out) and {1, 2, 4, 5, 6, 7}.isdisjoint({r["doc_id"] for r in out})
