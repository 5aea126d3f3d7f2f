import hashlib
import json
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.constants import AREAS, SEGMENT_LEAVES
from roadloom.functions import geo
from roadloom.operators import (
    admission, audit, cells, diff, estimate, explore, logs, profile, proximity, query, scoring, skew, stats,
)


# ---------------------------------------------------------------- skew

def test_skew_join_equals_plain_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(0 if rng.random() < 0.6 else rng.randrange(40) or None, i % 7) for i in range(3000)], "k int, v int")
    lookup = spark.createDataFrame([(k, f"n{k}") for k in range(0, 40, 2)] + [(0, "again")], "k int, name string")
    assert [r["k"] for r in skew.hot_keys(rows, ["k"], 4).collect()] == [0]
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.skew_join(rows, lookup, ["k"], how)
        want = rows.join(lookup, ["k"], how)
        key = lambda r: tuple(str(v) for v in r)
        assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key), how


def test_copies_of_one_row_are_spread(spark):
    rows = spark.createDataFrame([(1, 1)] * 400, "k int, v int").repartition(8)
    joined = skew.skew_join(rows, spark.createDataFrame([(1, "x")], "k int, name string"), ["k"])
    assert joined.count() == 400


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_quantiles_equal_numpy(spark, partitions):
    rng = random.Random(2)
    rows = [(g, float(rng.choice([1, 2, 2, 2, 5, 8, rng.random()]))) for g in ("a", "b") for _ in range(501)]
    rows += [("one", 7.0), ("none", None), (None, 1.0), (None, 2.0)]
    out = skew.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], partitions)
    got = {(r["g"], r["p"]): r["quantile"] for r in out.collect()}
    assert len(got) == 4 * 5
    for g in ("a", "b", "one", None):
        values = [v for k, v in rows if k == g and v is not None]
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[g, p] == pytest.approx(np.quantile(values, p)), (g, p)


# ---------------------------------------------------------------- regions

def test_cells_equal_brute_force(spark):
    rng = random.Random(3)
    star = [(5 + r * np.cos(a), 5 + r * np.sin(a)) for a, r in zip(np.linspace(0, 6.283, 15)[:-1], [4.013, 1.517] * 7)]
    hole = [(4.905, 4.905), (5.105, 4.911), (5.107, 5.103), (4.903, 5.109)]
    shapes = {"star": [star + star[:1], hole + hole[:1]], "box": [[(0.001, 0.003), (9.503, 0.007), (9.507, 9.501), (0.009, 9.507), (0.001, 0.003)]]}
    edges = [(n, *a, *b) for n, rings in shapes.items() for ring in rings for a, b in zip(ring, ring[1:])]
    points = {(rng.randrange(-20, 1000), rng.randrange(-20, 1000)) for _ in range(1500)}
    points |= {(x, 500) for x in range(400, 600)}

    def brute(cx, cy):
        x, y = cx / 100.0, cy / 100.0
        for name in sorted(shapes):
            crossings = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
                            for n, x1, y1, x2, y2 in edges if n == name)
            if crossings % 2:
                return name
        return None

    edge_df = spark.createDataFrame([tuple(float(v) if i else v for i, v in enumerate(e)) for e in edges],
                                    "state string, x1 double, y1 double, x2 double, y2 double")
    got = cells.cell_regions(spark.createDataFrame(sorted(points), "cx bigint, cy bigint"), edge_df).collect()
    assert {(r["cx"], r["cy"]): r["state"] for r in got} == {p: brute(*p) for p in points}
    assert len(got) == len(points) and {r["state"] for r in got} == {"box", "star", None} - ({"star"} if not any(r["state"] == "star" for r in got) else set())


@pytest.fixture
def squares(spark):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0), (x, 0.0)]
    rows = [(s, *a, *b) for s, x in (("B", 0.0), ("A", 1.0)) for a, b in zip(ring(x), ring(x)[1:])]
    return spark.createDataFrame(rows, "state string, x1 double, y1 double, x2 double, y2 double")


def test_every_segment_counts_once(spark, squares):
    rows = [("r", "trunk", i % 3 == 0, 1.0, 50 + (i % 4) * 50, 50) for i in range(100)] + [("r", "trunk", True, None, 999, 999)]
    seg = spark.createDataFrame(rows, "release string, class string, is_named boolean, length_km double, cx bigint, cy bigint")
    out = {r["state"]: r for r in stats.release_stats(seg, squares).collect()}
    assert {k: v["segments"] for k, v in out.items()} == {"B": 25, "A": 50, "outside DE": 26}
    assert out["B"]["mean_segment_m"] == 1000.0 and out["outside DE"]["length_km"] == 25.0
    assert {r["km"] for r in stats.national_km(stats.release_stats(seg, squares)).collect()} == {75.0}


def test_shared_border_belongs_to_one_side(spark, squares):
    got = cells.cell_regions(spark.createDataFrame([(100, 50), (0, 0), (200, 50), (50, 100)], "cx bigint, cy bigint"), squares)
    assert {(r["cx"], r["cy"]): r["state"] for r in got.collect()} == {(100, 50): "A", (0, 0): "B", (200, 50): None, (50, 100): None}


def test_features_without_a_cell_are_outside(spark, squares):
    rows = spark.createDataFrame([(1, 50, 50), (2, None, 50), (3, 50, None), (4, None, None), (5, 900, 50)], "id int, cx bigint, cy bigint")
    got = cells.attach_regions(rows, squares).select("id", cells.region_or_outside().alias("state")).collect()
    assert {r["id"]: r["state"] for r in got} == {1: "B", 2: "outside DE", 3: "outside DE", 4: "outside DE", 5: "outside DE"}
    assert [r["id"] for r in cells.attach_regions(rows, squares, keep_outside=False).collect()] == [1]


def test_features_keep_their_copies_through_the_lookup(spark, squares):
    rows = spark.createDataFrame([(i, 50, 50) for i in range(200)] + [(999, 150, 50), (1000, 900, 50)], "id int, cx bigint, cy bigint")
    assert cells.attach_regions(rows, squares).groupBy("state").count().collect().__len__() == 3
    assert cells.attach_regions(rows, squares, keep_outside=False).count() == 201


# ---------------------------------------------------------------- distances

def test_distance_join_equals_brute_force(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(8.4, 8.9), rng.uniform(50.0, 50.3)) for i in range(400)] + [(1000 + i, 8.6, 50.1) for i in range(300)]
    pts += [(2000, 179.999, 10.0), (2001, -179.999, 10.0), (2002, 5.0, 89.9995), (2003, -170.0, 89.9995), (2004, 10.0, 78.0)]
    marks = [("a", 8.6, 50.1), ("b", 8.75, 50.22), ("line", 180.0, 10.0), ("pole", 100.0, 89.9999), ("north", 10.05, 78.0)]
    places = spark.createDataFrame(pts, "id int, lon double, lat double")
    spots = spark.createDataFrame(marks, "landmark string, to_lon double, to_lat double")
    for radius in (300.0, 2500.0):
        got = {(r["id"], r["landmark"]) for r in proximity.distance_join(places, spots, radius).collect()}
        pairs = places.crossJoin(spots).where(geo.distance_m("lon", "lat", "to_lon", "to_lat") <= radius)
        assert got == {(r["id"], r["landmark"]) for r in pairs.collect()} and len(got) > 300


@pytest.mark.parametrize("radius", [1.0, 40.0])
def test_distance_join_at_the_poles(spark, radius, monkeypatch):
    rng = random.Random(9)
    step = radius / 111_195
    marks = [(f"{sign:+}/{k}", rng.uniform(-180, 180), sign * (90 - k * step)) for sign in (1, -1) for k in (0.0, 0.4, 1.0, 1.5, 2.0, 2.6, 7.3)]
    marks += [("line", 179.99999999, 89.0), ("low", 8.0, 0.0), ("mid", -180.0, -45.0)]
    pts = [(i, rng.uniform(-180, 180), sign * (90 - abs(rng.gauss(0, 3)) * step)) for sign in (1, -1) for i in range(400)]
    pts += [(i, lon + rng.gauss(0, 0.6) * step / max(math.cos(math.radians(lat)), 0.01), min(max(lat + rng.gauss(0, 0.6) * step, -90.0), 90.0)) for i in range(40) for _, lon, lat in marks]
    pts += [(0, lon, lat) for lon in (-180.0, 0.0, 180.0) for lat in (90.0, -90.0)]
    places = spark.createDataFrame([(n, (lon + 180) % 360 - 180, lat) for n, (_, lon, lat) in enumerate(pts)], "id int, lon double, lat double")
    spots = spark.createDataFrame(marks, "landmark string, to_lon double, to_lat double")
    cells, join = [], proximity.skew_join
    monkeypatch.setattr(proximity, "skew_join", lambda a, b, keys: cells.append(b.groupBy("landmark").count()) or join(a, b, keys))
    got = [(r["id"], r["landmark"]) for r in proximity.distance_join(places, spots, radius).collect()]
    pairs = places.crossJoin(spots).where(geo.distance_m("lon", "lat", "to_lon", "to_lat") <= radius)
    assert sorted(got) == sorted((r["id"], r["landmark"]) for r in pairs.collect()) and len({m for _, m in got}) == len(marks)
    assert max(r["count"] for r in cells[0].collect()) <= 24


@pytest.mark.parametrize("lon, lat, radius", [(8.6, 50.1, 2000.0), (180.0, 10.0, 500.0), (0.0, 89.9999, 500.0)])
def test_radius_search_equals_plain_distance(spark, lon, lat, radius):
    rng = random.Random(5)
    pts = [(rng.gauss(lon, 0.02), rng.gauss(lat, 0.02)) for _ in range(500)] + [(-179.9999, 10.0), (170.0, 89.9999)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    want = df.where(geo.distance_m("lon", "lat", lon, lat) <= radius)
    assert sorted(proximity.within_radius(df, lon, lat, radius).collect()) == sorted(want.collect())


def test_area_filter_is_closed(spark):
    x0, y0, x1, y1 = AREAS["berlin"][1]
    df = spark.createDataFrame([(x0, y0), (x1, y1), (x1 + 0.01, y1)], "lon double, lat double")
    assert proximity.in_area(df, AREAS["berlin"][1], "lon", "lat").count() == 2


# ---------------------------------------------------------------- differences

def test_churn(spark):
    schema = "id string, length_km double"
    a = spark.createDataFrame([("kept", 1.0), ("longer", 2.0), ("gone", 4.0), ("gone", 4.0)], schema)
    b = spark.createDataFrame([("kept", 1.0005), ("longer", 2.5), ("new", 8.0)], schema)
    c = diff.churn(a, b).first()
    assert (c["kept"], c["added"], c["removed"], c["changed_length"]) == (2, 1, 1, 1)
    assert (c["added_km"], c["removed_km"], c["net_km"]) == (8.0, 4.0, 4.0)
    assert diff.removed_features(a, b).count() == 2 and diff.kept_features(a, b).count() == 2
    assert [r["id"] for r in diff.added_features(a, b).collect()] == ["new"]


# ---------------------------------------------------------------- footers

def _footers(spark, rows):
    out = []
    for f, g, x0, x1, y0, y1, size in rows:
        out += [(f, g, "bbox, xmin", 10, x0, x1), (f, g, "bbox, ymin", 10, y0, y1),
                (f, g, "geometry", size, None, None), (f, g, "routes", 999, None, None)]
    return spark.createDataFrame(out, "file_name string, row_group_id int, path_in_schema string, "
                                      "total_compressed_size bigint, mn double, mx double")


def test_estimate_counts_overlapping_groups_and_wanted_columns(spark):
    x0, y0, x1, y1 = AREAS["berlin"][1]
    meta = _footers(spark, [("u", 0, x0 - 1, x0 + 0.01, y0 - 1, y0 + 0.01, 300), ("u", 1, x1 + 1, x1 + 2, y0, y1, 400),
                            ("v", 0, x0, x1, y0, y1, 500), ("w", 0, None, None, None, None, 600)])
    e = estimate.estimate(meta, AREAS["berlin"][1], SEGMENT_LEAVES).first()
    assert (e["groups_kept"], e["groups_total"], e["bytes"], e["groups_without_statistics"]) == (2, 4, 840, 1)
    assert estimate.kept_footers(meta, AREAS["berlin"][1]).count() == 8


def test_boundary_estimate(spark):
    rows = [("a", 0, "country", 1, "AT", "DK"), ("a", 0, "geometry", 100, None, None), ("a", 0, "sources", 9, None, None),
            ("a", 1, "country", 1, "FR", "IT"), ("a", 1, "geometry", 200, None, None)]
    meta = spark.createDataFrame(rows, "file_name string, row_group_id int, path_in_schema string, "
                                       "total_compressed_size bigint, text_min string, text_max string")
    assert estimate.estimate_boundaries(meta).first()["bytes"] == 101


# ---------------------------------------------------------------- exploring

@pytest.fixture
def places(spark):
    rows = [(i, f"p{i}", "cafe" if i % 3 else "bar", 8.6 + i / 1000, 50.1) for i in range(30)]
    return spark.createDataFrame(rows, "id int, name string, category string, lon double, lat double")


def test_breakdown_uses_the_same_filter(places):
    out = explore.breakdown(places, "places", F.count(F.lit(1)), "count", F.col("id") < 9).collect()
    assert [(r["category"], r["count"]) for r in out] == [("cafe", 6), ("bar", 3)]
    assert explore.matching_places(places, F.col("id") < 9).count() == 9


def test_highlight_takes_offered_columns_and_literal_values(places):
    assert explore.highlight(places, "places", "category", "bar").count() == 10
    assert explore.highlight(places, "places", "lon", "8.6") is None
    assert explore.highlight(places, "places", "category", "x' OR '1'='1").count() == 0


def test_map_frames(spark):
    df = spark.createDataFrame([(9.0, 50.0, "Point", 9.0, "{}", "inn")], "lon double, lat double, geom_type string, bbox_min_lon double, geometry_geojson string, kind string")
    assert explore.map_frame(df, points=True).columns == ["lon", "lat", "kind"]
    assert explore.map_frame(df, points=False).columns == ["_geojson", "kind"]
    assert explore.map_frame(df.drop("geometry_geojson"), points=False).columns == ["lon", "lat", "kind"]
    with pytest.raises(ValueError):
        explore.map_frame(df.select("kind"), points=True)


def test_chart_shows_every_bar(spark):
    many = spark.range(80).selectExpr("concat('k', id) k", "id * 2 v", "double(id) lon")
    bars = explore.chart_frame(many).collect()
    assert len(bars) == 80 and tuple(bars[0]) == ("k79", 158.0)
    assert [tuple(r) for r in explore.chart_frame(many.selectExpr("sum(v) total")).collect()] == [("total", 6320.0)]
    assert explore.chart_frame(many.select("k")) is None and explore.chart_frame(many.select("k", "lon")) is None


# ---------------------------------------------------------------- profiles

def test_profile_and_summary(spark):
    df = spark.createDataFrame([("a", 1.0, 8.0, 50.0), ("b", None, 9.0, 51.0), ("a", 3.0, None, 52.0)], "s string, v double, LNG double, Lat double")
    rows = {r["column_name"]: r for r in profile.column_profile(df).collect()}
    assert (rows["v"]["non_null"], rows["v"]["null_pct"], rows["s"]["unique_values"]) == (2, 33.3, 2)
    n = {r["column_name"]: r for r in profile.numeric_summary(df, ["v"]).collect()}["v"]
    assert (n["n"], n["mean"], n["q1"], n["median"], n["q3"]) == (2, 2.0, 1.5, 2.0, 2.5) and n["std"] == pytest.approx(2 ** 0.5)
    assert profile.points(df).count() == 2
    assert profile.points(df.drop("LNG")) is None
    nan = profile.numeric_summary(spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")).first()
    assert (nan["n"], nan["mean"], nan["q3"], nan["max"]) == (2, 2.0, 2.5, 3.0)
    km = profile.line_summary(spark.createDataFrame([(1.0,), (None,), (2.0,)], "length_km double")).first()
    assert (km["total_length_km"], km["line_features"], km["mean_segment_m"]) == (3.0, 2, 1500.0)


def test_sample_is_reproducible(spark):
    df = spark.range(2000)
    first, second = (sorted(r["id"] for r in profile.sample_points(d, "id", 0.1).collect()) for d in (df, df.repartition(7)))
    assert first == second and 150 < len(first) < 250


@pytest.mark.parametrize("size", [0, 1, 37, 1999, 2000, 5000])
def test_sample_of_wanted_size(spark, size):
    df = spark.range(2000).selectExpr("IF(id % 100 = 0, NULL, id) AS id", "id AS n")
    found = [r["n"] for r in profile.exact_sample(df, "id", size).collect()]
    def place(n):
        return "g" if n % 100 == 0 else hashlib.md5(str(n).encode()).hexdigest()
    assert sorted(found) == sorted(sorted(range(2000), key=lambda n: (place(n), n))[:size])


def test_sample_where_one_key_has_most_rows(spark):
    df = spark.range(3000).selectExpr("IF(id < 2500, 7, id) AS id", "id AS n")
    assert profile.exact_sample(df, "id", 1200).count() == 1200 and profile.sample_rows(df, "n").count() == 3


# ---------------------------------------------------------------- statements

ALLOWED = ["SELECT avg(speed), min(day) FROM rides GROUP BY depot", "WITH late AS (SELECT * FROM rides WHERE delay > 9) SELECT depot FROM late",
           "SELECT 'insert coin' AS label", r"SELECT 'don\'t alter' AS label", 'SELECT "attach note" AS label', "DESCRIBE rides", "SUMMARIZE rides;"]
REFUSED = {
    "": "empty", "  -- nothing": "empty", "SELECT 2; SELECT 3": "several", "TRUNCATE TABLE trips": "kind", "USE other": "kind",
    "SELECT * FROM read_json('x')": "file", "SELECT grant FROM trips": "keyword: grant",
    r"WITH a AS (SELECT 'x\'' AS q) INSERT OVERWRITE DIRECTORY 'o' SELECT concat(q, 'y') FROM a": "keyword: INSERT",
}


def test_statement_audit(spark):
    out = {r["sql"]: r for r in audit.audit_statements(spark.createDataFrame([(s,) for s in [*ALLOWED, *REFUSED]], "sql string")).collect()}
    assert all(out[s]["allowed"] and out[s]["reason"] is None for s in ALLOWED)
    for s, reason in REFUSED.items():
        assert out[s]["reason"] == reason and not out[s]["allowed"], s


WRITES = [
    r"WITH t AS (SELECT 'a\'' AS q) INSERT OVERWRITE DIRECTORY '{0}/out' USING parquet SELECT concat(q, 'x') FROM t",
    r'WITH t AS (SELECT "a\"" AS q) INSERT OVERWRITE DIRECTORY "{0}/out" USING parquet SELECT q FROM t',
    "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM trips", "SELECT * FROM parquet.`{0}/p`", "SELECT (SELECT max(id) FROM text.`{0}/p`)",
    "DROP VIEW trips", "CREATE TABLE x AS SELECT 1", "SET a = b", "CACHE TABLE trips", "SELECT 1; SELECT 2", "", "EXPLAIN SELECT 1",
    "SELECT java_method('java.lang.System', 'exit', 1)", "WITH p AS (SELECT 1) SELECT * FROM parquet.`{0}/p`", "SUMMARIZE nowhere",
]


CALLS = [
    "SELECT `reflect`('java.lang.System', 'getProperty', 'user.home')", "SELECT reflect/* x */('java.lang.System', 'getProperty', 'user.home')",
    "SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT (SELECT max(try_reflect('a', 'b')) FROM rides)",
    "SELECT transform(array(1), x -> java_method('a', 'b'))", "SELECT * FROM rides WHERE id IN (SELECT reflect('a', 'b'))",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')", "SELECT * FROM rides LATERAL VIEW reflect('a', 'b') t",
    "WITH x AS (SELECT reflect('a', 'b') AS y) SELECT y FROM x", "SELECT count(*) OVER (ORDER BY reflect('a', 'b')) FROM rides",
    "SELECT * FROM rides r JOIN rides s ON reflect('a', 'b') = s.id", "VALUES (reflect('a', 'b'))", "SELECT * FROM rides, LATERAL (SELECT reflect('a', 'b'))",
    "SELECT own_code(id) FROM rides", "SELECT input_file_name()", "SELECT current_user()", "SELECT raise_error('x')", "SELECT no_such_function(1)",
]


def test_only_listed_functions_are_called(spark):
    spark.range(9).createOrReplaceTempView("rides")
    spark.udf.register("own_code", lambda x: x)
    for statement in CALLS:
        with pytest.raises(ValueError, match="^(function|expression): "):
            query.read_only(spark, statement)
    fine = """SELECT coalesce(upper(s), 'x'), CASE WHEN id > 2 THEN 1 END, CAST(id AS STRING), int('3'), row_number() OVER (ORDER BY id),
              get_json_object('{}', '$.a'), regexp_replace(s, 'a', 'b'), id div 2, s LIKE 'a%', typeof(id), named_struct('a', 1).a
              FROM (SELECT id, 'a' AS s FROM rides LATERAL VIEW explode(array(1, 2)) t AS n) WHERE id IN (SELECT max(id) FROM rides)"""
    assert query.read_only(spark, fine).count() == 2


def test_query_only_reads(spark, tmp_path):
    spark.range(40).createOrReplaceTempView("trips")
    spark.range(1).write.parquet(str(tmp_path / "p"))
    assert query.run_query(spark, "SELECT count(*) AS n FROM trips WHERE id IN (SELECT id FROM trips)", 5).iloc[0, 0] == 40
    assert len(query.run_query(spark, "WITH a AS (SELECT * FROM trips) SELECT * FROM a ORDER BY id; ", 7)) == 7
    assert len(query.run_query(spark, "SUMMARIZE trips", 5)) == 1 and len(query.run_query(spark, "SHOW TABLES", 50)) >= 1
    for statement in WRITES:
        with pytest.raises(ValueError):
            query.read_only(spark, statement.format(tmp_path))
    assert not (tmp_path / "out").exists()
    with pytest.raises(ValueError):
        scoring.expected_values(spark, [{"id": "q", "check": "number", "reference_sql": "DROP VIEW trips"}])


def test_runaway_query_is_stopped(spark):
    spark.range(4_000_000).createOrReplaceTempView("big")
    with pytest.raises(TimeoutError):
        query.run_query(spark, "SELECT count(*) FROM big a JOIN big b ON a.id + b.id > -1 AND a.id * b.id < -1", 10, timeout=1.5)
    assert query.run_query(spark, "SELECT 1 AS ok", 1).iloc[0, 0] == 1


# ---------------------------------------------------------------- scoring

def _score(spark, check, answer, expected, rel=0.0, tol=0.0, ok=True):
    df = spark.createDataFrame([(check, answer, expected, rel, tol, [(ok,)])],
                               "check string, answer string, expected array<string>, rel_tol double, abs_tol double, queries array<struct<ok boolean>>")
    return scoring.score_answers(df).first()


def test_scores(spark):
    assert _score(spark, "number", "There are 13 pharmacies.", ["13"])["passed"]
    assert not _score(spark, "number", "There are 5193 pharmacies.", ["13"])["passed"]
    assert _score(spark, "number", "460.27 km", ["460.3"], rel=0.01)["passed"]
    assert not _score(spark, "number", "470 km", ["460.3"], rel=0.01)["passed"]
    names = ["professional_service", "doctors_office"]
    assert _score(spark, "set", "Professional service and doctors office lead.", names)["passed"]
    partly = _score(spark, "set", "professional_service only", names)
    assert not partly["passed"] and "doctors_office" in partly["detail"]
    assert _score(spark, "refusal", "The data does not contain accident records.", [], ok=False)["passed"]
    assert _score(spark, "refusal", "Dazu enthält der Datensatz leider keine Angaben.", [])["passed"]
    assert not _score(spark, "refusal", "There were 312 accidents on the A5.", [])["passed"]
    assert not _score(spark, "number", None, ["13"], ok=False)["tool_ok"]
    with pytest.raises(Exception, match="unknown check"):
        _score(spark, "guess", "x", ["1"])


def test_expected_values_and_summary(spark, places):
    places.createOrReplaceTempView("places")
    questions = [
        {"id": "q1", "lang": "en", "check": "number", "reference_sql": "SELECT count(*) FROM places WHERE category = 'bar';", "abs_tol": 0.5},
        {"id": "q2", "lang": "de", "check": "set", "reference_sql": "SELECT category FROM places GROUP BY 1 ORDER BY count(*) DESC LIMIT 1"},
        {"id": "q3", "lang": "de", "check": "refusal"}]
    expected = scoring.expected_values(spark, questions)
    assert {r["id"]: r["expected"] for r in expected.collect()} == {"q1": ["10"], "q2": ["cafe"], "q3": []}
    answers = spark.createDataFrame(
        [("m", "q1", "10 bars", 1.0, [(True,)]), ("m", "q2", "bars", 3.0, [(False,)]), ("m", "q3", "leider", 2.0, [])],
        "model string, id string, answer string, seconds double, queries array<struct<ok boolean>>")
    scored = scoring.score_answers(answers.join(expected, "id"))
    s = scoring.eval_summary(scored).first()
    assert (s["passed"], s["total"], s["de_passed"], s["valid_sql"], s["answerable"], s["median_seconds"]) == (2, 3, 1, 1, 2, 2.0)
    assert [r["id"] for r in scoring.failures(scored).collect()] == ["q2"]


def test_log_summary(spark):
    rows = [("t", "p", "m", s, [(ok,)], "q", "a") for s, ok in ((1.0, True), (2.0, False), (9.0, True))] + [("t", "p", "m", 4.0, [], "q", None)]
    turns = spark.createDataFrame(rows, "ts string, provider string, model string, seconds double, queries array<struct<ok boolean>>, question string, answer string")
    s = logs.log_summary(logs.flatten_turns(turns)).first()
    assert (s["turns"], s["median_seconds"], s["turns_with_failure"]) == (4, 3.0, 1)


# ---------------------------------------------------------------- admission

def _sequential(events, limit, window, cap):
    """The rule, event by event."""
    hits, day, count, out = {}, None, 0, {}
    for key, t, o in sorted(events, key=lambda e: (e[1], e[2])):
        if t // 86_400 != day:
            day, count = t // 86_400, 0
        q = hits.setdefault(key, deque())
        if cap is not None and count >= cap:
            out[o] = "cap"
            continue
        while q and t - q[0] > window:
            q.popleft()
        if len(q) >= limit:
            out[o] = "window"
            continue
        q.append(t)
        count += 1
        out[o] = "admitted"
    return out


@pytest.mark.parametrize("limit, window, cap, chunk", [
    (2, 3600, None, None), (1, 50_000, None, 7200), (3, 100_000, None, 20_000), (2, 3000, 60, 86_400), (1, 30_000, 25, 21_600),
    (1, 7200, None, 7200), (1, 600, None, 3600), (1, 90_000, None, 86_400),
])
def test_admission_equals_the_sequential_rule(spark, limit, window, cap, chunk):
    rng = random.Random(limit)
    events = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(6)}", rng.randrange(0, 4 * 86_400, 60), i) for i in range(700)]
    df = spark.createDataFrame(events, "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = admission.admit(df, "k", "ts", "id", limit, window, cap, chunk)
    assert {r["id"]: r["verdict"] for r in got.collect()} == _sequential(events, limit, window, cap)


def test_a_key_without_a_pause_settles_in_a_number_of_steps(spark, monkeypatch):
    rng = random.Random(3)
    events = [("busy", 9_000 * i + rng.randrange(0, 9_000, 900), i) for i in range(167 * 86_400 // 9_000)]
    events += [("rare", 40 * 86_400 * i, 10_000 + i) for i in range(4)] + [("twice", 500, 20_000), ("twice", 500, 20_001)]
    df = spark.createDataFrame(events, "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    writes, whole = [], admission.materialize
    monkeypatch.setattr(admission, "materialize", lambda d, name: writes.append(name) or whole(d, name))
    got = admission.admit(df, "k", "ts", "id", 1, 36_000, chunk_s=86_400)
    assert {r["id"]: r["verdict"] for r in got.collect()} == _sequential(events, 1, 36_000, None)
    assert len(writes) <= 5 + 2 * 8         # 167 chunks


@pytest.mark.parametrize("seed", range(40))
def test_chains_follow_every_state(seed):
    rng = random.Random(seed)
    window, times = rng.choice([3, 10, 25]), sorted(rng.choices(range(100, 200), k=rng.randrange(0, 40)))
    seeds = sorted({-(2 ** 61), *rng.sample(range(60, 100), 5)})

    def plain(at):
        for t in times:
            at = t if t - at > window else at
        return at

    known, found = admission._Chains(window, 100 + window), admission._Chains(window)
    for a in seeds:
        found.seed(a)
    cut = rng.randrange(0, len(times) + 1)
    for chains in (known, found):
        chains.take(np.array(times[:cut], np.int64))
        chains.take(np.array(times[cut:], np.int64))
    ends = {origin: at for at, origins, _ in found.live for origin in origins}
    assert ends == {a: plain(a) for a in seeds}
    assert {at for at in ends.values() if at >= 100} <= {at for at, *_ in known.live}


def test_window_frees_a_key_only_after_it(spark):
    df = spark.createDataFrame([("a", t, t) for t in (0, 10, 600, 601)], "k string, s bigint, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["verdict"] for r in admission.admit(df, "k", "ts", "id", 1, 600).collect()}
    assert got == {0: "admitted", 10: "window", 600: "window", 601: "admitted"}


def test_bad_parameters(spark):
    df = spark.range(1).selectExpr("id k", "timestamp_seconds(id) ts", "id o")
    with pytest.raises(ValueError):
        admission.admit(df, "k", "ts", "o", 0, 10)
    with pytest.raises(ValueError):
        admission.admit(df, "k", "ts", "o", 1, 10, daily_cap=5, chunk_s=50_000)


def test_geojson_text_is_json(spark):
    assert json.loads(spark.range(1).select(geo.point_geojson(F.lit(1.5), F.lit(2.5)).alias("g")).first()["g"])["coordinates"] == [1.5, 2.5]


def test_counted_pairs_equal_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(proximity, "PART_PLACES", 3)
    rng = random.Random(8)
    near = lambda lon, lat, spread, n: [(lon + rng.uniform(-spread, spread), lat + rng.uniform(-spread, spread)) for _ in range(n)]
    spots = near(8.6, 50.1, 0.05, 700) + [(8.61, 50.11)] * 60 + near(180.0, -16.0, 0.04, 200) + near(20.0, 89.99, 0.009, 60) + near(0.0, 0.0, 0.03, 200)
    spots += [(float("nan"), 50.1), (8.6, float("nan")), (None, 50.1), (8.6, None)]
    places = spark.createDataFrame([(i, x, y, i % 5 > 0) for i, (x, y) in enumerate(spots)], "id long, lon double, lat double, open boolean")
    some = [rng.choice([s for s in spots if None not in s]) for _ in range(60)] + [(179.99, -16.0), (-179.99, -16.01), (0.0, 90.0), (8.6, 50.1), (100.0, 10.0)]
    marks = [(f"m{i}", x, y) for i, (x, y) in enumerate(some) if x == x and y == y] + [("m1", 8.6, 50.1), (None, 8.6, 50.1)]
    landmarks = spark.createDataFrame(marks, "landmark string, to_lon double, to_lat double")
    for radius in (1000, 2500):
        pairs = proximity.distance_join(places, landmarks, radius)
        counted = proximity.distance_join(places, landmarks, radius, count_where=F.col("open"))
        want = proximity.count_near(pairs, F.col("open")).collect()
        assert sorted(map(str, proximity.count_near(counted).collect())) == sorted(map(str, want))
    # No landmark meets all places around it one by one.
    near_by = proximity.distance_join(places, landmarks, 2500).where("open").count()
    assert 3 * counted.count() < near_by
