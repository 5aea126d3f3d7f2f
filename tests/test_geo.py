import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.functions import geo, geo_arrow


def _one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("v")).first()["v"]


def _line(*points):
    return json.dumps({"type": "LineString", "coordinates": [list(p) for p in points]})


def test_one_degree_of_latitude(spark):
    assert _one(spark, geo.haversine_km("a", "b", "c", "d"), a=0.0, b=0.0, c=0.0, d=1.0) == pytest.approx(111.195, abs=0.01)


def test_antipodal_points_do_not_overflow(spark):
    half = math.pi * 6371.0088
    assert _one(spark, geo.haversine_km("a", "b", "c", "d"), a=0.0, b=0.0, c=180.0, d=0.0) == pytest.approx(half)


@pytest.mark.parametrize("geometry, km", [
    (_line((0, 0), (0, 1)), 111.195),
    ('{"type":"MultiLineString","coordinates":[[[0,0],[0,1]],[[5,0],[5,1,99],[5]]]}', 222.39),
    ('{"type":"GeometryCollection","geometries":[{"type":"LineString","coordinates":[[0,0],[0,1]]},'
     '{"type":"Point","coordinates":[9,9]}]}', 111.195),
    ('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[9,9]}]}', None),
    ('{"type":"GeometryCollection","geometries":[{"type":"GeometryCollection","geometries":['
     '{"type":"LineString","coordinates":[[0,0],[0,1]]}]}]}', 111.195),
    ('{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]]]}', None),
    ('{"type":"Point","coordinates":[1,2]}', None),
    ('{"type":"LineString","coordinates":[]}', 0.0),
    (None, None),
])
def test_length_by_geometry_type(spark, geometry, km):
    got = _one(spark, geo.geojson_km("g"), g=geometry)
    assert got is None if km is None else got == pytest.approx(km, abs=0.01)


def test_derived_columns(spark):
    rows = [('{"type":"Point","coordinates":[10.0,50.0]}',), (_line((0, 0), (2, 2)),), (None,)]
    df = geo.with_geometry(spark.createDataFrame(rows, "geometry string"))
    out = df.select(*[c.alias(n) for n, c in geo.geometry_columns().items()]).collect()
    assert (out[0]["geom_type"], out[0]["lon"], out[0]["lat"], out[0]["length_km"]) == ("Point", 10.0, 50.0, None)
    assert (out[1]["lon"], out[1]["bbox_min_lon"], out[1]["bbox_max_lat"]) == (1.0, 0.0, 2.0)
    assert all(v is None for v in out[2])


def test_centroid_is_weighted_by_length(spark):
    g = _line((0, 0), (2, 0), (2, 1))
    c = _one(spark, geo.line_centroid(geo.geojson_parts("g")), g=g)
    assert (c["x"], c["y"]) == pytest.approx(((2 * 1 + 1 * 2) / 3, (1 * 0.5) / 3))


def test_centroid_without_length_is_the_first_vertex(spark):
    c = _one(spark, geo.line_centroid(geo.geojson_parts("g")), g=_line((3, 4), (3, 4)))
    assert (c["x"], c["y"]) == (3.0, 4.0)


@pytest.mark.parametrize("x, key", [(8.674999, 867), (8.675, 868), (-0.004, 0), (-0.006, -1)])
def test_cells(spark, x, key):
    assert _one(spark, geo.cell("x"), x=x) == key


HOLED = ('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}')
NOTCHED = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[2,1],[0,4],[0,0]]]}'


@pytest.mark.parametrize("polygon, x, y, inside", [
    (HOLED, 0.5, 1.5, True), (HOLED, 1.5, 1.5, False), (HOLED, 5.0, 1.0, False),
    (NOTCHED, 2.0, 0.5, True), (NOTCHED, 2.0, 3.0, False), (NOTCHED, 0.2, 3.0, True),
    (HOLED, 0.0, 0.5, True), (HOLED, 4.0, 0.5, False),       # left border in, right border out
])
def test_point_in_polygon(spark, polygon, x, y, inside):
    assert _one(spark, geo.within_rings("x", "y", geo.geojson_rings("g")), g=polygon, x=x, y=y) is inside


def test_polygon_area_leaves_holes_out(spark):
    assert _one(spark, geo.polygon_area(geo.geojson_rings("g")), g=HOLED) == pytest.approx(15.0)


@pytest.mark.parametrize("geometry, text", [
    ('{"type":"Point","coordinates":[13.123456789,52.987654321,7]}', [13.12346, 52.98765]),
    ('{"type":"Polygon","coordinates":[[[1.000001,2.000009]]]}', [[[1.0, 2.00001]]]),
    ('{"type":"MultiPolygon","coordinates":[[[[1.000001,2.000009]]]]}', [[[[1.0, 2.00001]]]]),
])
def test_rounded_coordinates(spark, geometry, text):
    assert json.loads(_one(spark, geo.rounded_coordinates_json("g"), g=geometry)) == text


@pytest.mark.parametrize("a, b, metres", [
    # Published pairs: Flinders Peak to Buninyong, and nearly antipodal points.
    ((144.42486788888, -37.95103341666), (143.92649552777, -37.65282113888), 54972.271),
    ((0.0, 0.0), (179.5, 0.5), 19936288.579),
    ((0.0, 0.0), (180.0, 0.0), 20003931.459),
    ((0.0, 30.0), (179.8, -29.9), 19989832.828),
    ((8.0, 50.0), (8.0, 50.0), 0.0),
    ((0.0, 90.0), (0.0, -90.0), 20003931.459),
])
def test_ellipsoidal_distance(a, b, metres):
    got = geo_arrow.geodesic_m(*[np.array([v]) for v in (*a, *b)])
    assert got[0] == pytest.approx(metres, abs=0.001)


def test_both_solvers_agree_where_both_hold():
    rng = np.random.default_rng(5)
    near = [rng.uniform(-180, 180, 4000), rng.uniform(-90, 90, 4000)]
    for far in ([rng.uniform(-180, 180, 4000), rng.uniform(-90, 90, 4000)],
                [near[0] + 180 + rng.uniform(-2, 2, 4000), np.clip(-near[1] + rng.uniform(-2, 2, 4000), -90, 90)]):
        metres, failed = geo_arrow._inverse(*near, *far)
        assert np.abs(geo_arrow._far_inverse(*near, *far) - metres)[~failed].max() < 1e-3
        assert np.isfinite(geo_arrow.geodesic_m(*near, *far)).all()


def test_nearly_antipodal_way_is_the_shortest_over_any_point():
    lon, lat = np.array([0.0, 10.0]), np.array([0.3, -41.0])
    end = np.array([179.7, -169.6]), np.array([-0.2, 41.1])
    found = geo_arrow.geodesic_m(lon, lat, *end)
    for i in range(2):      # a circle of points a quarter of the way round: all ways over them are as long or longer, one is as short
        azimuth, phi = np.linspace(-np.pi, np.pi, 200_001), np.radians(lat[i])
        over_lat = np.arcsin(np.clip(np.cos(phi) * np.cos(azimuth), -1, 1))
        over_lon = np.degrees(np.radians(lon[i]) + np.arctan2(np.sin(azimuth) * np.cos(phi), -np.sin(phi) * np.sin(over_lat)))
        over_lat, n = np.degrees(over_lat), len(azimuth)
        total = (geo_arrow._inverse(np.full(n, lon[i]), np.full(n, lat[i]), over_lon, over_lat)[0]
                 + geo_arrow._inverse(over_lon, over_lat, np.full(n, end[0][i]), np.full(n, end[1][i]))[0])
        assert abs(np.nanmin(total) - found[i]) < 1e-3


def test_ellipsoidal_length_column(spark):
    rows = [(_line((8, 50), (8, 51)),), ('{"type":"Point","coordinates":[1,2]}',), (_line((8, 50)),)]
    df = spark.createDataFrame(rows, "g string").select(geo_arrow.spheroid_length_m(geo.geojson_parts("g")).alias("m"))
    got = [r["m"] for r in df.collect()]
    assert got[0] == pytest.approx(111238.7, abs=1) and got[1] is None and got[2] == 0.0


def _thinned(path, tolerance):
    """The rule for one path, by recursion."""
    if len(path) < 3:
        return path
    (x0, y0), (x1, y1) = path[0], path[-1]
    squared = (x1 - x0) ** 2 + (y1 - y0) ** 2

    def off(p):
        share = min(max(((p[0] - x0) * (x1 - x0) + (p[1] - y0) * (y1 - y0)) / squared, 0), 1) if squared else 0
        return math.hypot(p[0] - x0 - share * (x1 - x0), p[1] - y0 - share * (y1 - y0))

    far = max(range(1, len(path) - 1), key=lambda i: (off(path[i]), -i))
    if off(path[far]) <= tolerance:
        return [path[0], path[-1]]
    return _thinned(path[:far + 1], tolerance) + _thinned(path[far:], tolerance)[1:]


def test_simplify_of_a_batch_equals_each_path_alone():
    rng = np.random.default_rng(8)
    lines = [np.round(np.cumsum(rng.normal(0, 1, (n, 2)), 0), 6).tolist() for n in (1, 2, 3, 40, 0, 5, 300, 17, 2)]
    ring = [[math.cos(t / 30) * 5, math.sin(t / 30) * 5] for t in range(188)] + [[5.0, 0.0]]
    tiny = [[0, 0], [0.01, 0], [0.01, 0.01], [0, 0.01], [0, 0]]
    given = [{"type": "LineString", "coordinates": p} for p in lines] + [
        {"type": "MultiLineString", "coordinates": lines, "more": 1}, {"type": "Point", "coordinates": [1, 2]}, {"type": "MultiPolygon", "coordinates": [[ring, tiny], [tiny]]},
        {"type": "Polygon", "coordinates": [ring]}, {"type": "GeometryCollection", "geometries": []}, {"type": "LineString", "coordinates": [[0, 0]] * 9}]
    got = geo_arrow.simplified_many(given, 0.7)
    assert [g["coordinates"] for g in got[:9]] == [_thinned(p, 0.7) for p in lines]
    assert got[9] == {"type": "MultiLineString", "coordinates": [_thinned(p, 0.7) for p in lines], "more": 1}
    assert got[10] == given[10] and got[13] == given[13] and got[14]["coordinates"] == [[0, 0], [0, 0]]
    assert got[11]["coordinates"] == [[_thinned(ring, 0.7), tiny], [tiny]] and got[12]["coordinates"] == [_thinned(ring, 0.7)]
    assert geo_arrow.simplified_many([], 0.7) == []


def test_simplify_by_offsets_equals_the_text_form():
    rng = np.random.default_rng(4)
    rows = [None if i % 11 == 5 else [np.round(np.cumsum(rng.normal(0, 1, (int(n), 2)), 0), 6).tolist() for n in rng.integers(0, 30, int(rng.integers(0, 5)))] for i in range(60)]
    rows += [[], [[]], [[], [[1.0, 2.0]], []]]
    data = pa.array([r and [[{"x": x, "y": y} for x, y in path] for path in r] for r in rows], geo_arrow._PARTS)
    want = [r and geo_arrow.simplified({"type": "MultiLineString", "coordinates": r}, 0.8)["coordinates"] for r in rows]
    for lo, hi in ((0, len(rows)), (7, 40), (0, 0), (60, 63)):
        got = geo_arrow.thinned_paths(data[lo:hi], 0.8).to_pylist()
        assert [r and [[[v["x"], v["y"]] for v in path] for path in r] for r in got] == want[lo:hi]
    assert geo_arrow.thinned_paths(pa.array([[None, [{"x": 1.0, "y": 1.0}]]], geo_arrow._PARTS), 1.0).to_pylist() == [[None, [{"x": 1.0, "y": 1.0}]]]


def test_simplify_keeps_ends_and_far_vertices():
    slim = geo_arrow.simplified({"type": "LineString", "coordinates": [[0, 0], [1, 0.0001], [2, 0], [2, 2]]}, 0.0005)
    assert slim["coordinates"] == [[0, 0], [2, 0], [2, 2]]
    ring = {"type": "Polygon", "coordinates": [[[0, 0], [0.0001, 0], [0.0001, 0.0001], [0, 0]]]}
    assert geo_arrow.simplified(ring, 0.0005) == ring


@pytest.mark.parametrize("geometry", [
    {"type": "Point", "coordinates": [1.5, -2.5]},
    {"type": "LineString", "coordinates": [[0.0, 0.0], [1.0, 2.0]]},
    {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]},
    {"type": "MultiPoint", "coordinates": [[0.0, 0.0], [1.0, 2.0]]},
    {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [1.0, 2.0]]]},
    {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}]},
])
def test_wkb_roundtrip(geometry):
    assert geo_arrow.from_wkb(geo_arrow.to_wkb(geometry)) == geometry


def test_wkb_reads_big_endian_and_skips_z():
    import struct
    iso = struct.pack(">BI3d", 0, 1001, 1.0, 2.0, 3.0)
    flagged = struct.pack("<BII3d", 1, 1 | 0x80000000 | 0x20000000, 4326, 1.0, 2.0, 3.0)
    for data in (iso, flagged):
        assert geo_arrow.from_wkb(data) == {"type": "Point", "coordinates": [1.0, 2.0]}


def test_wkb_columns(spark):
    df = spark.createDataFrame([(_line((0, 0), (1, 2)),), (None,)], "g string")
    got = [r["v"] for r in df.select(geo_arrow.wkb_to_geojson(geo_arrow.geojson_to_wkb("g")).alias("v")).collect()]
    assert json.loads(got[0])["coordinates"] == [[0, 0], [1, 2]] and got[1] is None


def test_simplify_column(spark):
    df = spark.createDataFrame([(_line((0, 0), (1, 0.0001), (2, 0)),)], "g string")
    assert json.loads(df.select(geo_arrow.simplify("g").alias("v")).first()["v"])["coordinates"] == [[0, 0], [2, 0]]


def test_path_rows_of_columns(spark):
    parts = geo.parts_of([(F.lit(0), F.lit(0)), (F.lit(0), F.lit(1))], [(F.lit(1), F.lit(1)), (F.lit(1), F.lit(2))])
    df = spark.range(1).select(parts.alias("parts"))
    assert df.select(geo.parts_km("parts").alias("v")).first()["v"] == pytest.approx(222.39, abs=0.01)
    assert json.loads(df.select(geo.parts_geojson("parts").alias("v")).first()["v"])["type"] == "MultiLineString"


def test_lines_decoded_together_equal_lines_decoded_alone():
    import struct

    import pyarrow as pa

    line, lines, spot = ({"type": "LineString", "coordinates": [[8, 50], [8.5, 50.5], [9, 50]]},
                         {"type": "MultiLineString", "coordinates": [[[7, 48], [7.5, 48]], [[1, 2], [3, 4], [5, 6]]]},
                         {"type": "Point", "coordinates": [4, 5]})
    big = struct.pack(">BII4d", 0, 2, 2, 10, 51, 11, 52)
    empty = geo_arrow.to_wkb({"type": "LineString", "coordinates": []})
    data = pa.array([geo_arrow.to_wkb(line), None, geo_arrow.to_wkb(lines), empty, geo_arrow.to_wkb(spot), big, geo_arrow.to_wkb(line)], pa.binary())
    for cut in (data, data[2:], data[:0], data[1:2]):
        got = geo_arrow.lines_of(cut, True).to_pylist()
        for value, found in zip(cut.to_pylist(), got, strict=True):
            g = value and geo_arrow.from_wkb(value)
            if not g or g["type"] == "Point":
                assert found["parts"] is None and found["metres"] is None
                continue
            paths = g["coordinates"] if g["type"] == "MultiLineString" else [g["coordinates"]]
            assert [[[v["x"], v["y"]] for v in path] for path in found["parts"]] == paths
            want = sum(float(geo_arrow.geodesic_m(*([v] for v in (*a, *b)))[0]) for p in paths for a, b in zip(p, p[1:]))
            assert abs(found["metres"] - want) < 1e-6
    firsts = geo_arrow.first_vertices(data).to_pylist()
    assert [v and (v["x"], v["y"]) for v in firsts] == [(8, 50), None, (7, 48), None, (4, 5), (10, 51), (8, 50)]
