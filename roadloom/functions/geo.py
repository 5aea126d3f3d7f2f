"""Geometry as Spark columns.

Lines travel as ``parts``: ``array<array<struct<x:double,y:double>>>``, one inner
array per path.  Everything here is a built-in expression, so it stays on the JVM
and runs where the scan runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadloom.constants import CELLS_PER_DEGREE, COORD_DECIMALS, EARTH_RADIUS_KM

_NUMBER = r"(-?\d[\d.]*(?:[eE][+-]?\d+)?)"
_VERTEX = r"\[\s*" + _NUMBER + r"\s*,\s*" + _NUMBER
_GEOMETRY = "type string, coordinates string, geometries array<string>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- points

def point(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def haversine_km(x1, y1, x2, y2) -> Column:
    """Great-circle distance of two lon/lat points in kilometres."""
    x1, y1, x2, y2 = (F.radians(_col(c)) for c in (x1, y1, x2, y2))
    a = F.pow(F.sin((y2 - y1) / 2), 2) + F.cos(y1) * F.cos(y2) * F.pow(F.sin((x2 - x1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def distance_m(x, y, to_x, to_y) -> Column:
    """Metres from (x, y) to another point; longitude first on both sides."""
    as_col = lambda c: F.lit(float(c)) if isinstance(c, (int, float)) else _col(c)
    return haversine_km(as_col(x), as_col(y), as_col(to_x), as_col(to_y)) * 1000


def cell(coordinate) -> Column:
    """Index of the nearest 0.01 degree grid line, as an integer key."""
    return F.floor(_col(coordinate) * CELLS_PER_DEGREE + 0.5).cast("bigint")


# ---------------------------------------------------------------- lines

def parts_of(*paths) -> Column:
    """``parts`` from fixed lists of (x, y) columns."""
    return F.array(*[F.array(*[point(x, y) for x, y in path]) for path in paths])


def path_pieces(path) -> Column:
    """Consecutive vertex pairs of one path."""
    path = _col(path)
    n = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(
        F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def pieces(parts) -> Column:
    return F.flatten(F.transform(_col(parts), path_pieces))


def path_km(path) -> Column:
    return F.aggregate(path_pieces(path), F.lit(0.0),
                       lambda t, p: t + haversine_km(p["x1"], p["y1"], p["x2"], p["y2"]))


def parts_km(parts) -> Column:
    """Summed length of all paths in kilometres."""
    return F.aggregate(pieces(parts), F.lit(0.0),
                       lambda t, p: t + haversine_km(p["x1"], p["y1"], p["x2"], p["y2"]))


def line_centroid(parts) -> Column:
    """Centroid in degrees: piece midpoints weighted by piece length.  A line
    without any length is represented by its first vertex."""
    zero = F.struct(F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.lit(0.0).alias("w"))

    def add(t, p):
        w = F.sqrt((p["x2"] - p["x1"]) * (p["x2"] - p["x1"]) + (p["y2"] - p["y1"]) * (p["y2"] - p["y1"]))
        return F.struct((t["sx"] + w * (p["x1"] + p["x2"]) / 2).alias("sx"),
                        (t["sy"] + w * (p["y1"] + p["y2"]) / 2).alias("sy"),
                        (t["w"] + w).alias("w"))

    first = F.try_element_at(F.flatten(_col(parts)), F.lit(1))
    return F.aggregate(
        pieces(parts), zero, add,
        lambda t: F.when(t["w"] > 0, point(t["sx"] / t["w"], t["sy"] / t["w"])).otherwise(first))


def line_centroid_xy(parts) -> tuple[Column, Column]:
    c = line_centroid(parts)
    return c["x"], c["y"]


# ---------------------------------------------------------------- vertices

def envelope(vertices) -> dict[str, Column]:
    """Smallest and largest coordinate over all vertices."""
    xs = F.transform(_col(vertices), lambda v: v["x"])
    ys = F.transform(_col(vertices), lambda v: v["y"])
    return {"bbox_min_lon": F.array_min(xs), "bbox_min_lat": F.array_min(ys),
            "bbox_max_lon": F.array_max(xs), "bbox_max_lat": F.array_max(ys)}


def mean_vertex(vertices) -> Column:
    """Plain mean of all vertices; null without vertices."""
    vertices = _col(vertices)
    n = F.size(vertices)
    total = lambda k: F.aggregate(vertices, F.lit(0.0), lambda t, v: t + v[k])
    return F.when(n > 0, point(total("x") / n, total("y") / n))


def ring_area(ring) -> Column:
    """Planar (shoelace) area of one ring in square degrees."""
    return F.abs(F.aggregate(path_pieces(ring), F.lit(0.0),
                             lambda t, p: t + p["x1"] * p["y2"] - p["x2"] * p["y1"])) / 2


def polygon_area(rings) -> Column:
    """Outer ring minus holes."""
    rings = _col(rings)
    outer = ring_area(F.try_element_at(rings, F.lit(1)))
    holes = F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    return outer - F.aggregate(F.transform(holes, ring_area), F.lit(0.0), lambda t, a: t + a)


def within_rings(x, y, rings) -> Column:
    """Point in polygon by edge parity, for a polygon that is already on the row.

    Left and bottom borders count as inside, right and top borders as outside,
    so a point on a shared border belongs to exactly one of two neighbours.
    """
    x, y = _col(x), _col(y)

    def crosses(p):
        at = p["x1"] + (y - p["y1"]) * (p["x2"] - p["x1"]) / F.nullif(p["y2"] - p["y1"], F.lit(0.0))
        return ((p["y1"] > y) != (p["y2"] > y)) & (x < at)

    return F.size(F.filter(pieces(rings), crosses)) % 2 == 1


def ring_edges(df, rings, keep: list[str]):
    """One row per polygon edge: ``keep`` columns plus x1, y1, x2, y2."""
    return (df.select(*keep, F.explode(pieces(rings)).alias("e"))
            .select(*keep, "e.x1", "e.y1", "e.x2", "e.y2"))


# ---------------------------------------------------------------- GeoJSON

def computed(df, **columns: Column):
    """``df`` with further columns, each worked out once per row.  They come out of a generator of one row, into which
    Spark does not copy their text for every later use, as it does with a plain projection."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _vertices_in(text: Column) -> Column:
    """All (x, y) pairs of a coordinate text, at any nesting depth; further
    ordinates are ignored."""
    return F.zip_with(
        F.regexp_extract_all(text, F.lit(_VERTEX), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_VERTEX), F.lit(2)),
        lambda a, b: point(a, b))


def _line_parts(g: Column, vertices: Column | None = None) -> Column:
    """``parts`` of a parsed LineString or MultiLineString, else null."""
    coords = F.coalesce(g["coordinates"], F.lit("[]"))
    single = _vertices_in(coords) if vertices is None else vertices
    return (F.when(g["type"] == "LineString", F.array(single))
            .when(g["type"] == "MultiLineString", F.transform(F.from_json(coords, "array<string>"), _vertices_in)))


def parse_geometry(geometry_json) -> Column:
    return F.from_json(_col(geometry_json), _GEOMETRY)


def _members(g: Column) -> Column:
    """The plain geometries in a parsed collection as texts, at any depth.  A step opens the collections of one depth, and
    there are not more depths than texts that name members."""
    deep = F.size(F.split(F.array_join(g["geometries"], ","), '"geometries"'))
    inner = lambda m: F.coalesce(parse_geometry(m)["geometries"], F.array().cast("array<string>"))
    is_open = lambda m: F.coalesce(parse_geometry(m)["type"] == "GeometryCollection", F.lit(False))

    def step(state, _):
        found = F.flatten(F.transform(state["open"], inner))
        return F.struct(F.concat(state["done"], F.filter(found, lambda m: ~is_open(m))).alias("done"), F.filter(found, is_open).alias("open"))

    own = F.coalesce(g["geometries"], F.array().cast("array<string>"))
    first = F.struct(F.filter(own, lambda m: ~is_open(m)).alias("done"), F.filter(own, is_open).alias("open"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), first, step, lambda state: state["done"])


def _parsed_members(g: Column) -> Column:
    """The plain geometries in a parsed collection, parsed; null for other types."""
    return F.when(g["type"] == "GeometryCollection", F.transform(_members(g), lambda m: parse_geometry(m)))


def _all_vertices(g: Column, inner: Column | None = None) -> Column:
    inner = _parsed_members(g) if inner is None else inner
    members = F.flatten(F.transform(inner, lambda m: _vertices_in(F.coalesce(m["coordinates"], F.lit("")))))
    return F.when(g["type"] == "GeometryCollection", members).otherwise(
        _vertices_in(F.coalesce(g["coordinates"], F.lit(""))))


def _line_km(g: Column, vertices: Column | None = None, inner: Column | None = None) -> Column:
    inner = _parsed_members(g) if inner is None else inner
    lengths = F.filter(F.transform(inner, lambda m: parts_km(_line_parts(m))), lambda km: km.isNotNull())
    total = F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0.0), lambda t, km: t + km))
    return F.when(g["type"] == "GeometryCollection", total).otherwise(parts_km(_line_parts(g, vertices)))


def geojson_vertices(geometry_json) -> Column:
    """Every vertex of a geometry; a collection contributes its members' vertices."""
    return _all_vertices(parse_geometry(geometry_json))


def geojson_parts(geometry_json) -> Column:
    """``parts`` of line geometries; null for every other type."""
    return _line_parts(parse_geometry(geometry_json))


def geojson_rings(geometry_json) -> Column:
    """Rings of a Polygon, or of all members of a MultiPolygon, in the shape of ``parts``."""
    g = parse_geometry(geometry_json)
    return (
        F.when(g["type"] == "Polygon", F.transform(F.from_json(g["coordinates"], "array<string>"), _vertices_in))
        .when(g["type"] == "MultiPolygon",
              F.transform(F.flatten(F.from_json(g["coordinates"], "array<array<string>>")), _vertices_in)))


def geojson_km(geometry_json) -> Column:
    """Length of line geometries in kilometres.

    A collection adds up its line members and is null when it has none; points
    and polygons are null, because a perimeter is not a road length.
    """
    return _line_km(parse_geometry(geometry_json))


def with_geometry(df, geometry: str = "geometry"):
    """Parse the geometry text once per row: adds ``_g``, ``_vertices``, ``_spot`` and ``_km`` for ``geometry_columns``."""
    g, vertices, inner = F.col("_g"), F.col("_vertices"), F.col("_inner")
    first = F.try_element_at("_vertices", F.lit(1))
    parsed = computed(computed(df, _g=parse_geometry(geometry)), _inner=_parsed_members(g))
    parsed = computed(parsed, _vertices=_all_vertices(g, inner))
    return computed(parsed, _spot=F.when(g["type"] == "Point", first).otherwise(mean_vertex("_vertices")), _km=_line_km(g, vertices, inner))


def geometry_columns(geometry: str = "geometry") -> dict[str, Column]:
    """The derived columns every feature gets, for the output of ``with_geometry``."""
    g = F.col("_g")
    return {
        "geom_type": g["type"],
        "lon": F.col("_spot.x"),
        "lat": F.col("_spot.y"),
        "length_km": F.col("_km"),
        **envelope("_vertices"),
        "geometry_geojson": F.when(g["type"].isNotNull(), F.col(geometry)),
    }


def round_coordinates(coordinates, depth: int, decimals: int = COORD_DECIMALS) -> Column:
    """Round a typed coordinate array; ``depth`` 1 is a single position."""
    c = _col(coordinates)
    if depth == 1:
        return F.transform(F.slice(c, 1, 2), lambda v: F.round(v, decimals))
    return F.transform(c, lambda inner: round_coordinates(inner, depth - 1, decimals))


def rounded_coordinates_json(geometry_json, decimals: int = COORD_DECIMALS, parsed: Column | None = None) -> Column:
    """Coordinate text with rounded numbers, for the six plain geometry types."""
    g = parse_geometry(geometry_json) if parsed is None else parsed

    def as_text(depth):
        ddl = "array<" * depth + "double" + ">" * depth
        return F.to_json(round_coordinates(F.from_json(g["coordinates"], ddl), depth, decimals))

    return (F.when(g["type"] == "Point", as_text(1))
            .when(g["type"].isin("LineString", "MultiPoint"), as_text(2))
            .when(g["type"].isin("MultiLineString", "Polygon"), as_text(3))
            .when(g["type"] == "MultiPolygon", as_text(4)))


def rounded_geometry_json(geometry_json, decimals: int = COORD_DECIMALS, parsed: Column | None = None) -> Column:
    """Geometry text with rounded numbers; nested collections become one, no geometry is ``null``, any other text an error.
    ``parsed`` is a column that holds the result of ``parse_geometry``, where there is one."""
    def plain(text, own=None):
        own = parse_geometry(text) if own is None else own
        made = F.concat(F.lit('{"type":"'), own["type"], F.lit('","coordinates":'), rounded_coordinates_json(text, decimals, own), F.lit("}"))
        return F.coalesce(made, F.raise_error(F.concat(F.lit("no geometry: "), F.substring(F.coalesce(text, F.lit("null")), 1, 200))).cast("string"))

    text, g = _col(geometry_json), parse_geometry(geometry_json) if parsed is None else parsed
    members = F.array_join(F.transform(_members(g), lambda m: plain(m)), ",")
    return (F.when(text.isNull() | (text == "null"), F.lit("null"))
            .when(g["type"] == "GeometryCollection", F.concat(F.lit('{"type":"GeometryCollection","geometries":['), members, F.lit("]}")))
            .otherwise(plain(text, parsed)))


def parts_geojson(parts) -> Column:
    """GeoJSON text of ``parts``: a LineString for one path, else a MultiLineString."""
    nested = F.transform(_col(parts), lambda p: F.transform(p, lambda v: F.array(v["x"], v["y"])))
    return F.when(
        F.size(nested) == 1,
        F.to_json(F.struct(F.lit("LineString").alias("type"), F.try_element_at(nested, F.lit(1)).alias("coordinates")))
    ).otherwise(F.to_json(F.struct(F.lit("MultiLineString").alias("type"), nested.alias("coordinates"))))


def point_geojson(x, y) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(_col(x), _col(y)).alias("coordinates")))
