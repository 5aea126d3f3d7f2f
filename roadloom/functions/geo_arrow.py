"""The three geometry functions Spark has no expression for, as Arrow UDFs.

Each one works on whole Arrow batches; nothing crosses rows, so partitioning is
whatever the scan produced.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.constants import SIMPLIFY_DEG, WGS84_A, WGS84_F
from roadloom.functions.geo import pieces

_B = WGS84_A * (1 - WGS84_F)


# ---------------------------------------------------------------- ellipsoidal length

def _inverse(lon1, lat1, lon2, lat2, rounds: int = 60):
    """Geodesic metres between arrays of points (Vincenty 1975, inverse problem).
    Also returns a mask of the pairs that did not converge."""
    lon1, lat1, lon2, lat2 = (np.radians(np.asarray(v, float)) for v in (lon1, lat1, lon2, lat2))
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    dl = (lon2 - lon1 + np.pi) % (2 * np.pi) - np.pi
    lam = dl.copy()
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_sig = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_sig = s1 * s2 + c1 * c2 * cl
            sig = np.arctan2(sin_sig, cos_sig)
            sin_a = np.where(sin_sig > 0, c1 * c2 * sl / sin_sig, 0.0)
            cos2_a = 1 - sin_a ** 2
            cos_2m = np.where(cos2_a > 0, cos_sig - 2 * s1 * s2 / cos2_a, 0.0)
            k = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            new = dl + (1 - k) * WGS84_F * sin_a * (
                sig + k * sin_sig * (cos_2m + k * cos_sig * (2 * cos_2m ** 2 - 1)))
            step, lam = np.abs(new - lam), new
            if not np.any(step > 1e-12):
                break
        u_sq = cos2_a * (WGS84_A ** 2 - _B ** 2) / _B ** 2
        big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
        big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
        d_sig = big_b * sin_sig * (cos_2m + big_b / 4 * (
            cos_sig * (2 * cos_2m ** 2 - 1)
            - big_b / 6 * cos_2m * (4 * sin_sig ** 2 - 3) * (4 * cos_2m ** 2 - 3)))
        metres = _B * big_a * (sig - d_sig)
    failed = (step > 1e-12) | (np.abs(lam) > np.pi)
    return metres, failed


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(40)


def _astroid(x, y):
    """The positive root k of k^4 + 2 k^3 + (1 - x^2 - y^2) k^2 - 2 y^2 k - y^2, by Newton steps from above."""
    k = np.hypot(x, y) + 1.0
    for _ in range(40):
        value = (((k + 2) * k + 1 - x * x - y * y) * k - 2 * y * y) * k - y * y
        slope = ((4 * k + 6) * k + 2 * (1 - x * x - y * y)) * k - 2 * y * y
        k = np.where(slope > 0, np.maximum(k - value / np.where(slope > 0, slope, 1), 0), k)
    return k


def _way(azimuth, s1, c1, s2, c2):
    """Geodesics that leave reduced latitude 1 at an azimuth, up to reduced latitude 2: difference in longitude, its derivative by
    the azimuth, and metres.  The two integrals along the way are Gauss-Legendre sums."""
    sa, ca = np.sin(azimuth), np.cos(azimuth)
    s0, c0 = sa * c1, np.hypot(ca, sa * s1)
    cos2 = np.sqrt(np.maximum((ca * c1) ** 2 + (c2 - c1) * (c2 + c1), 0)) / c2
    sig1, sig2 = np.arctan2(s1, ca * c1), np.arctan2(s2, cos2 * c2)
    om1, om2 = np.arctan2(s0 * s1, ca * c1), np.arctan2(s0 * s2, cos2 * c2)
    half = (sig2 - sig1) / 2
    sin2 = np.sin((sig1 + sig2)[:, None] / 2 + half[:, None] * _NODES) ** 2
    k2 = (c0 ** 2 * (WGS84_A ** 2 - _B ** 2) / _B ** 2)[:, None]
    root = np.sqrt(1 + k2 * sin2)
    total = lambda values: half * (values @ _WEIGHTS)
    lam = om2 - om1 - WGS84_F * s0 * total((2 - WGS84_F) / (1 + (1 - WGS84_F) * root))
    ends = [np.sqrt(1 + k2[:, 0] * np.sin(sig) ** 2) for sig in (sig1, sig2)]
    reduced = (ends[1] * np.cos(sig1) * np.sin(sig2) - ends[0] * np.sin(sig1) * np.cos(sig2)
               - np.cos(sig1) * np.cos(sig2) * total(k2 * sin2 / root))
    slope = np.where(cos2 > 0, (1 - WGS84_F) * reduced / np.where(cos2 > 0, cos2 * c2, 1), 0)
    return lam, slope, _B * total(root)


def _far_inverse(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Nearly antipodal pairs (Karney 2013): with the first point in the south and farther from the equator, the difference in
    longitude grows with the azimuth at it.  Newton steps from the root of the astroid problem, kept within a bracket, for all
    pairs at once."""
    lam = np.radians(np.abs((lon2 - lon1 + 180) % 360 - 180))
    b1, b2 = (np.arctan((1 - WGS84_F) * np.tan(np.radians(v))) for v in (lat1, lat2))
    first = np.abs(b1) >= np.abs(b2)
    b1, b2 = np.where(first, b1, b2), np.where(first, b2, b1)
    b1, b2 = np.where(b1 > 0, -b1, b1), np.where(b1 > 0, -b2, b2)
    c1, c2 = np.maximum(np.cos(b1), 1e-18), np.maximum(np.cos(b2), 1e-18)
    s1, s2 = np.minimum(np.sin(b1), -1e-18), np.sin(b2)
    x, y = (lam - np.pi) / (WGS84_F * np.pi * c1), (b1 + b2) / (WGS84_F * np.pi * c1 ** 2)
    k = np.maximum(_astroid(x, y), 1e-18)
    azimuth = np.where(y == 0, np.arctan2(-np.maximum(x, -1.0), np.sqrt(np.maximum(1 - x * x, 0))), np.arctan2(-x / (1 + k), y / k))
    low, high = np.zeros(len(lam)), np.full(len(lam), np.pi)
    for _ in range(80):
        found, slope, _metres = _way(azimuth, s1, c1, s2, c2)
        off = found - lam
        low, high = np.where(off < 0, azimuth, low), np.where(off >= 0, azimuth, high)
        step = azimuth - off / np.where(slope > 0, slope, 1)
        inside = (slope > 0) & (step > low) & (step < high)
        new = np.where(inside, step, (low + high) / 2)
        done, azimuth = np.max(np.abs(new - azimuth), initial=0.0) < 1e-15, new
        if done:
            break
    return _way(azimuth, s1, c1, s2, c2)[2]


def geodesic_m(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Ellipsoidal metres for arrays of point pairs."""
    lon1, lat1, lon2, lat2 = (np.asarray(v, float) for v in (lon1, lat1, lon2, lat2))
    metres, failed = _inverse(lon1, lat1, lon2, lat2)
    if failed.any():
        metres[failed] = _far_inverse(lon1[failed], lat1[failed], lon2[failed], lat2[failed])
    return metres


@F.pandas_udf(T.DoubleType())
def _piece_lengths_m(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    counts = x1.map(lambda a: -1 if a is None else len(a)).to_numpy()
    flat = [np.concatenate([np.asarray(a, float) for a in s if a is not None] or [np.empty(0)])
            for s in (x1, y1, x2, y2)]
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts, 0))
    total = np.bincount(owner, weights=geodesic_m(*flat), minlength=len(counts)) if len(owner) else np.zeros(len(counts))
    return pd.Series(np.where(counts < 0, np.nan, total)).astype(object).where(counts >= 0, None)


def spheroid_length_m(parts) -> Column:
    """Length on the WGS84 ellipsoid in metres, summed over all paths."""
    p = pieces(parts)
    return _piece_lengths_m(*[p[k] for k in ("x1", "y1", "x2", "y2")])


# ---------------------------------------------------------------- simplification

def kept_vertices(xy: np.ndarray, ends: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker (1973): which vertices stay, of all paths of a batch at once, level by level.  ``ends`` is where each path
    ends among the vertices; no path is empty."""
    a, b = np.append(0, ends[:-1]).astype(np.int64), np.asarray(ends, np.int64) - 1
    keep = np.zeros(len(xy), bool)
    keep[a] = keep[b] = True
    while True:
        wide = b - a >= 2
        a, b = a[wide], b[wide]
        if not len(a):
            return keep
        n = b - a - 1
        first, owner = np.cumsum(n) - n, np.repeat(np.arange(len(a)), n)
        at = np.arange(len(owner)) - first[owner] + a[owner] + 1
        base = xy[b] - xy[a]
        squared, inner, along_base = (base ** 2).sum(1), xy[at] - xy[a][owner], base[owner]
        share = (inner * along_base).sum(1) / np.where(squared > 0, squared, 1)[owner]
        off = np.hypot(*(inner - np.clip(share, 0, 1)[:, None] * along_base).T)
        top = np.maximum.reduceat(off, first)
        far = np.minimum.reduceat(np.where(off == top[owner], at, len(xy)), first)
        split = top > tolerance
        middle = far[split]
        keep[middle] = True
        a, b = np.concatenate([a[split], middle]), np.concatenate([middle, b[split]])


#: Depth of the paths in the coordinates, and how many vertices a path needs.
_PATHS = {"LineString": (0, 2), "MultiLineString": (1, 2), "Polygon": (1, 4), "MultiPolygon": (2, 4)}


def _each_path(coords, depth: int):
    if depth == 0:
        yield coords
    else:
        for inner in coords:
            yield from _each_path(inner, depth - 1)


def _with_paths(coords, depth: int, paths):
    return next(paths) if depth == 0 else [_with_paths(inner, depth - 1, paths) for inner in coords]


def simplified_many(geometries: list[dict], tolerance: float) -> list[dict]:
    """Geometries with every path thinned; a path that would have too few vertices stays as it is, and so does what has no paths."""
    known = [(g, *_PATHS[g["type"]]) for g in geometries if g.get("type") in _PATHS and g.get("coordinates")]
    paths = [(path, least) for g, depth, least in known for path in _each_path(g["coordinates"], depth)]
    long = [path for path, least in paths if len(path) > least]
    flat = np.array([p[:2] for path in long for p in path], float).reshape(-1, 2)
    ends = np.cumsum([len(path) for path in long], dtype=np.int64)
    keep = kept_vertices(flat, ends, tolerance) if long else np.zeros(0, bool)
    slim, at = [], 0
    for path, least in paths:
        if len(path) > least:
            stay = np.flatnonzero(keep[at:at + len(path)])
            at += len(path)
            path = [path[i] for i in stay] if least <= len(stay) < len(path) else path
        slim.append(path)
    rest = iter(slim)
    return [{**g, "coordinates": _with_paths(g["coordinates"], _PATHS[g["type"]][0], rest)} if g.get("type") in _PATHS and g.get("coordinates") else g
            for g in geometries]


def simplified(geometry: dict, tolerance: float) -> dict:
    return simplified_many([geometry], tolerance)[0]


def simplify(geometry_json, tolerance: float = SIMPLIFY_DEG) -> Column:
    """GeoJSON text with every path thinned to the tolerance (in degrees)."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        there = text.notna()
        slim = simplified_many([json.loads(g) for g in text[there]], tolerance)
        out = pd.Series(None, index=text.index, dtype=object)
        out[there] = [json.dumps(g, separators=(",", ":")) for g in slim]
        return out

    return run(geometry_json)


def thinned_paths(parts: pa.Array, tolerance: float) -> pa.Array:
    """Paths of a batch (lists of lists of x, y) with the vertices that stay, by offsets alone; null rows and paths stay null."""
    parts = parts.cast(_PARTS)
    paths = parts.flatten()
    points = paths.flatten()
    sizes = pc.fill_null(pc.list_value_length(paths), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    xy = np.column_stack([pc.fill_null(points.field(c), np.nan).to_numpy(zero_copy_only=False) for c in "xy"]).reshape(-1, 2)
    keep = kept_vertices(xy, ends[sizes > 0], tolerance) if len(xy) else np.zeros(0, bool)
    left = np.add.reduceat(np.append(keep, False).astype(np.int64), ends - sizes) * (sizes > 0) if len(sizes) else sizes
    slim = _lists(left, points.filter(pa.array(keep)), pa.array(paths.is_null()))
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy().astype(np.int64)
    return _lists(counts, slim, pa.array(parts.is_null()))


def simplify_parts(parts, tolerance: float = SIMPLIFY_DEG) -> Column:
    """``array<array<struct<x, y>>>`` of lines, thinned to the tolerance (in degrees) without a text in between."""

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def run(data: pa.Array) -> pa.Array:
        return thinned_paths(data, tolerance)

    return run(parts)


# ---------------------------------------------------------------- WKB

# fixed values: geometry type numbers of the WKB standard
WKB_TYPES = {
    "Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4,
    "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7,
}
_NAMES = {number: name for name, number in WKB_TYPES.items()}
_MEMBER = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}


def to_wkb(geometry: dict) -> bytes:
    """Little-endian two-dimensional WKB."""
    kind = geometry["type"]
    head = struct.pack("<BI", 1, WKB_TYPES[kind])
    run = lambda path: struct.pack("<I", len(path)) + b"".join(struct.pack("<2d", *p[:2]) for p in path)
    if kind == "GeometryCollection":
        members = geometry["geometries"]
        return head + struct.pack("<I", len(members)) + b"".join(map(to_wkb, members))
    coords = geometry["coordinates"]
    if kind == "Point":
        return head + struct.pack("<2d", *coords[:2])
    if kind == "LineString":
        return head + run(coords)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coords)) + b"".join(map(run, coords))
    return head + struct.pack("<I", len(coords)) + b"".join(
        to_wkb({"type": _MEMBER[kind], "coordinates": c}) for c in coords)


def from_wkb(data: bytes) -> dict:
    """Either byte order; Z and M ordinates (ISO or flag style) are skipped."""
    at = 0

    def read(fmt):
        nonlocal at
        out = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return out

    def geometry():
        order = "<" if read("B")[0] else ">"
        (code,) = read(order + "I")
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        if code & 0x20000000:
            read(order + "I")
        code &= 0x0FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind = _NAMES[code % 1000]
        position = lambda: list(read(f"{order}{2 + extra}d")[:2])
        many = lambda item: [item() for _ in range(read(order + "I")[0])]
        if kind == "Point":
            return {"type": kind, "coordinates": position()}
        if kind == "LineString":
            return {"type": kind, "coordinates": many(position)}
        if kind == "Polygon":
            return {"type": kind, "coordinates": many(lambda: many(position))}
        if kind == "GeometryCollection":
            return {"type": kind, "geometries": many(geometry)}
        return {"type": kind, "coordinates": [m["coordinates"] for m in many(geometry)]}

    return geometry()


def _bytes_of(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array; of each value where it starts, how long it is, whether it is there."""
    data = data.cast(pa.large_binary())
    _, ends, raw = data.buffers()
    ends = np.frombuffer(ends, np.int64)[data.offset:data.offset + len(data) + 1]
    there = np.asarray(data.is_valid())
    return np.frombuffer(raw or b"", np.uint8), ends[:-1], np.where(there, np.diff(ends), 0), there


def _plain(raw, start, size, kind: int, head: int):
    """Which values are little-endian two-dimensional WKB of a kind, and the number that ends their heads."""
    at = np.flatnonzero(size >= head)
    read = raw[start[at][:, None] + np.arange(head)]
    number = lambda a, b: read[:, a:b].copy().view("<u4")[:, 0].astype(np.int64)
    found = (read[:, 0] == 1) & (number(1, 5) == kind)
    plain, last = np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    plain[at], last[at] = found, number(head - 4, head)
    return plain, last


def _lists(sizes: np.ndarray, values: pa.Array, mask=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values, mask=mask)


def lines_of(data: pa.Array, measured: bool) -> pa.Array:
    """Parts and ellipsoidal metres of a batch of WKB lines.  Little-endian two-dimensional LineStrings are taken from
    the buffer together; other lines are read one by one; what is no line is null."""
    if not len(data):
        return pa.array([], LINES)
    raw, start, size, there = _bytes_of(data)
    plain, n = _plain(raw, start, size, 2, 9)
    plain &= size == 9 + 16 * n
    n, paths, is_line = np.where(plain, n, 0), plain.astype(np.int64), plain.copy()
    marks = np.zeros(len(raw) + 1, np.int8)
    marks[start[plain] + 9] += 1
    marks[(start + size)[plain]] -= 1
    xy = raw[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)].view("<f8").reshape(-1, 2)
    vertices, ends = [], np.append(0, np.cumsum(n))
    found, last = [], 0
    for i in np.flatnonzero(there & ~plain):
        geometry = from_wkb(data[int(i)].as_py())
        if geometry["type"] not in ("LineString", "MultiLineString"):
            continue
        lines = geometry["coordinates"] if geometry["type"] == "MultiLineString" else [geometry["coordinates"]]
        lines = [np.asarray(line, float).reshape(-1, 2) for line in lines]
        found += [xy[ends[last]:ends[i]], *lines]
        vertices += [n[last:i][plain[last:i]], np.array([len(line) for line in lines], np.int64)]
        paths[i], is_line[i], last = len(lines), True, i + 1
    xy = np.concatenate([*found, xy[ends[last]:]])
    vertices = np.concatenate([*vertices, n[last:][plain[last:]]])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    parts = _lists(paths, _lists(vertices, points), pa.array(~is_line))
    metres = np.zeros(len(data))
    if measured:
        path = np.repeat(np.arange(len(vertices)), vertices)
        joined = path[1:] == path[:-1]
        a, b, row = xy[:-1][joined], xy[1:][joined], np.repeat(np.arange(len(data)), paths)
        if len(a):
            metres = np.bincount(row[path[1:][joined]], weights=geodesic_m(*a.T, *b.T), minlength=len(data))
    return pa.StructArray.from_arrays([parts, pa.array(metres, mask=~is_line)], ["parts", "metres"]).cast(LINES)


def first_vertices(data: pa.Array) -> pa.Array:
    """The first vertex of each WKB geometry; null without any."""
    if not len(data):
        return pa.array([], VERTEX)
    raw, start, size, there = _bytes_of(data)
    plain, _ = _plain(raw, start, size, 1, 5)
    plain &= size == 21
    xy, known = np.zeros((len(data), 2)), plain.copy()
    xy[plain] = raw[start[plain][:, None] + np.arange(5, 21)].copy().view("<f8")
    for i in np.flatnonzero(there & ~plain):
        spot = [from_wkb(data[int(i)].as_py())]
        while spot and isinstance(spot[0], (dict, list)):
            inner = spot[0]
            spot = (inner.get("coordinates") or inner.get("geometries") or []) if isinstance(inner, dict) else inner
        if spot:
            xy[i], known[i] = spot[:2], True
    return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"], mask=pa.array(~known)).cast(VERTEX)


VERTEX = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.list_(VERTEX))
LINES = pa.struct([("parts", pa.list_(pa.list_(VERTEX))), ("metres", pa.float64())])


def decoded_lines(wkb, measured: bool = True) -> Column:
    """``struct<parts, metres>`` of WKB geometry in one hop; both are null for what is no line.  Without ``measured``, metres are 0."""

    @F.arrow_udf("parts array<array<struct<x:double,y:double>>>, metres double")
    def run(data: pa.Array) -> pa.Array:
        return lines_of(data, measured)

    return run(wkb)


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"]))
def first_vertex(data: pa.Array) -> pa.Array:
    return first_vertices(data)


@F.pandas_udf(T.BinaryType())
def geojson_to_wkb(text: pd.Series) -> pd.Series:
    return text.map(lambda g: None if g is None else to_wkb(json.loads(g)))


@F.pandas_udf(T.StringType())
def wkb_to_geojson(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else json.dumps(from_wkb(bytes(b)), separators=(",", ":")))
