"""The same results in plain SQL, for DuckDB over the same tables.

Written independently of the operators: nested-loop polygon tests, plain joins,
window functions and recursion instead of the distributed forms.
"""

from __future__ import annotations

from roadloom.constants import (
    CLASS_ORDER, FILE_READERS, INCIDENT_CLASSES, INCIDENT_NAME, INCIDENT_WEEKS, PLACE_LEAVES, REFUSAL_MARKERS,
    SEGMENT_LEAVES, STATEMENT_STARTS, WGS84_A, WGS84_F, WRITE_KEYWORDS,
)
from roadloom.plans import derived as d

RADIUS = "12742.0176"


def hav(x1, y1, x2, y2) -> str:
    return (f"({RADIUS} * asin(sqrt(least(1e0, pow(sin((radians({y2}) - radians({y1})) / 2), 2) + "
            f"cos(radians({y1})) * cos(radians({y2})) * pow(sin((radians({x2}) - radians({x1})) / 2), 2)))))")


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.PRIORITY_CLASS.items()) + " END"

# ---------------------------------------------------------------- derived tables

CTE = {}
CTE["roads0"] = f"""SELECT o_orderkey AS id, {_CASE} AS class,
  CASE WHEN o_orderkey % 3 <> 0 THEN concat('R', CAST(o_orderkey % 200 AS VARCHAR)) END AS name,
  o_orderstatus AS status, o_orderdate AS opened,
  6e0 + (o_orderkey * 73 % 9000) / 1e3 AS x0, 47.5e0 + (o_orderkey * 151 % 7000) / 1e3 AS y0, 1 + o_orderkey % 5 AS s,
  o_orderstatus = 'P' AS two FROM orders"""
CTE["roads1"] = """SELECT *, x0 AS x1, y0 AS y1, x0 + 0.01e0 * s AS x2, y0 + 0.004e0 * s AS y2,
  x0 + 0.015e0 * s AS x3, y0 + 0.012e0 * s AS y3, x0 + 0.02e0 * s AS x4, y0 + 0.012e0 * s AS y4,
  x0 + 0.03e0 * s AS x5, y0 + 0.02e0 * s AS y5 FROM roads0"""


def _w(a, b):
    return f"sqrt((x{b} - x{a}) * (x{b} - x{a}) + (y{b} - y{a}) * (y{b} - y{a}))"


CTE["roads2"] = f"""SELECT *, {hav('x1', 'y1', 'x2', 'y2')} + {hav('x2', 'y2', 'x3', 'y3')} AS km1,
  CASE WHEN two THEN {hav('x4', 'y4', 'x5', 'y5')} END AS km2,
  {_w(1, 2)} AS w1, {_w(2, 3)} AS w2, CASE WHEN two THEN {_w(4, 5)} ELSE 0e0 END AS w3 FROM roads1"""
CTE["roads"] = """SELECT *, km1 + coalesce(km2, 0e0) AS length_km,
  (w1 * (x1 + x2) / 2 + w2 * (x2 + x3) / 2 + w3 * (x4 + x5) / 2) / (w1 + w2 + w3) AS gx,
  (w1 * (y1 + y2) / 2 + w2 * (y2 + y3) / 2 + w3 * (y4 + y5) / 2) / (w1 + w2 + w3) AS gy FROM roads2"""
CTE["cells0"] = """SELECT *, CAST(floor(gx * 100 + 0.5) AS BIGINT) AS cx, CAST(floor(gy * 100 + 0.5) AS BIGINT) AS cy
  FROM roads"""
CTE["versions"] = f"""SELECT '{d.RELEASE_A}' AS release, id, class, name, length_km, cx, cy FROM cells0
  WHERE opened < DATE '{d.OPENED_AFTER_A}' UNION ALL
  SELECT '{d.RELEASE_B}', id, class, name, length_km * CASE WHEN status = 'F' THEN 1.02e0 ELSE 1e0 END, cx, cy
  FROM cells0 WHERE opened >= DATE '{d.WITHDRAWN_BEFORE_B}'"""


def _ellipsoidal(rounds: int = 8) -> str:
    """Metres of each road on the ellipsoid: the inverse problem after Vincenty, its rounds written out one in another."""
    pieces = " UNION ALL ".join(f"SELECT id, x{a} AS xa, y{a} AS ya, x{b} AS xb, y{b} AS yb FROM roads" + (" WHERE two" if a == 4 else "")
                                for a, b in ((1, 2), (2, 3), (4, 5)))
    f, axis = f"CAST({WGS84_F!r} AS DOUBLE)", f"CAST({WGS84_A!r} AS DOUBLE)"
    low = f"({axis} * (1 - {f}))"
    at = f"""SELECT id, radians(xb - xa) AS dl, radians(xb - xa) AS lam, atan((1 - {f}) * tan(radians(ya))) AS u1,
        atan((1 - {f}) * tan(radians(yb))) AS u2 FROM ({pieces})"""
    for _ in range(rounds):
        angles = f"""SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
            sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM ({at})"""
        bend = f"SELECT *, atan2(ss, cs) AS sig, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0e0 END AS sa FROM ({angles})"
        mid = f"SELECT *, 1 - sa * sa AS ca2, CASE WHEN sa * sa < 1 THEN cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) ELSE 0e0 END AS cm FROM ({bend})"
        last = f"SELECT *, {f} / 16 * ca2 * (4 + {f} * (4 - 3 * ca2)) AS c FROM ({mid})"
        at = f"SELECT id, dl, u1, u2, dl + (1 - c) * {f} * sa * (sig + c * ss * (cm + c * cs * (2 * cm * cm - 1))) AS lam FROM ({last})"
    series = f"SELECT *, ca2 * ({axis} * {axis} - {low} * {low}) / ({low} * {low}) AS w FROM ({last})"
    ab = f"""SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS a, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS b FROM ({series})"""
    return f"""SELECT id, sum({low} * a * (sig - b * ss * (cm + b / 4 * (cs * (2 * cm * cm - 1)
        - b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))))) AS metres FROM ({ab}) GROUP BY id"""


CTE["ellipsoidal"] = _ellipsoidal()
CTE["grid"] = """SELECT n_name AS state, n_nationkey % 5 AS i, CAST(floor(n_nationkey / 5e0) AS BIGINT) AS j FROM nation"""
CTE["corner"] = """SELECT state, k, 6.0037e0 + 1.7e0 * (i + di) + 0.031e0 * (j + dj) AS x,
  47.5041e0 + 1.3e0 * (j + dj) + 0.023e0 * (i + di) AS y
  FROM grid, (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) AS c(k, di, dj)"""
CTE["edges"] = """SELECT a.state, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM corner a JOIN corner b ON a.state = b.state AND b.k = a.k + 1"""
CTE["lookup"] = """SELECT cx, cy, min(state) AS state FROM (
  SELECT c.cx, c.cy, e.state FROM (SELECT DISTINCT cx, cy FROM versions) c JOIN edges e
  ON (e.y1 > c.cy / 100e0) <> (e.y2 > c.cy / 100e0)
  AND c.cx / 100e0 < e.x1 + (c.cy / 100e0 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY c.cx, c.cy, e.state HAVING count(*) % 2 = 1) GROUP BY cx, cy"""
CTE["stats"] = """SELECT release, coalesce(l.state, 'outside DE') AS state, class, count(*) AS segments,
  round(sum(length_km), 2) AS length_km, round(avg(length_km) * 1000, 1) AS mean_segment_m,
  CAST(round(CAST(100e0 * count(name) / count(*) AS DECIMAL(28, 10)), 1) AS DOUBLE) AS pct_named
  FROM versions LEFT JOIN lookup l USING (cx, cy) GROUP BY ALL"""
CTE["inside"] = "SELECT * FROM stats WHERE state <> 'outside DE'"

STATS = ["roads0", "roads1", "roads2", "roads", "cells0", "versions", "grid", "corner", "edges", "lookup", "stats"]
INSIDE = STATS + ["inside"]
ROADS = ["roads0", "roads1", "roads2", "roads"]
PAIR = ROADS + ["cells0", "versions"]


def _series(before, after, with_rules):
    weeks = quoted(INCIDENT_WEEKS) if with_rules else "''"
    return {
        "ends": """SELECT min(release) AS r0, max(release) AS r1, CAST(min(release)[:10] AS DATE) AS d0,
  CAST(max(release)[:10] AS DATE) AS d1 FROM inside""",
        "keys": """SELECT state, class,
  max(length_km) FILTER (release = r0) AS ka, max(length_km) FILTER (release = r1) AS kb,
  CAST(max(segments) FILTER (release = r0) AS DOUBLE) AS sa, CAST(max(segments) FILTER (release = r1) AS DOUBLE) AS sb,
  max(pct_named) FILTER (release = r0) AS pa, max(pct_named) FILTER (release = r1) AS pb,
  any_value(d0) AS d0, any_value(d1) AS d1 FROM inside, ends GROUP BY state, class""",
        "model": """SELECT state, class, d0, d1, coalesce(ka, kb) AS k0, coalesce(kb, ka) AS k1,
  coalesce(nullif(sa, 0), nullif(sb, 0), 0e0) AS s0, coalesce(nullif(sb, 0), nullif(sa, 0), 0e0) AS s1,
  coalesce(pa, pb, 0e0) AS p0, coalesce(pb, pa, 0e0) AS p1,
  CAST(greatest(1, (d1 - d0) // 7) AS DOUBLE) AS span FROM keys WHERE ka IS NOT NULL OR kb IS NOT NULL""",
        "weeks": f"""SELECT CAST(w AS DATE) AS week FROM (SELECT unnest(generate_series(
  CAST(d0 - {7 * before} AS TIMESTAMP), CAST(d1 + {7 * after} AS TIMESTAMP), INTERVAL 7 DAY)) AS w FROM ends)""",
        "anchors": "SELECT DISTINCT release, CAST(release[:10] AS DATE) AS week FROM inside",
        "joined": f"""SELECT w.week, m.*, a.release IS NOT NULL AS anchor, i.length_km AS rk, i.segments AS rs,
  i.pct_named AS rp, (w.week - m.d0) / 7e0 AS o, CASE WHEN k0 > 0 THEN pow(k1 / k0, 1e0 / span) ELSE 1e0 END AS g,
  CASE CAST(w.week AS VARCHAR) {' '.join(f"WHEN '{k}' THEN {v}e0" for k, v in INCIDENT_WEEKS.items())} END AS f,
  m.state IN ({quoted(d.INCIDENT_STATES)}) AND m.class IN ({quoted(INCIDENT_CLASSES)})
  AND CAST(w.week AS VARCHAR) IN ({weeks}) AS listed
  FROM model m CROSS JOIN weeks w LEFT JOIN anchors a ON a.week = w.week
  LEFT JOIN inside i ON i.release = a.release AND i.state = m.state AND i.class = m.class""",
        "values_": """SELECT *, listed AND NOT anchor AS hit, least(1e0, greatest(0e0, o / span)) AS fr FROM joined""",
        "weekly": f"""SELECT week, state, CASE WHEN class IN ({quoted(CLASS_ORDER)}) THEN class END AS class,
  greatest(0e0, CASE WHEN anchor THEN coalesce(rk, 0e0) WHEN g = 0 AND o < 0 THEN k0 ELSE k0 * pow(g, o) END
    * CASE WHEN hit THEN f ELSE 1e0 END) AS length_km,
  CAST(round_even(greatest(0e0, CASE WHEN anchor THEN coalesce(CAST(rs AS DOUBLE), 0e0) ELSE s0 + (s1 - s0) * fr END
    * CASE WHEN hit THEN f ELSE 1e0 END), 0) AS BIGINT) AS segments,
  least(100e0, greatest(0e0, CASE WHEN anchor THEN coalesce(rp, 0e0) ELSE p0 + (p1 - p0) * fr END)) AS pct_named,
  CASE WHEN anchor THEN 'Overture release' ELSE 'simulated' END AS source, hit AS incident FROM values_""",
    }


_W = _series(4, 4, True)
_PLAIN = {k + "_p": v for k, v in _series(2, 6, False).items()}
for _k, _v in _W.items():
    CTE[_k] = _v
WEEKLY = INSIDE + list(_W)

CTE["places"] = """SELECT c_custkey AS id, 8.47e0 + (c_custkey * 37 % 3300) / 1e4 AS lon,
  50.02e0 + (c_custkey * 91 % 2100) / 1e4 AS lat, CASE WHEN c_custkey % 17 <> 0 THEN lower(c_mktsegment) END AS category,
  CASE WHEN c_acctbal < 0 THEN 'permanently_closed' ELSE 'open' END AS operating_status,
  (c_acctbal + 1e3) / 11e3 AS confidence, c_name AS name, n_name AS locality
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
CTE["monthly"] = f"""SELECT concat(strftime(o_orderdate, '%Y-%m'), '-15.0') AS release, n_name AS state, {_CASE} AS class,
  count(*) AS segments, sum(o_totalprice / 1e3) AS length_km,
  100e0 * count(*) FILTER (o_orderkey % 3 <> 0) / count(*) AS pct_named
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
CTE["scopes"] = f"""SELECT concat(m, '-15.0') AS release,
  CASE WHEN CAST(m[:4] AS INT) % 2 = 0 THEN {d.GERMANY} ELSE {d.BAYERN} END AS bbox,
  CASE WHEN CAST(m[6:7] AS INT) <= 6 THEN ['motorway', 'primary', 'trunk']
  ELSE ['living_street', 'residential', 'unclassified', 'motorway', 'primary', 'trunk'] END AS classes
  FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders) WHERE m[6:7] <> '12'"""
CTE["every_scope"] = f"""SELECT concat(m, '-15.0') AS release,
  CASE WHEN CAST(m[:4] AS INT) % 2 = 0 THEN {d.GERMANY} ELSE {d.BAYERN} END AS bbox,
  CASE WHEN CAST(m[6:7] AS INT) <= 6 THEN ['motorway', 'primary', 'trunk']
  ELSE ['living_street', 'residential', 'unclassified', 'motorway', 'primary', 'trunk'] END AS classes
  FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m FROM orders)"""
CTE["released"] = "SELECT DISTINCT release FROM monthly"
_EN = "format('{:,.2f}', o_totalprice)"
CTE["answers0"] = f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'de' END AS lang,
  CASE o_orderstatus WHEN 'O' THEN 'number' WHEN 'P' THEN 'set' ELSE 'refusal' END AS "check",
  CASE WHEN o_orderkey % 3 = 0 THEN 'granite:8b' ELSE concat('basalt-', CAST(o_orderkey % 5 AS VARCHAR)) END AS model,
  o_totalprice AS price, o_orderkey % 4 AS v, o_orderkey % 7 <> 0 AS tool_ok,
  (o_orderkey * 37 % 9973) / 1e2 AS seconds, CAST(o_orderdate AS DATE) AS day FROM orders"""
CTE["answers"] = """SELECT *, CASE "check"
  WHEN 'number' THEN CASE v WHEN 0 THEN concat('The total is ', format('{:,.2f}', price), ' km.')
    WHEN 1 THEN concat('Es sind ', translate(format('{:,.2f}', price), ',.', '.,'), ' Kilometer.')
    WHEN 2 THEN concat('About ', format('{:,.2f}', price + 1), '.') ELSE 'The data does not contain this.' END
  WHEN 'set' THEN CASE v WHEN 0 THEN 'Living street and Motorway lead.' WHEN 1 THEN 'living-street, MOTORWAY'
    WHEN 2 THEN 'Only motorway' ELSE 'Neither.' END
  ELSE CASE v WHEN 0 THEN 'I cannot answer that.' WHEN 1 THEN 'Leider keine Angaben.'
    WHEN 2 THEN 'There were 312.' ELSE 'Nothing found.' END END AS answer FROM answers0"""


def readings(text: str) -> str:
    """List of all number readings of a text expression."""
    tokens = f"list_transform(regexp_extract_all({text}, '\\d[\\d.,]*'), lambda t: rtrim(t, '.,'))"
    return (f"list_filter(flatten(list_transform({tokens}, lambda t: [TRY_CAST(replace(t, ',', '') AS DOUBLE), "
            "TRY_CAST(replace(replace(t, '.', ''), ',', '.') AS DOUBLE), TRY_CAST(replace(t, ',', '.') AS DOUBLE)])), "
            "lambda v: v IS NOT NULL)")


def norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[\\s_\\-]+', ' ', 'g'))"


_REFUSED = " OR ".join(f"contains(lower(answer), {quoted([m])})" for m in REFUSAL_MARKERS)
_MISSING = (f"list_filter(['living_street', 'motorway'], lambda v: NOT contains({norm('answer')}, {norm('v')}))")
CTE["scored0"] = f"""SELECT *, ({_REFUSED}) AS refused, {_MISSING} AS missing,
  len(list_filter({readings('answer')}, lambda r: abs(r - price) <= greatest(0.001e0, 1e-9))) > 0 AS number_hit
  FROM answers"""
CTE["scored"] = """SELECT *, CASE "check" WHEN 'refusal' THEN refused WHEN 'number' THEN number_hit
  ELSE len(missing) = 0 END AS passed, CASE "check"
  WHEN 'refusal' THEN CASE WHEN refused THEN 'refused' ELSE 'answered instead of refusing' END
  WHEN 'number' THEN concat('expected ', CAST(price AS VARCHAR))
  ELSE CASE WHEN len(missing) = 0 THEN 'all named' ELSE concat('missing ', array_to_string(missing, ', ')) END END AS detail
  FROM scored0"""
SCORED = ["answers0", "answers", "scored0", "scored"]

CTE["statements"] = f"""SELECT event_id, replace(([{quoted(d.STATEMENTS)}])[1 + event_id % {len(d.STATEMENTS)}],
  '{{u}}', CAST(user_id AS VARCHAR)) AS sql FROM events"""
CTE["tiles"] = """SELECT class, CAST(floor(x1) * 100 + floor(y1) AS INT) AS row_group_id,
  min(x1) AS xl, max(x1) AS xh, min(y1) AS yl, max(y1) AS yh, count(*) AS n,
  CAST(sum(CASE WHEN two THEN 5 ELSE 3 END) AS BIGINT) AS v FROM roads1 GROUP BY ALL"""
CTE["footers"] = """SELECT concat(class, '.parquet') AS file_name, row_group_id, path_in_schema, total_compressed_size,
  CASE WHEN class = 'trunk' AND row_group_id < 700 THEN NULL ELSE mn END AS mn,
  CASE WHEN class = 'trunk' AND row_group_id < 700 THEN NULL ELSE mx END AS mx FROM (
  SELECT class, row_group_id, 'bbox, xmin' AS path_in_schema, n * 8 AS total_compressed_size, xl AS mn, xh AS mx FROM tiles
  UNION ALL SELECT class, row_group_id, 'bbox, ymin', n * 8, yl, yh FROM tiles
  UNION ALL SELECT class, row_group_id, 'geometry', v * 16, NULL, NULL FROM tiles
  UNION ALL SELECT class, row_group_id, 'routes', n * 999, NULL, NULL FROM tiles)"""
_X0, _Y0, _X1, _Y1 = 8.47, 50.02, 10.80, 51.23
CTE["groups"] = f"""SELECT file_name, row_group_id,
  coalesce(max(mx) FILTER (path_in_schema = 'bbox, xmin') >= {_X0}e0 AND max(mn) FILTER (path_in_schema = 'bbox, xmin') <= {_X1}e0
  AND max(mx) FILTER (path_in_schema = 'bbox, ymin') >= {_Y0}e0 AND max(mn) FILTER (path_in_schema = 'bbox, ymin') <= {_Y1}e0,
  false) AS kept, count(mn) < 2 AS no_statistics FROM footers GROUP BY file_name, row_group_id"""
FOOTERS = ["roads0", "roads1", "tiles", "footers", "groups"]
CTE["customer_groups"] = """SELECT c_mktsegment AS file_name, c_nationkey AS row_group_id, min(c_name) AS lo,
  max(c_name) AS hi, CAST(sum(length(c_name)) AS BIGINT) AS b FROM customer GROUP BY ALL"""


def sql(names: list[str], body: str, extra: dict | None = None, recursive: bool = False) -> str:
    parts = [f"{n} AS ({CTE[n]})" for n in names] + [f"{n} AS ({t})" for n, t in (extra or {}).items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ORACLE: dict[str, str] = {}
O = ORACLE

# ---------------------------------------------------------------- regions and statistics
O["release_stats"] = sql(STATS, "SELECT release, state, class, segments, length_km, mean_segment_m, pct_named FROM stats")
O["cell_states"] = sql(STATS[:-1], """SELECT c.cx, c.cy, l.state FROM (SELECT DISTINCT cx, cy FROM versions) c
LEFT JOIN lookup l ON l.cx = c.cx AND l.cy = c.cy""")
O["segment_states"] = sql(STATS[:-1], """SELECT release, id, coalesce(state, 'outside DE') AS state
FROM versions LEFT JOIN lookup USING (cx, cy)""")
O["states_distinct"] = sql(STATS, """SELECT count(DISTINCT state) AS states,
count(DISTINCT concat(state, '|', class)) AS state_classes FROM stats""")
O["national_km"] = sql(STATS, """SELECT release, round(coalesce(sum(length_km) FILTER (state <> 'outside DE'), 0e0), 6) AS km
FROM stats GROUP BY release""")
_HEAD = """sum(length_km) AS total_km, CAST(sum(segments) AS BIGINT) AS segments,
  CASE WHEN sum(length_km) = 0 THEN 0e0 ELSE sum(pct_named * length_km) / sum(length_km) END AS pct_named,
  count(DISTINCT state) AS states, count(DISTINCT class) AS classes"""
O["headline"] = sql(INSIDE, f"""SELECT release, {r6('total_km')}, segments, {r6('pct_named')}, states, classes FROM (
SELECT release, {_HEAD} FROM inside GROUP BY release)""")
O["state_ranking"] = sql(INSIDE, """SELECT release, state, round(sum(length_km), 6) AS length_km FROM inside
GROUP BY release, state""")


def _compare(dim):
    return {"a": f"SELECT {dim}, sum(length_km) AS km, sum(segments) AS n FROM inside WHERE release = '{d.RELEASE_A}' GROUP BY {dim}",
            "b": f"SELECT {dim}, sum(length_km) AS km, sum(segments) AS n FROM inside WHERE release = '{d.RELEASE_B}' GROUP BY {dim}",
            "cmp": f"""SELECT coalesce(a.{dim}, b.{dim}) AS {dim}, coalesce(a.km, 0e0) AS length_km_a,
  CAST(coalesce(a.n, 0) AS BIGINT) AS segments_a, coalesce(b.km, 0e0) AS length_km_b, CAST(coalesce(b.n, 0) AS BIGINT) AS segments_b,
  coalesce(b.km, 0e0) - coalesce(a.km, 0e0) AS delta_km, CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS delta_segments,
  CASE WHEN a.km > 0 THEN 100e0 * (coalesce(b.km, 0e0) - a.km) / a.km END AS pct_change
  FROM a FULL OUTER JOIN b ON a.{dim} = b.{dim}"""}


def _cmp_cols(dim):
    return (f"SELECT {dim}, {r6('length_km_a')}, segments_a, {r6('length_km_b')}, segments_b, {r6('delta_km')}, "
            f"delta_segments, {r6('pct_change')} FROM cmp")


O["compare_state"] = sql(INSIDE, _cmp_cols("state"), _compare("state"))
O["compare_class"] = sql(INSIDE, _cmp_cols("class"), _compare("class"))
O["gain_loss"] = sql(INSIDE, """SELECT round(sum(delta_km), 6) AS net_km,
round(coalesce(sum(delta_km) FILTER (delta_km > 0), 0e0), 6) AS gained_km,
round(coalesce(sum(delta_km) FILTER (delta_km < 0), 0e0), 6) AS lost_km FROM cmp""", _compare("state"))
O["top_delta"] = sql(INSIDE, _cmp_cols("state") + " ORDER BY abs(cmp.delta_km) DESC, state LIMIT 16", _compare("state"))
O["release_dates"] = sql(["monthly"], "SELECT DISTINCT release, CAST(release[:10] AS DATE) AS release_date FROM monthly")
O["scope_groups"] = sql(["every_scope"], """SELECT a.release, min(b.release) AS scope_group,
max(b.release) FILTER (b.release < a.release) AS previous
FROM every_scope a JOIN every_scope b ON a.bbox = b.bbox AND a.classes = b.classes GROUP BY a.release""")
O["comparable_pairs"] = sql(["every_scope"], """SELECT max(a.release) AS release_a, b.release AS release_b
FROM every_scope a JOIN every_scope b ON a.bbox = b.bbox AND a.classes = b.classes AND a.release < b.release GROUP BY b.release""")
O["scope_groups_every_month"] = sql(["every_scope"], """SELECT a.release, min(b.release) AS scope_group,
max(b.release) FILTER (b.release < a.release) AS previous
FROM every_scope a JOIN every_scope b ON a.bbox = b.bbox AND a.classes = b.classes GROUP BY a.release""")
O["comparable_pairs_every_month"] = sql(["every_scope"], """SELECT max(a.release) AS release_a, b.release AS release_b
FROM every_scope a JOIN every_scope b ON a.bbox = b.bbox AND a.classes = b.classes AND a.release < b.release GROUP BY b.release""")
O["comparability"] = sql(["monthly", "released", "scopes"], """SELECT r.release,
CASE WHEN a.bbox IS NULL OR s.bbox IS NULL OR a.bbox <> s.bbox OR a.classes <> s.classes THEN false ELSE true END AS comparable,
CASE WHEN a.bbox IS NULL OR s.bbox IS NULL THEN 'No scope record' WHEN a.bbox <> s.bbox THEN 'Different areas'
WHEN a.classes <> s.classes THEN 'Different road classes' ELSE '' END AS reason_kind
FROM released r LEFT JOIN scopes s ON s.release = r.release LEFT JOIN scopes a ON a.release = '1998-03-15.0'""")
O["classes_covered"] = sql(["monthly", "scopes"], """SELECT release, array_to_string(classes, ',') AS classes,
list_has_all(classes, ['residential', 'living_street', 'unclassified']) AS full_drivable FROM (
SELECT p.release, coalesce(s.classes, p.present) AS classes FROM (
SELECT release, list_sort(list(DISTINCT class)) AS present FROM monthly GROUP BY release) p
LEFT JOIN scopes s ON s.release = p.release)""")
O["scope_attach"] = sql(["monthly", "released", "scopes"], """SELECT r.release, CAST(r.release[:10] AS DATE) AS release_date,
CAST(s.bbox[1] AS DOUBLE) AS xmin, coalesce(array_to_string(s.classes, ','), NULL) AS classes
FROM released r LEFT JOIN scopes s ON s.release = r.release""")
O["headline_delta"] = sql(["monthly", "scopes"], f"""SELECT n.release, {r6('total_km')}, segments, {r6('pct_named')},
p.release AS previous, round(p.km, 6) AS previous_km, round(total_km - p.km, 6) AS delta_km,
round(100e0 * (total_km - p.km) / p.km, 6) AS delta_pct
FROM head n LEFT JOIN LATERAL (
  SELECT h.release, h.total_km AS km FROM head h JOIN scopes sh ON sh.release = h.release
  JOIN scopes sn ON sn.release = n.release AND sn.bbox = sh.bbox AND sn.classes = sh.classes
  WHERE h.release < n.release ORDER BY h.release DESC LIMIT 1) p ON true""",
                          {"head": f"SELECT release, {_HEAD} FROM monthly GROUP BY release"})
O["latest_release"] = sql(["monthly"], f"""SELECT release, state, class, segments, {r6('length_km', 'pct_named')}
FROM monthly WHERE release = (SELECT max(release) FROM monthly)""")

# ---------------------------------------------------------------- feature differences
_SIDES = {"ra": f"SELECT id, class, length_km FROM versions WHERE release = '{d.RELEASE_A}'",
          "rb": f"SELECT id, class, length_km FROM versions WHERE release = '{d.RELEASE_B}'"}
O["churn"] = sql(PAIR, """SELECT count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS kept,
count(*) FILTER (a.id IS NULL) AS added, count(*) FILTER (b.id IS NULL) AS removed,
round(coalesce(sum(b.length_km) FILTER (a.id IS NULL), 0e0), 6) AS added_km,
round(coalesce(sum(a.length_km) FILTER (b.id IS NULL), 0e0), 6) AS removed_km,
round(coalesce(sum(b.length_km) FILTER (a.id IS NULL), 0e0) - coalesce(sum(a.length_km) FILTER (b.id IS NULL), 0e0), 6) AS net_km,
count(*) FILTER (abs(b.length_km - a.length_km) > 0.001) AS changed_length
FROM ra a FULL OUTER JOIN rb b ON a.id = b.id""", _SIDES)
O["length_changes"] = sql(PAIR, """SELECT a.id, round(a.length_km, 6) AS km_a, round(b.length_km, 6) AS km_b,
round(b.length_km - a.length_km, 6) AS delta_km FROM ra a JOIN rb b ON a.id = b.id
WHERE abs(b.length_km - a.length_km) > 0.001""", _SIDES)
O["added_features"] = sql(PAIR, "SELECT id, class, round(length_km, 6) AS length_km FROM rb WHERE id NOT IN (SELECT id FROM ra)", _SIDES)
O["removed_features"] = sql(PAIR, "SELECT id, class, round(length_km, 6) AS length_km FROM ra WHERE id NOT IN (SELECT id FROM rb)", _SIDES)
O["kept_features"] = sql(PAIR, "SELECT id, class, round(length_km, 6) AS length_km FROM rb WHERE id IN (SELECT id FROM ra)", _SIDES)
O["id_sets"] = sql(PAIR, """SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added'
WHEN b.id IS NULL THEN 'removed' ELSE 'kept' END AS status FROM ra a FULL OUTER JOIN rb b ON a.id = b.id""", _SIDES)
O["one_per_id"] = """SELECT l_orderkey AS id, l_linenumber, l_partkey, l_quantity FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) = 1"""
O["path_parts"] = sql(ROADS, """SELECT id, class, 0 AS path_no, 3 AS vertices, round(km1, 6) AS path_km FROM roads
UNION ALL SELECT id, class, 1, 2, round(km2, 6) FROM roads WHERE two""")

# ---------------------------------------------------------------- weekly series
_WK = f"week, state, class, {r6('length_km')}, segments, {r6('pct_named')}, source, incident"
O["weekly_series"] = sql(WEEKLY, f"SELECT {_WK} FROM weekly")
O["weekly_series_plain"] = sql(INSIDE, f"SELECT {_WK} FROM weekly", _series(2, 6, False))


def _totals(by):
    keys = ", ".join(["week", *by])
    where = f"WHERE {by[0]} IS NOT NULL" if by else ""
    return {"totals": f"""SELECT {keys}, sum(length_km) AS length_km, CAST(sum(segments) AS BIGINT) AS segments,
  bool_or(incident) AS incident, CASE WHEN sum(length_km) > 0 THEN sum(pct_named * length_km) / sum(length_km) END AS pct_named,
  CASE WHEN bool_and(source = 'Overture release') THEN 'Overture release' ELSE 'simulated' END AS source
  FROM weekly {where} GROUP BY {keys}"""}


def _totals_out(by):
    return f"SELECT {', '.join(['week', *by])}, {r6('length_km')}, segments, incident, {r6('pct_named')}, source FROM totals"


O["weekly_totals"] = sql(WEEKLY, _totals_out([]), _totals([]))
O["weekly_by_state"] = sql(WEEKLY, _totals_out(["state"]), _totals(["state"]))
O["weekly_by_class"] = sql(WEEKLY, _totals_out(["class"]), _totals(["class"]))
O["measured_only"] = sql(WEEKLY, _totals_out([]) + " WHERE source = 'Overture release'", _totals([]))
O["class_index"] = sql(WEEKLY, """SELECT class, week, round(length_km, 6) AS length_km, source,
round(100e0 * (length_km - k) / k, 6) AS pct_vs_first FROM (
SELECT *, first_value(length_km) OVER (PARTITION BY class ORDER BY week) AS k FROM totals)""", _totals(["class"]))


def _drops(by, threshold):
    over = f"{'PARTITION BY ' + by[0] if by else ''} ORDER BY week"
    return {**_totals(by), "drops": f"""SELECT *, CASE WHEN CAST(week AS VARCHAR) IN ({quoted(INCIDENT_WEEKS)})
  THEN {quoted([INCIDENT_NAME])} END AS cause FROM (
  SELECT *, 100e0 * (length_km - prev_km) / prev_km AS wow_pct FROM (
  SELECT *, lag(length_km) OVER ({over}) AS prev_km FROM totals)) WHERE wow_pct < {threshold}"""}


O["wow_drops"] = sql(WEEKLY, f"SELECT week, state, {r6('length_km', 'prev_km', 'wow_pct')}, cause FROM drops",
                     _drops(["state"], -0.5))
O["worst_week"] = sql(WEEKLY, "SELECT week, state, round(w.wow_pct, 6) AS wow_pct, cause FROM drops w ORDER BY w.wow_pct, week LIMIT 1",
                      _drops(["state"], -0.5))
O["drops_overall"] = sql(WEEKLY, f"SELECT week, {r6('length_km', 'prev_km', 'wow_pct')}, cause FROM drops", _drops([], 0.55))

# ---------------------------------------------------------------- places
_DIST = f"{hav('lon', 'lat', '8.6821e0', '50.1106e0')} * 1000"
_PLACE = "id, lon, lat, category, operating_status, confidence, name, locality"
O["area_filter"] = sql(["places"], f"SELECT {_PLACE} FROM places WHERE lon BETWEEN 8.55e0 AND 8.80e0 AND lat BETWEEN 50.10e0 AND 50.23e0")
O["within_radius"] = sql(["places"], f"SELECT id, category, round({_DIST}, 6) AS distance_m FROM places WHERE {_DIST} <= 3000")
O["radius_count"] = sql(["places"], f"SELECT count(*) AS n FROM places WHERE category = 'building' AND {_DIST} <= 3000")
_MARKS = "(VALUES " + ", ".join(f"('{n}', {x}e0, {y}e0)" for n, x, y in d.LANDMARKS) + ") AS m(landmark, to_lon, to_lat)"
_MDIST = f"{hav('lon', 'lat', 'to_lon', 'to_lat')} * 1000"
O["distance_join"] = sql(["places"], f"SELECT id, landmark, round({_MDIST}, 6) AS distance_m FROM places, {_MARKS} WHERE {_MDIST} <= 2500")
O["places_near_sites"] = sql(["places"], f"""SELECT landmark, count(*) AS places FROM places JOIN sites
ON lat BETWEEN to_lat - 0.01 AND to_lat + 0.01 AND {_MDIST} <= 1000 WHERE operating_status = 'open' GROUP BY landmark""", {
    "sites": """SELECT s_suppkey AS landmark, 8.47e0 + (s_suppkey * 131 % 3300) / 1e4 AS to_lon,
  50.02e0 + (s_suppkey * 57 % 2100) / 1e4 AS to_lat FROM supplier"""})
O["simple_totals"] = sql(["places"], """SELECT count(*) AS n, round(avg(confidence), 6) AS average,
round(min(confidence), 6) AS low, round(max(confidence), 6) AS high FROM places WHERE category = 'building' OR name ILIKE '%7%'""")
O["road_km_by_class"] = sql(ROADS, "SELECT class, round(sum(length_km), 6) AS km FROM roads GROUP BY class ORDER BY sum(length_km) DESC, class LIMIT 1")
O["breakdown_roads"] = sql(ROADS, """SELECT class, round(sum(length_km), 6) AS km FROM roads WHERE status <> 'F'
GROUP BY class ORDER BY sum(length_km) DESC, class""")
O["breakdown_places"] = sql(["places"], """SELECT category, count(*) AS "count" FROM places
WHERE operating_status = 'permanently_closed' GROUP BY category ORDER BY count(*) DESC, category NULLS LAST""")
O["top_categories"] = sql(["places"], """SELECT category, count(*) AS n FROM places WHERE category IS NOT NULL
GROUP BY category ORDER BY n DESC, category LIMIT 3""")
O["distinct_names"] = sql(["roads0"], """SELECT count(DISTINCT name) AS names FROM roads0
WHERE class = 'motorway' AND name IS NOT NULL AND name <> ''""")
O["matching_values"] = sql(["places"], "SELECT DISTINCT category FROM places WHERE category ILIKE '%U%'")
O["highlight"] = sql(["places"], "SELECT id, category, lon, lat FROM places WHERE category = 'machinery'")
O["map_projection"] = sql(["places"], "SELECT id, lon, lat, category FROM places")
O["chart_frame"] = sql(["places"], """SELECT locality AS label, CAST(count(*) AS DOUBLE) AS value FROM places
GROUP BY locality ORDER BY value DESC, label""")
O["viewport"] = sql(["places"], f"""SELECT round(min(lon) - 0.006e0, 6) AS west, round(min(lat) - 0.006e0, 6) AS south,
round(max(lon) + 0.006e0, 6) AS east, round(max(lat) + 0.006e0, 6) AS north FROM places WHERE {_DIST} <= 3000""")

# ---------------------------------------------------------------- profiles
O["column_profile"] = sql(["places"], "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS non_null,
CAST(round(CAST(100e0 * (count(*) - count({c})) / count(*) AS DECIMAL(28, 10)), 1) AS DOUBLE) AS null_pct,
count(DISTINCT {c}) AS unique_values FROM places""" for c in _PLACE.split(", ")))
O["numeric_summary"] = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q1,
round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_partkey"))
O["group_quantiles"] = "\nUNION ALL ".join(
    f"""SELECT l_returnflag, {p}e0 AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS quantile
FROM lineitem GROUP BY l_returnflag""" for p in (0.0, 0.1, 0.5, 0.99, 1.0))
O["line_summary"] = sql(ROADS, """SELECT round(sum(length_km), 6) AS total_length_km, count(length_km) AS line_features,
round(avg(length_km) * 1000, 6) AS mean_segment_m FROM roads""")
O["table_points"] = sql(["places"], "SELECT lon, lat FROM places")

# ---------------------------------------------------------------- geometry
O["spheroid_length"] = sql(ROADS + ["ellipsoidal"], "SELECT id, round(metres, 3) AS metres FROM ellipsoidal")
O["path_length"] = sql(ROADS, "SELECT id, round(length_km, 6) AS length_km FROM roads")
O["centroid"] = sql(ROADS + ["cells0"], "SELECT id, round(gx, 6) AS x, round(gy, 6) AS y, cx, cy FROM cells0")
_MEAN = {c: f"CASE WHEN two THEN ({c}1 + {c}2 + {c}3 + {c}4 + {c}5) / 5 ELSE ({c}1 + {c}2 + {c}3) / 3 END" for c in "xy"}
_LOW = {c: f"CASE WHEN two THEN least({c}1, {c}2, {c}3, {c}4, {c}5) ELSE least({c}1, {c}2, {c}3) END" for c in "xy"}
_HIGH = {c: f"CASE WHEN two THEN greatest({c}1, {c}2, {c}3, {c}4, {c}5) ELSE greatest({c}1, {c}2, {c}3) END" for c in "xy"}
_BOX = (f"round({_LOW['x']}, 6) AS bbox_min_lon, round({_LOW['y']}, 6) AS bbox_min_lat, "
        f"round({_HIGH['x']}, 6) AS bbox_max_lon, round({_HIGH['y']}, 6) AS bbox_max_lat")
_SPOT = f"round({_MEAN['x']}, 6) AS lon, round({_MEAN['y']}, 6) AS lat"
O["rep_point"] = sql(["roads0", "roads1"], f"SELECT id, {_SPOT}, {_BOX} FROM roads1")
O["polygon_area"] = sql(["grid", "corner", "edges"], "SELECT state, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area FROM edges GROUP BY state")
O["point_in_polygon"] = sql(["grid", "corner", "edges"], """SELECT s_suppkey, p.state, count(*) FILTER (
(e.y1 > p.y) <> (e.y2 > p.y) AND p.x < e.x1 + (p.y - e.y1) * (e.x2 - e.x1) / nullif(e.y2 - e.y1, 0)) % 2 = 1 AS inside
FROM sites p JOIN edges e ON e.state = p.state GROUP BY s_suppkey, p.state""", {
    "sites": """SELECT s_suppkey, n_name AS state, 6e0 + (s_suppkey * 7919 % 8600) / 1e3 AS x,
  47.5e0 + (s_suppkey * 104729 % 6600) / 1e3 AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey"""})
O["geojson_features"] = sql(ROADS, f"""SELECT CAST(id AS VARCHAR) AS feature_id, class, name,
round(length_km, 4) AS length_km, name IS NOT NULL AS is_named, round(length_km, 6) AS geom_length_km,
CASE WHEN two THEN 'MultiLineString' ELSE 'LineString' END AS geom_type, status AS code, {_SPOT}, {_BOX} FROM roads""")
O["geom_types"] = """SELECT CASE WHEN o_orderstatus = 'P' THEN 'MultiLineString' ELSE 'LineString' END AS geom_type,
count(*) AS features FROM orders GROUP BY 1"""
O["table_envelope"] = sql(["roads0", "roads1"], f"""SELECT round(min({_LOW['x']}), 6) AS min_lon, round(min({_LOW['y']}), 6) AS min_lat,
round(max({_HIGH['x']}), 6) AS max_lon, round(max({_HIGH['y']}), 6) AS max_lat FROM roads1""")
O["default_restore"] = sql(["roads0"], "SELECT class, name IS NOT NULL AS is_named, count(*) AS n FROM roads0 GROUP BY ALL")
_PLACED = {c: f"{c}1 + 2 * {c}2 + 3 * {c}3 + CASE WHEN two THEN 4 * {c}4 + 5 * {c}5 ELSE 0e0 END" for c in "xy"}
_THINNED = {c: f"{c}1 + 2 * {c}3 + CASE WHEN two THEN 3 * {c}4 + 4 * {c}5 ELSE 0e0 END" for c in "xy"}
O["wkb_roundtrip"] = sql(ROADS, "SELECT id, CASE WHEN two THEN 107 ELSE 57 END AS wkb_bytes, round(length_km, 6) AS length_km, "
                         + ", ".join(f"round({_PLACED[c]}, 6) AS placed_{c}" for c in "xy") + " FROM roads")
O["simplify"] = sql(["roads0", "roads1"], "SELECT id, CASE WHEN s >= 2 THEN 3 ELSE 2 END + CASE WHEN two THEN 2 ELSE 0 END AS vertices, "
                    + ", ".join(f"round(CASE WHEN s >= 2 THEN {_PLACED[c]} ELSE {_THINNED[c]} END, 6) AS placed_{c}" for c in "xy") + " FROM roads1")
O["simplify_paths"] = O["simplify"]
O["slim_features"] = sql(STATS[:-1], """SELECT CAST(id AS VARCHAR) AS id, class, state, name, name IS NOT NULL AS is_named,
round(length_km, 4) AS length_km, round(map_km, 6) AS map_km
FROM rounded JOIN (SELECT id AS k, cx, cy FROM cells0) c ON c.k = id JOIN placed USING (cx, cy)
WHERE class IN ('motorway', 'trunk')""", {
    "fine": "SELECT id, class, name, two, length_km, " + ", ".join(
        f"CAST(round(CAST({c}{i} AS DECIMAL(28, 12)), 5) AS DOUBLE) AS {c}{i}" for i in range(1, 6) for c in "xy") + " FROM roads",
    "rounded": f"""SELECT *, {hav('x1', 'y1', 'x2', 'y2')} + {hav('x2', 'y2', 'x3', 'y3')}
  + CASE WHEN two THEN {hav('x4', 'y4', 'x5', 'y5')} ELSE 0e0 END AS map_km FROM fine""",
    "placed": """SELECT cx, cy, min(state) AS state FROM (
  SELECT c.cx, c.cy, e.state FROM (SELECT DISTINCT cx, cy FROM cells0) c JOIN edges e
  ON (e.y1 > c.cy / 100e0) <> (e.y2 > c.cy / 100e0)
  AND c.cx / 100e0 < e.x1 + (c.cy / 100e0 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
  GROUP BY c.cx, c.cy, e.state HAVING count(*) % 2 = 1) GROUP BY cx, cy"""})
O["slim_places"] = sql(["places"], """SELECT CAST(id AS VARCHAR) AS id, category, operating_status, false AS has_basic,
round(lon, 5) AS lon, round(lat, 5) AS lat FROM places""")

# ---------------------------------------------------------------- text, answers, logs, statements
O["number_readings"] = f"""SELECT doc_id, CAST(len(v) AS INT) AS readings, list_max(v) AS largest, list_min(v) AS smallest
FROM (SELECT doc_id, {readings('text')} AS v FROM documents)"""
O["normalized_text"] = f"""SELECT conv_id, turn, role, length({norm('text')}) AS length,
contains(lower(text), 'que') OR contains(lower(text), 'the') OR contains(lower(text), 'nicht') AS hit FROM conversations"""
O["score_answers"] = sql(SCORED, 'SELECT id, model, "check", passed, tool_ok, detail FROM scored')


def _pairs():
    out = []
    for name, cond in (("en", "lang = 'en'"), ("de", "lang = 'de'"), ("number", "\"check\" = 'number'"),
                       ("set", "\"check\" = 'set'"), ("refusal", "\"check\" = 'refusal'")):
        out += [f"count(*) FILTER ({cond} AND passed) AS {name}_passed", f"count(*) FILTER ({cond}) AS {name}_total"]
    return ", ".join(out)


O["eval_summary"] = sql(SCORED, f"""SELECT model, count(*) FILTER (passed) AS passed, count(*) AS total, {_pairs()},
count(*) FILTER ("check" <> 'refusal' AND tool_ok) AS valid_sql, count(*) FILTER ("check" <> 'refusal') AS answerable,
round(median(seconds), 6) AS median_seconds FROM scored GROUP BY model""")
O["eval_failures"] = sql(SCORED, """SELECT model, id, detail, replace(answer, chr(10), ' ')[:160] AS excerpt
FROM scored WHERE NOT passed""")
O["latest_run"] = sql(["answers0"], """SELECT model, run_date, id FROM (
SELECT model, CAST(day AS VARCHAR) AS run_date, id, max(day) OVER (PARTITION BY model) AS newest, day FROM (
SELECT id, day, CASE WHEN day >= DATE '1996-01-01' THEN model ELSE regexp_replace(replace(model, ':', '_'), '_([^_]*)$', ':\\1') END AS model
FROM answers0)) WHERE day = newest""")
O["log_summary"] = """SELECT count(*) AS turns, median(value) AS median_seconds,
count(*) FILTER (event_type = 'error') AS turns_with_failure FROM events"""
_WINDOWS = """SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS turns,
count(*) FILTER (event_type = 'error') AS turns_with_failure, round(avg(value), 6) AS mean_seconds FROM (
SELECT time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01') AS window_start, event_type, value FROM events)"""
O["turn_windows"] = _WINDOWS + " GROUP BY window_start"
# The stream has emitted the windows that ended before its final watermark.
O["turn_stream"] = O["turn_windows"] + """ HAVING window_start + INTERVAL 6 HOUR <=
(SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 2 HOUR FROM events)"""


def _audit(source: str, columns: str) -> str:
    starts, readers, writes = ("|".join(v) for v in (STATEMENT_STARTS, FILE_READERS, WRITE_KEYWORDS))
    return f"""WITH bare0 AS (SELECT {columns}, regexp_replace(regexp_replace(sql, '--[^\\n]*', ' ', 'g'), '/\\*.*?\\*/', ' ', 'gs') AS b
  FROM {source}), bare AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(b, '^\\s+|\\s+$', '', 'g'), ';+$', ''),
  '^\\s+|\\s+$', '', 'g') AS q FROM bare0), judged AS (SELECT *, CASE WHEN q = '' THEN 'empty'
  WHEN contains(q, ';') THEN 'several'
  WHEN NOT regexp_matches(q, '^({starts})\\b', 'i') THEN 'kind'
  WHEN regexp_matches(q, '\\b({readers})\\w*\\s*\\(', 'i') THEN 'file'
  WHEN regexp_matches(regexp_replace(q, '''(?:[^''\\\\]|\\\\.)*''|"(?:[^"\\\\]|\\\\.)*"', '''''', 'g'), '\\b({writes})\\b', 'i')
  THEN concat('keyword: ',
  regexp_extract(regexp_replace(q, '''(?:[^''\\\\]|\\\\.)*''|"(?:[^"\\\\]|\\\\.)*"', '''''', 'g'), '\\b({writes})\\b', 1, 'i')) END AS reason FROM bare)
"""


O["sql_audit"] = _audit(f"({CTE['statements']})", "event_id") + "SELECT event_id, reason IS NULL AS allowed, reason FROM judged"
O["audit_documents"] = _audit("(SELECT doc_id, text AS sql FROM documents)", "doc_id") + \
    "SELECT reason IS NULL AS allowed, reason, count(*) AS n FROM judged GROUP BY ALL"

O["ad_hoc_query"] = sql(ROADS + ["places"], """SELECT p.category, count(*) AS n, round(sum(r.length_km), 6) AS km
FROM places p JOIN roads r ON r.id = p.id WHERE operating_status = 'open' AND category ILIKE '%u%' GROUP BY p.category""")
O["summarize_table"] = sql(["places"], "\nUNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS non_null, count(DISTINCT {c}) AS unique_values, round(avg({c}), 6) AS mean,
round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median FROM places""" for c in ("id", "lon", "lat", "confidence")))
O["expected_answers"] = sql(["roads0", "places"], """SELECT 'en04' AS id, 'en' AS lang, 'number' AS "check", 0e0 AS rel_tol, 0e0 AS abs_tol,
(SELECT CAST(count(*) AS VARCHAR) FROM places WHERE operating_status = 'permanently_closed') AS expected
UNION ALL SELECT 'en06', 'en', 'set', 0e0, 0e0, (SELECT string_agg(category, ',' ORDER BY category) FROM (
SELECT category FROM places WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3))
UNION ALL SELECT 'de05', 'de', 'number', 0.01e0, 0e0, (SELECT CAST(count(*) AS VARCHAR) FROM roads0 WHERE class = 'primary')
UNION ALL SELECT 'de09', 'de', 'refusal', 0e0, 0e0, ''""")

# ---------------------------------------------------------------- footers
O["row_groups_kept"] = sql(FOOTERS, "SELECT file_name, row_group_id, kept, no_statistics FROM groups")


def _estimate(leaves, by):
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return sql(FOOTERS, f"""SELECT {keys}count(DISTINCT (file_name, row_group_id)) FILTER (kept) AS groups_kept,
count(DISTINCT (file_name, row_group_id)) AS groups_total,
CAST(coalesce(sum(total_compressed_size) FILTER (kept AND path_in_schema IN ({quoted(leaves)})), 0) AS BIGINT) AS bytes,
count(DISTINCT (file_name, row_group_id)) FILTER (no_statistics) AS groups_without_statistics
FROM footers JOIN groups USING (file_name, row_group_id) {group}""")


O["estimate_bytes"] = _estimate(SEGMENT_LEAVES, "")
O["estimate_by_file"] = _estimate(PLACE_LEAVES, "file_name")
O["kept_footers"] = sql(FOOTERS, """SELECT file_name, row_group_id, path_in_schema, total_compressed_size
FROM footers JOIN groups USING (file_name, row_group_id) WHERE kept""")
O["estimate_boundaries"] = sql(["customer_groups"], """SELECT CAST(coalesce(sum(b + b * 16), 0) AS BIGINT) AS bytes
FROM customer_groups WHERE lo <= 'Customer#000000150' AND hi >= 'Customer#000000150'""")

# ---------------------------------------------------------------- admission
# The chain of admitted events per user: next is the first event after the last
# admitted one that lies more than a window after the one before that.
O["admission_window"] = """WITH RECURSIVE chain AS (
  SELECT user_id, CAST(NULL AS TIMESTAMP) AS t0, CAST(NULL AS TIMESTAMP) AS t1, CAST(-1 AS BIGINT) AS i1, false AS started
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, t1, m.t, m.i, true FROM (
    SELECT c.user_id, c.t1, min(struct_pack(t := CAST(e.ts AS TIMESTAMP), i := e.event_id)) AS m FROM chain c
    JOIN events e ON e.user_id = c.user_id AND (NOT c.started OR (CAST(e.ts AS TIMESTAMP), e.event_id) > (c.t1, c.i1))
      AND (c.t0 IS NULL OR CAST(e.ts AS TIMESTAMP) > c.t0 + INTERVAL 1 DAY)
    GROUP BY c.user_id, c.t1))
SELECT e.user_id, e.ts, e.event_id, CASE WHEN c.i1 IS NULL THEN 'window' ELSE 'admitted' END AS verdict
FROM events e LEFT JOIN chain c ON c.user_id = e.user_id AND c.i1 = e.event_id"""
O["admission_stream"] = O["admission_window"]
O["admission_single"] = """WITH RECURSIVE chain AS (
  SELECT user_id, min(struct_pack(t := CAST(ts AS TIMESTAMP), i := event_id)) AS m FROM events GROUP BY user_id
  UNION ALL
  SELECT user_id, m FROM (SELECT c.user_id, min(struct_pack(t := CAST(e.ts AS TIMESTAMP), i := e.event_id)) AS m FROM chain c
    JOIN events e ON e.user_id = c.user_id AND CAST(e.ts AS TIMESTAMP) > c.m.t + INTERVAL 6 HOUR GROUP BY c.user_id))
SELECT e.user_id, e.ts, e.event_id, CASE WHEN c.m IS NULL THEN 'window' ELSE 'admitted' END AS verdict
FROM events e LEFT JOIN chain c ON c.user_id = e.user_id AND c.m.i = e.event_id"""
# Day by day; the events of a day are folded in order over what each user was admitted at last.
O["admission_capped"] = """WITH RECURSIVE days AS (
  SELECT row_number() OVER (ORDER BY day) AS no, * FROM (
    SELECT CAST(ts AS DATE) AS day, list(struct_pack(u := user_id, t := epoch_us(CAST(ts AS TIMESTAMP)), i := event_id) ORDER BY ts, event_id) AS seen
    FROM events GROUP BY 1)),
run AS (
  SELECT CAST(0 AS BIGINT) AS no, struct_pack(last := MAP([CAST(-1 AS BIGINT)], [CAST(0 AS BIGINT)]), ids := CAST([] AS BIGINT[]), u := CAST(-1 AS BIGINT), t := CAST(0 AS BIGINT), i := CAST(-1 AS BIGINT)) AS s
  UNION ALL
  SELECT d.no, list_reduce(list_transform(d.seen, lambda e: struct_pack(last := r.s.last, ids := CAST([] AS BIGINT[]), u := CAST(e.u AS BIGINT), t := CAST(e.t AS BIGINT), i := CAST(e.i AS BIGINT))),
    lambda a, e: CASE WHEN len(a.ids) < 100 AND (a.last[e.u] IS NULL OR e.t - a.last[e.u] > 21600000000)
      THEN struct_pack(last := map_concat(a.last, MAP([e.u], [e.t])), ids := list_append(a.ids, e.i), u := e.u, t := e.t, i := e.i) ELSE a END,
    struct_pack(last := r.s.last, ids := CAST([] AS BIGINT[]), u := CAST(-1 AS BIGINT), t := CAST(0 AS BIGINT), i := CAST(-1 AS BIGINT)))
  FROM run r JOIN days d ON d.no = r.no + 1),
passed AS (SELECT no, unnest(s.ids) AS event_id FROM run),
full_days AS (SELECT d.day, max(struct_pack(t := CAST(e.ts AS TIMESTAMP), i := e.event_id)) AS last FROM passed p JOIN days d USING (no)
  JOIN events e USING (event_id) GROUP BY d.day HAVING count(*) = 100)
SELECT e.user_id, e.ts, e.event_id, CASE WHEN p.event_id IS NOT NULL THEN 'admitted'
  WHEN struct_pack(t := CAST(e.ts AS TIMESTAMP), i := e.event_id) > f.last THEN 'cap' ELSE 'window' END AS verdict
FROM events e LEFT JOIN passed p USING (event_id) LEFT JOIN full_days f ON f.day = CAST(e.ts AS DATE)"""
O["admission_stream_capped"] = O["admission_capped"]

# ---------------------------------------------------------------- files
O["csv_read"] = """SELECT o_orderkey AS order_key, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS order_date,
o_totalprice AS price, replace(CAST(o_totalprice AS VARCHAR), '.', ',') AS comma,
CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, o_orderkey % 2 = 0 AS even FROM orders"""
O["csv_quoted_split"] = r"""WITH notes AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 5
    WHEN 0 THEN 'first' || chr(10) || 'second "' || o_orderkey || '";' || chr(10) || chr(10) || 'last'
    WHEN 1 THEN repeat('long;' || chr(10), CAST(o_orderkey % 40 AS INTEGER) + 1) WHEN 2 THEN '"' ELSE 'plain' END AS note FROM orders)
SELECT o_orderkey AS order_key, CAST(length(note) AS INTEGER) AS note_chars, sha256(note) AS note_sha256, o_totalprice AS price FROM notes"""
O["stats_files"] = sql(INSIDE, """SELECT release, state, class, segments, length_km, mean_segment_m, pct_named,
CAST(release[:10] AS DATE) AS release_date FROM inside""")
O["scope_files"] = sql(["every_scope"], "SELECT release, array_to_string(classes, ',') AS classes, CAST(bbox[3] AS DOUBLE) AS xmax FROM every_scope")
O["scope_files_every_month"] = sql(["every_scope"], "SELECT release, array_to_string(classes, ',') AS classes, CAST(bbox[3] AS DOUBLE) AS xmax FROM every_scope")
O["feature_files"] = sql(ROADS, """SELECT CAST(id AS VARCHAR) AS feature_id, class, name, name IS NOT NULL AS is_named,
CASE WHEN two THEN 'MultiLineString' ELSE 'LineString' END AS geom_type, round(length_km, 4) AS length_km,
round(length_km, 6) AS geom_length_km FROM roads""")
O["geojson_mixed_files"] = O["feature_files"]
O["verified_rewrite"] = sql(ROADS, """SELECT count(*) AS features, CAST(0 AS BIGINT) AS different_ids,
round(sum(round(length_km, 4)), 6) AS km_before, true AS ok FROM roads""")
O["boundary_cache"] = sql(["grid", "corner", "edges"], f"SELECT state, {r6('x1', 'y1', 'x2', 'y2')} FROM edges")
O["boundary_scan"] = sql(["grid", "corner", "edges"], f"""SELECT state, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area,
round(min(x1), 6) AS xmin, round(max(x1), 6) AS xmax, round(min(y1), 6) AS ymin, round(max(y1), 6) AS ymax FROM edges
WHERE CAST(regexp_extract(state, '[0-9]+') AS INTEGER) % 4 <> 3 AND CAST(regexp_extract(state, '[0-9]+') AS INTEGER) % 5 <> 4 GROUP BY state""")
O["extract_scan"] = sql(ROADS + ["cells0", "ellipsoidal"], """SELECT class, name IS NOT NULL AS is_named, round(metres / 1000, 6) AS length_km, cx, cy,
CASE WHEN class = 'motorway' THEN CAST(id AS VARCHAR) END AS map_id, CASE WHEN class = 'motorway' THEN name END AS map_name
FROM cells0 JOIN ellipsoidal USING (id) WHERE status <> 'F' AND class IN ('motorway', 'primary') AND x1 BETWEEN 7e0 AND 12.5e0 AND y1 BETWEEN 48e0 AND 53.25e0""")
O["extract_places"] = sql(["places"], """SELECT CAST(id AS VARCHAR) AS id, name, category, 'poi' AS basic_category,
round(confidence, 6) AS confidence, operating_status, CASE WHEN operating_status = 'open' THEN locality END AS locality,
round(lon, 6) AS lon, round(lat, 6) AS lat FROM places WHERE lon BETWEEN 8.55e0 AND 8.80e0 AND lat BETWEEN 50.10e0 AND 50.23e0""")
O["turn_log_files"] = """SELECT event_type AS model, count(*) AS turns, count(*) AS queries,
count(*) FILTER (event_type = 'error') AS failed_queries FROM events GROUP BY event_type"""
O["run_files"] = sql(SCORED, """SELECT model, '2026-10-09' AS run_date, replace(model, ':', '_') AS model_name,
count(*) AS answers, count(*) FILTER (passed) AS passed FROM scored GROUP BY model""")
O["exact_sample"] = sql(["places"], "SELECT id, lon, lat FROM places ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT 500")
O["sample_rows"] = """(SELECT 'places' AS table_name, c_custkey AS id FROM customer ORDER BY 2 LIMIT 3) UNION ALL
(SELECT 'roads', o_orderkey FROM orders ORDER BY 2 LIMIT 3) UNION ALL (SELECT 'sites', s_suppkey FROM supplier ORDER BY 2 LIMIT 3)"""
O["sample_points"] = sql(["places"], """SELECT id, lon, lat FROM places
WHERE ('0x' || left(md5(CAST(id AS VARCHAR)), 8))::BIGINT < 1073741824""")
