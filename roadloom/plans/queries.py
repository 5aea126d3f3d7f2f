"""One query per operator, over the whole tables.

Every function takes (spark, sf_dir).  Lengths are rounded to 6 decimals at the
very end, only to make them comparable between engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadloom.constants import MAP_CLASSES, PLACE_LEAVES, VIEWPORT_PAD_DEG
from roadloom.functions import geo, geo_arrow, text
from roadloom.functions.dates import release_date
from roadloom.operators import (
    admission, audit, cells, compare, diff, estimate, explore, logs, profile, proximity, scoring, series, skew, stats,
)
from roadloom.operators.query import read_only
from roadloom.plans import derived as d
from roadloom.session import scratch_path
from roadloom.sources import delimited, extracts, footers, geojson, records, releases, rewrite
from roadloom.streaming import admission as stream_admission
from roadloom.streaming import monitor

ROEMER = (8.6821, 50.1106)
FRANKFURT_NORTH = (8.55, 50.10, 8.80, 50.23)
ESTIMATE_AREA = (8.47, 50.02, 10.80, 51.23)
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c) if c in columns else F.col(c) for c in df.columns])


def release_stats_table(spark, sf) -> DataFrame:
    return stats.release_stats(d.release_roads(spark, sf), d.state_edges(spark, sf))


def inside_stats(spark, sf) -> DataFrame:
    return stats.inside_only(release_stats_table(spark, sf))


def weekly_table(spark, sf) -> DataFrame:
    return series.weekly_series(inside_stats(spark, sf), d.rules(spark))


# ---------------------------------------------------------------- regions and statistics

@query
def release_stats(spark, sf):
    return stats.in_report_order(release_stats_table(spark, sf))


@query
def cell_states(spark, sf):
    return cells.cell_regions(d.release_roads(spark, sf), d.state_edges(spark, sf))


@query
def segment_states(spark, sf):
    roads = d.release_roads(spark, sf).select("release", "id", "cx", "cy")
    return cells.attach_regions(roads, d.state_edges(spark, sf)).select(
        "release", "id", cells.region_or_outside().alias("state"))


@query
def states_distinct(spark, sf):
    return release_stats_table(spark, sf).agg(F.count_distinct("state").alias("states"),
                                              F.count_distinct("state", "class").alias("state_classes"))


@query
def national_km(spark, sf):
    return rounded(stats.national_km(release_stats_table(spark, sf)), "km")


@query
def headline(spark, sf):
    return rounded(stats.headline(inside_stats(spark, sf)), "total_km", "pct_named")


@query
def state_ranking(spark, sf):
    return rounded(stats.ranking(inside_stats(spark, sf)), "length_km")


# ---------------------------------------------------------------- comparing releases

def _comparison(spark, sf, dimension):
    return compare.compare_releases(inside_stats(spark, sf), d.RELEASE_A, d.RELEASE_B, dimension)


_COMPARED = ["length_km_a", "length_km_b", "delta_km", "pct_change"]


@query
def compare_state(spark, sf):
    return rounded(_comparison(spark, sf, "state"), *_COMPARED)


@query
def compare_class(spark, sf):
    return rounded(_comparison(spark, sf, "class"), *_COMPARED)


@query
def gain_loss(spark, sf):
    return rounded(compare.gain_loss(_comparison(spark, sf, "state")), "net_km", "gained_km", "lost_km")


@query
def top_delta(spark, sf):
    return rounded(compare.top_deltas(_comparison(spark, sf, "state")), *_COMPARED)


@query
def release_dates(spark, sf):
    found = d.monthly_stats(spark, sf).select("release").distinct()
    return found.select("release", release_date("release").alias("release_date"))


@query
def scope_groups(spark, sf):
    return compare.scope_groups(d.every_scope(spark, sf))


@query
def comparable_pairs(spark, sf):
    return compare.comparable_pairs(d.every_scope(spark, sf))


@query
def scope_groups_every_month(spark, sf):
    return compare.scope_groups(d.every_scope(spark, sf))


@query
def comparable_pairs_every_month(spark, sf):
    return compare.comparable_pairs(d.every_scope(spark, sf))


@query
def comparability(spark, sf):
    found = d.monthly_stats(spark, sf).select("release").distinct()
    out = compare.comparability(found, d.monthly_scopes(spark, sf), "1998-03-15.0")
    kind = (F.when(F.col("comparable"), "").otherwise(F.regexp_extract("reason", "^[A-Z][a-z]+ [a-z]+( [a-z]+)?", 0)))
    return out.select("release", "comparable", kind.alias("reason_kind"))


@query
def classes_covered(spark, sf):
    out = stats.classes_covered(d.monthly_stats(spark, sf), d.monthly_scopes(spark, sf))
    return out.select("release", F.array_join("classes", ",").alias("classes"), "full_drivable")


@query
def scope_attach(spark, sf):
    out = releases.with_scopes(d.monthly_stats(spark, sf), d.monthly_scopes(spark, sf))
    return out.select("release", "release_date", F.try_element_at("bbox", F.lit(1)).alias("xmin"),
                      F.array_join("classes", ",").alias("classes"))


@query
def headline_delta(spark, sf):
    out = stats.headline_delta(d.monthly_stats(spark, sf), d.monthly_scopes(spark, sf))
    return rounded(out, "total_km", "pct_named", "previous_km", "delta_km", "delta_pct")


@query
def latest_release(spark, sf):
    return rounded(releases.latest(d.monthly_stats(spark, sf)), "length_km", "pct_named")


# ---------------------------------------------------------------- feature differences

@query
def churn(spark, sf):
    return rounded(diff.churn(*d.release_pair(spark, sf)), "added_km", "removed_km", "net_km")


@query
def length_changes(spark, sf):
    return rounded(diff.length_changes(*d.release_pair(spark, sf)), "km_a", "km_b", "delta_km")


@query
def added_features(spark, sf):
    return rounded(diff.added_features(*d.release_pair(spark, sf)), "length_km")


@query
def removed_features(spark, sf):
    return rounded(diff.removed_features(*d.release_pair(spark, sf)), "length_km")


@query
def kept_features(spark, sf):
    return rounded(diff.kept_features(*d.release_pair(spark, sf)), "length_km")


@query
def id_sets(spark, sf):
    return diff.id_sets(*d.release_pair(spark, sf))


@query
def one_per_id(spark, sf):
    lines = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", "l_quantity")
    return diff.one_per_id(lines)


@query
def path_parts(spark, sf):
    rows = diff.path_rows(d.roads(spark, sf).select("id", "class", "parts"))
    return rows.select("id", "class", "path_no", F.size("path").alias("vertices"), r6(geo.path_km("path"), "path_km"))


# ---------------------------------------------------------------- weekly series

@query
def weekly_series(spark, sf):
    return rounded(series.in_series_order(weekly_table(spark, sf)), "length_km", "pct_named")


@query
def weekly_series_plain(spark, sf):
    return rounded(series.weekly_series(inside_stats(spark, sf), None, 2, 6), "length_km", "pct_named")


@query
def weekly_totals(spark, sf):
    return rounded(series.weekly_totals(weekly_table(spark, sf)), "length_km", "pct_named")


@query
def weekly_by_state(spark, sf):
    return rounded(series.weekly_totals(weekly_table(spark, sf), ["state"]), "length_km", "pct_named")


@query
def weekly_by_class(spark, sf):
    return rounded(series.weekly_totals(weekly_table(spark, sf), ["class"]), "length_km", "pct_named")


@query
def measured_only(spark, sf):
    out = series.measured_only(series.weekly_totals(weekly_table(spark, sf)))
    return rounded(out, "length_km", "pct_named")


@query
def class_index(spark, sf):
    return rounded(series.class_index(weekly_table(spark, sf)), "length_km", "pct_vs_first")


def _drops(spark, sf):
    totals = series.weekly_totals(weekly_table(spark, sf), ["state"])
    return series.with_cause(series.drops(totals, -0.5, ["state"]), d.rules(spark))


@query
def wow_drops(spark, sf):
    return rounded(_drops(spark, sf).select("week", "state", "length_km", "prev_km", "wow_pct", "cause"),
                   "length_km", "prev_km", "wow_pct")


@query
def worst_week(spark, sf):
    out = series.worst_week(_drops(spark, sf)).select("week", "state", "wow_pct", "cause")
    return rounded(out, "wow_pct")


@query
def drops_overall(spark, sf):
    """Weeks in which the whole network grew by less than 0.55 %."""
    totals = series.weekly_totals(weekly_table(spark, sf))
    out = series.with_cause(series.drops(totals, 0.55), d.rules(spark))
    return rounded(out.select("week", "length_km", "prev_km", "wow_pct", "cause"), "length_km", "prev_km", "wow_pct")


# ---------------------------------------------------------------- places

@query
def area_filter(spark, sf):
    return proximity.in_area(d.places(spark, sf), FRANKFURT_NORTH, "lon", "lat")


@query
def within_radius(spark, sf):
    near = proximity.within_radius(d.places(spark, sf), *ROEMER, 3000)
    return near.select("id", "category", r6(geo.distance_m("lon", "lat", *ROEMER), "distance_m"))


@query
def radius_count(spark, sf):
    near = proximity.within_radius(d.places(spark, sf).where("category = 'building'"), *ROEMER, 3000)
    return near.agg(F.count(F.lit(1)).alias("n"))


@query
def distance_join(spark, sf):
    pairs = proximity.distance_join(d.places(spark, sf), d.landmarks(spark), 2500)
    return pairs.select("id", "landmark", r6("distance_m"))


@query
def places_near_sites(spark, sf):
    places = d.places(spark, sf).select("id", "lon", "lat", "operating_status")
    pairs = proximity.distance_join(places, d.supplier_sites(spark, sf), 1000, count_where=F.col("operating_status") == "open")
    return proximity.count_near(pairs)


@query
def simple_totals(spark, sf):
    return rounded(stats.named_total(
        d.places(spark, sf), (F.col("category") == "building") | F.col("name").ilike("%7%"),
        n=F.count(F.lit(1)), average=F.avg("confidence"), low=F.min("confidence"), high=F.max("confidence")),
        "average", "low", "high")


@query
def road_km_by_class(spark, sf):
    out = explore.top_groups(d.road_lengths(spark, sf), "class", 1, F.sum("length_km"), "km")
    return rounded(out, "km")


@query
def breakdown_roads(spark, sf):
    out = explore.breakdown(d.road_lengths(spark, sf), "roads", F.sum("length_km"), "km", F.col("status") != "F")
    return rounded(out, "km")


@query
def breakdown_places(spark, sf):
    return explore.breakdown(d.places(spark, sf), "places", F.count(F.lit(1)), "count",
                             F.col("operating_status") == "permanently_closed")


@query
def top_categories(spark, sf):
    return explore.top_groups(d.places(spark, sf), "category", 3)


@query
def distinct_names(spark, sf):
    return explore.distinct_names(d.roads(spark, sf), F.col("class") == "motorway")


@query
def matching_values(spark, sf):
    return explore.matching_values(d.places(spark, sf), "category", "%U%")


@query
def highlight(spark, sf):
    return explore.highlight(d.places(spark, sf), "places", "category", "machinery").select(
        "id", "category", "lon", "lat")


@query
def map_projection(spark, sf):
    boxed = (d.places(spark, sf).select("id", "lon", "lat", "category")
             .withColumn("geom_type", F.lit("Point")).withColumn("bbox_min_lon", F.col("lon"))
             .withColumn("geometry_geojson", geo.point_geojson("lon", "lat")))
    return explore.map_frame(boxed, points=True)


@query
def chart_frame(spark, sf):
    counts = d.places(spark, sf).groupBy("locality").agg(F.count(F.lit(1)).alias("n"))
    return explore.chart_frame(counts)


@query
def viewport(spark, sf):
    near = proximity.within_radius(d.places(spark, sf), *ROEMER, 3000)
    return rounded(proximity.viewport(near, VIEWPORT_PAD_DEG), "west", "south", "east", "north")


# ---------------------------------------------------------------- profiles

@query
def column_profile(spark, sf):
    return profile.column_profile(d.places(spark, sf)).select("column_name", "non_null", "null_pct", "unique_values")


@query
def numeric_summary(spark, sf):
    lines = d.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_partkey")
    return rounded(profile.numeric_summary(lines), "mean", "std", "min", "q1", "median", "q3", "max")


@query
def group_quantiles(spark, sf):
    lines = d.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(skew.quantiles(lines, ["l_returnflag"], "l_extendedprice", [0.0, 0.1, 0.5, 0.99, 1.0]), "quantile")


@query
def line_summary(spark, sf):
    return rounded(profile.line_summary(d.road_lengths(spark, sf)), "total_length_km", "mean_segment_m")


@query
def table_points(spark, sf):
    named = d.places(spark, sf).withColumnRenamed("lon", "Longitude").withColumnRenamed("lat", "Y")
    return profile.points(named)


# ---------------------------------------------------------------- geometry

@query
def path_length(spark, sf):
    return d.roads(spark, sf).select("id", r6(geo.parts_km("parts"), "length_km"))


@query
def centroid(spark, sf):
    rows = cells.with_cell(d.roads(spark, sf))
    x, y = geo.line_centroid_xy("parts")
    return rows.select("id", r6(x, "x"), r6(y, "y"), "cx", "cy")


@query
def rep_point(spark, sf):
    vertices = F.flatten("parts")
    spot, box = geo.mean_vertex(vertices), geo.envelope(vertices)
    return d.roads(spark, sf).select("id", r6(spot["x"], "lon"), r6(spot["y"], "lat"),
                                     *[r6(c, n) for n, c in box.items()])


@query
def polygon_area(spark, sf):
    text_ = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.transform(
        "rings", lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))).alias("coordinates")))
    rows = d.state_rings(spark, sf).withColumn("geometry", text_)
    return rows.select("state", r6(geo.polygon_area(geo.geojson_rings("geometry")), "area"))


@query
def point_in_polygon(spark, sf):
    """Suppliers spread over the tiling, each tested against its nation's polygon."""
    s = F.col("s_suppkey")
    sites = d.table(spark, sf, "supplier").select(
        "s_suppkey", "s_nationkey", (F.lit(6.0) + (s * 7919 % 8600) / F.lit(1e3)).alias("x"),
        (F.lit(47.5) + (s * 104729 % 6600) / F.lit(1e3)).alias("y"))
    nations = d.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("state"))
    rows = (sites.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(d.state_rings(spark, sf), "state"))
    return rows.select("s_suppkey", "state", geo.within_rings("x", "y", "rings").alias("inside"))


def _feature_lines(spark, sf, with_id: bool = False) -> DataFrame:
    """Feature lines as an extract file holds them, from every road."""
    rows = d.road_lengths(spark, sf)
    props = F.struct("class", F.col("name"), F.round("length_km", 4).alias("length_km"),
                     F.when(F.col("name").isNull(), F.lit(False)).alias("is_named"),
                     F.struct(F.col("status").alias("code")).alias("tags"))
    line = F.concat(F.lit(',{"type":"Feature","id":"'), F.col("id").cast("string"), F.lit('","properties":'),
                    F.to_json(props), F.lit(',"geometry":'), geo.parts_geojson("parts"), F.lit("}"))
    return rows.select(line.alias("value"), "id") if with_id else rows.select(line.alias("value"))


@query
def geojson_features(spark, sf):
    flat = geojson.flatten_features(geojson.parse_features(_feature_lines(spark, sf)))
    flat = flat.withColumn("code", F.get_json_object("tags", "$.code")).drop("geometry_geojson", "tags")
    return rounded(flat,
                   "length_km", "geom_length_km", "lon", "lat", "bbox_min_lon", "bbox_min_lat",
                   "bbox_max_lon", "bbox_max_lat")


@query
def geojson_mixed_files(spark, sf):
    """Roads in line files, indented documents and documents without line breaks, some 20,000 ids to a document, in one folder; documents are
    cut into features by several tasks each."""
    path = scratch_path(spark, "mixed-geojson")
    # The number of a document comes from the key alone: a condition on it moves before the rows are spread, and the lines stay behind.
    rows = _feature_lines(spark, sf, with_id=True).select(F.substring("value", 2, 1 << 30).alias("value"), (F.col("id") / 20000).cast("long").alias("doc"))
    rows.where("doc % 3 = 0").repartition("doc").write.partitionBy("doc").text(path)
    features = F.sort_array(F.collect_list("value"))
    indented = F.concat(F.lit('{\n "type": "FeatureCollection",\n "features": [\n'),
                        F.array_join(F.transform(features, lambda f: F.replace(f, F.lit('":{"'), F.lit('": {\n   "'))), ",\n  "), F.lit('\n ],\n "made": {"by": "{["}\n}'))
    tight = F.concat(F.lit('{"made":{"by":"]}"},"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))
    docs = rows.where("doc % 3 <> 0").groupBy("doc").agg(F.when(F.col("doc") % 3 == 1, indented).otherwise(tight).alias("value"))
    docs.write.partitionBy("doc").mode("append").text(path)
    many = spark.newSession()
    many.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        many.conf.set(name, spark.conf.get(name))
    flat = geojson.read_geojson(many, path)
    return rounded(flat.select("feature_id", "class", "name", "is_named", "geom_type", "length_km", "geom_length_km"), "length_km", "geom_length_km")


@query
def geom_types(spark, sf):
    flat = geojson.parse_features(_feature_lines(spark, sf))
    return profile.geometry_types(flat.select(geo.parse_geometry("geometry")["type"].alias("geom_type")))


@query
def table_envelope(spark, sf):
    features = geojson.parse_features(_feature_lines(spark, sf))
    box = geo.envelope(geo.geojson_vertices("geometry"))
    return rounded(profile.table_envelope(features.select(*[c.alias(n) for n, c in box.items()])),
                   "min_lon", "min_lat", "max_lon", "max_lat")


@query
def default_restore(spark, sf):
    features = geojson.parse_features(_feature_lines(spark, sf))
    flat = geojson.flatten_features(features, {"class": ("class", "string"), "is_named": ("is_named", "boolean")})
    return flat.groupBy("class", "is_named").agg(F.count(F.lit(1)).alias("n"))


def _each_vertex(geometry):
    return _each_spot(geo.geojson_vertices(geometry))


def _each_spot(spots):
    """Sums to which every vertex adds its coordinates times its place, so that none can be lost, moved or swapped unseen."""
    placed = F.transform(spots, lambda v, i: F.struct((v["x"] * (i + 1)).alias("x"), (v["y"] * (i + 1)).alias("y")))
    total = lambda c: F.aggregate(F.transform(placed, lambda v: v[c]), F.lit(0.0), lambda t, v: t + v)
    return [r6(total(c), f"placed_{c}") for c in "xy"]


@query
def wkb_roundtrip(spark, sf):
    rows = d.roads(spark, sf).select("id", geo.parts_geojson("parts").alias("g"))
    binary = geo.computed(rows, w=geo_arrow.geojson_to_wkb("g"))
    back = geo.computed(binary, back=geo_arrow.wkb_to_geojson("w"))
    return back.select("id", F.octet_length("w").alias("wkb_bytes"), r6(geo.geojson_km("back"), "length_km"), *_each_vertex("back"))


@query
def simplify(spark, sf):
    rows = d.roads(spark, sf).select("id", geo.parts_geojson("parts").alias("g"))
    slim = rows.select("id", geo_arrow.simplify("g", 0.005).alias("g"))
    return slim.select("id", F.size(geo.geojson_vertices("g")).alias("vertices"), *_each_vertex("g"))


@query
def simplify_paths(spark, sf):
    """The same thinning on arrays of vertices, without a text in between."""
    slim = d.roads(spark, sf).select("id", F.flatten(geo_arrow.simplify_parts("parts", 0.005)).alias("spots"))
    return slim.select("id", F.size("spots").alias("vertices"), *_each_spot(F.col("spots")))


@query
def spheroid_length(spark, sf):
    return d.roads(spark, sf).select("id", F.round(geo_arrow.spheroid_length_m("parts"), 3).alias("metres"))


@query
def slim_features(spark, sf):
    """Map features of every road in a state, read back from their text."""
    roads = cells.with_cell(d.road_lengths(spark, sf))
    placed = cells.attach_regions(
        roads.where(F.col("class").isin(MAP_CLASSES)).select(
            "id", "class", "name", F.col("name").isNotNull().alias("is_named"), "length_km", "cx", "cy",
            geo.parts_geojson("parts").alias("geometry")),
        d.state_edges(spark, sf), keep_outside=False)
    lines = geojson.road_lines(placed)
    fields = rewrite.road_fields(geojson.parse_features(lines))
    return fields.select("id", "class", "state", "name", "is_named", r6("length_km"),
                         r6(geo.geojson_km("geometry"), "map_km"))


@query
def slim_places(spark, sf):
    lines = geojson.place_lines(d.places(spark, sf).withColumn("basic_category", F.lit(None).cast("string")))
    features = geojson.parse_features(lines)
    p = F.col("properties")
    spot = F.try_element_at(geo.geojson_vertices("geometry"), F.lit(1))
    return features.select(F.col("feature_id").alias("id"), p["category"].alias("category"),
                           p["operating_status"].alias("operating_status"),
                           F.map_contains_key("properties", "basic_category").alias("has_basic"),
                           F.round(spot["x"], 5).alias("lon"), F.round(spot["y"], 5).alias("lat"))


@query
def sample_points(spark, sf):
    return profile.sample_points(d.places(spark, sf).select("id", "lon", "lat"), "id", share=0.25)


@query
def exact_sample(spark, sf):
    """Exactly 500 places (all, if there are fewer)."""
    return profile.exact_sample(d.places(spark, sf).select("id", "lon", "lat"), "id", 500)


@query
def sample_rows(spark, sf):
    """Three rows of each table."""
    tables = {"places": d.places(spark, sf), "roads": d.roads(spark, sf), "sites": d.supplier_sites(spark, sf).withColumnRenamed("landmark", "id")}
    shown = [profile.sample_rows(df, "id").select(F.lit(name).alias("table_name"), F.col("id").cast("long").alias("id")) for name, df in tables.items()]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


# ---------------------------------------------------------------- text, answers, logs, statements

@query
def number_readings(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", text.number_readings("text").alias("v"))
    return docs.select("doc_id", F.size("v").alias("readings"), F.array_max("v").alias("largest"),
                       F.array_min("v").alias("smallest"))


@query
def normalized_text(spark, sf):
    turns = d.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", "role", F.length(text.normalized("text")).alias("length"),
                        text.contains_any(F.lower("text"), ["que", "the", "nicht"]).alias("hit"))


def _scored(spark, sf):
    return scoring.score_answers(d.answers(spark, sf))


@query
def score_answers(spark, sf):
    return _scored(spark, sf).select("id", "model", "check", "passed", "tool_ok", "detail")


@query
def eval_summary(spark, sf):
    return rounded(scoring.eval_summary(_scored(spark, sf)), "median_seconds")


@query
def eval_failures(spark, sf):
    return scoring.failures(_scored(spark, sf))


@query
def latest_run(spark, sf):
    """Runs named by day and model; the oldest ones carry no model of their own."""
    rows = d.answers(spark, sf)
    name = F.concat(F.lit("/runs/"), F.col("day").cast("string"), F.lit("_"), text.result_name("model"), F.lit(".jsonl"))
    old = F.col("day") < F.lit("1996-01-01").cast("date")
    files = rows.select("id", "seconds", name.alias("file_name"), F.when(~old, F.col("model")).alias("model"))
    return scoring.latest_runs(scoring.with_run(files)).select("model", "run_date", "id")


@query
def log_summary(spark, sf):
    return logs.log_summary(logs.flatten_turns(d.turns(spark, sf)))


@query
def turn_windows(spark, sf):
    turns = d.turns(spark, sf).withColumn("ts", F.to_timestamp("ts"))
    out = monitor.turn_windows(turns, "6 hours")
    return rounded(_naive(out, "window_start", "window_end"), "mean_seconds")


def _naive(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query
def sql_audit(spark, sf):
    return audit.audit_statements(d.statements(spark, sf)).select("event_id", "allowed", "reason")


@query
def audit_documents(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", F.col("text").alias("sql"))
    return audit.audit_statements(docs).groupBy("allowed", "reason").agg(F.count(F.lit(1)).alias("n"))


def _views(spark, sf):
    d.places(spark, sf).createOrReplaceTempView("places")
    d.road_lengths(spark, sf).select("id", "class", "name", "length_km").createOrReplaceTempView("roads")


@query
def ad_hoc_query(spark, sf):
    """A statement as users type it: CTE, lateral join, ILIKE, cast, grouping."""
    _views(spark, sf)
    return read_only(spark, """
        WITH open_places AS (SELECT * FROM places WHERE operating_status = 'open' AND category ILIKE '%u%')
        SELECT p.category, count(*) AS n, CAST(round(sum(x.km), 6) AS DOUBLE) AS km
        FROM open_places p JOIN LATERAL (SELECT r.length_km AS km FROM roads r WHERE r.id = p.id) x
        GROUP BY p.category ORDER BY n DESC -- largest first;
    """)


@query
def summarize_table(spark, sf):
    _views(spark, sf)
    out = read_only(spark, "SUMMARIZE places").where(F.col("mean").isNotNull())
    return rounded(out.select("column_name", "non_null", "unique_values", "mean", "std", "median"), "mean", "std", "median")


@query
def expected_answers(spark, sf):
    """Reference statements evaluated on the tables, as the scorer needs them."""
    _views(spark, sf)
    questions = [
        {"id": "en04", "lang": "en", "check": "number",
         "reference_sql": "SELECT count(*) FROM places WHERE operating_status = 'permanently_closed'"},
        {"id": "en06", "lang": "en", "check": "set", "reference_sql": "SELECT category FROM places "
         "WHERE category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3"},
        {"id": "de05", "lang": "de", "check": "number",
         "reference_sql": "SELECT count(*) FROM roads WHERE class = 'primary'", "rel_tol": 0.01},
        {"id": "de09", "lang": "de", "check": "refusal"},
    ]
    out = scoring.expected_values(spark, questions)
    return out.withColumn("expected", F.array_join(F.array_sort("expected"), ","))


# ---------------------------------------------------------------- footers

@query
def row_groups_kept(spark, sf):
    return estimate.row_groups(d.footers(spark, sf), ESTIMATE_AREA)


@query
def estimate_bytes(spark, sf):
    return estimate.estimate(d.footers(spark, sf), ESTIMATE_AREA)


@query
def estimate_by_file(spark, sf):
    return estimate.estimate(d.footers(spark, sf), ESTIMATE_AREA, PLACE_LEAVES, by=["file_name"])


@query
def kept_footers(spark, sf):
    return estimate.kept_footers(d.footers(spark, sf), ESTIMATE_AREA).select(
        "file_name", "row_group_id", "path_in_schema", "total_compressed_size")


@query
def estimate_boundaries(spark, sf):
    return estimate.estimate_boundaries(d.boundary_footers(spark, sf), "Customer#000000150")


@query
def footer_scan(spark, sf):
    rows = footers.scan_footers(spark, sf)
    return rows.withColumn("file_name", F.regexp_extract("file_name", "([^/]+)$", 1)).drop("text_min", "text_max")


# ---------------------------------------------------------------- admission

@query
def admission_window(spark, sf):
    """At most 2 admitted events per user and day."""
    return admission.admit(d.table(spark, sf, "events"), "user_id", "ts", "event_id", 2, 86_400)


@query
def admission_single(spark, sf):
    """One admitted event per user and six hours: chunks of a day as maps, composed by doubling."""
    return admission.admit(d.table(spark, sf, "events"), "user_id", "ts", "event_id", 1, 21_600, chunk_s=86_400)


@query
def admission_capped(spark, sf):
    return admission.admit(d.table(spark, sf, "events"), "user_id", "ts", "event_id", 1, 21_600, daily_cap=100)


# ---------------------------------------------------------------- files written and read back

@query
def csv_read(spark, sf):
    """Orders through a semicolon-separated file of unknown types."""
    path = scratch_path(spark, "orders-csv")
    rows = d.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order key!"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_totalprice").alias("price"), F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("comma"),
        F.when(F.col("o_orderstatus") == "F", "N/A").otherwise(F.col("o_orderstatus")).alias("status"),
        (F.col("o_orderkey") % 2 == 0).alias("even"))
    rows.write.option("header", True).option("sep", ";").csv(path)
    return delimited.read_csv(spark, path)


@query
def csv_quoted_split(spark, sf):
    """Notes with line breaks, quotes and separators in quoted fields, read back by many more tasks than there are files."""
    path = scratch_path(spark, "notes-csv")
    k = F.col("o_orderkey")
    note = (F.when(k % 5 == 0, F.concat(F.lit('first\nsecond "'), k.cast("string"), F.lit('";\n\nlast')))
            .when(k % 5 == 1, F.repeat(F.lit("long;\n"), (k % 40).cast("int") + 1)).when(k % 5 == 2, F.lit('"')).otherwise(F.lit("plain")))
    rows = d.table(spark, sf, "orders").select(k.alias("order_key"), note.alias("note"), F.col("o_totalprice").alias("price"))
    rows.write.options(header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    many = spark.newSession()
    many.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        many.conf.set(name, spark.conf.get(name))
    found = delimited.read_csv(many, path)
    return found.select("order_key", F.length("note").alias("note_chars"), F.sha2("note", 256).alias("note_sha256"), "price")


@query
def stats_files(spark, sf):
    """Statistics written per release, loaded as one table."""
    folder = scratch_path(spark, "stats")
    table = release_stats_table(spark, sf).persist()
    for release in (d.RELEASE_A, d.RELEASE_B):
        releases.write_stats(table.where(F.col("release") == release), f"{folder}/stats_{release}.csv")
    table.unpersist()
    return releases.load_stats(spark, folder)


def _scope_files(spark, scopes):
    folder = scratch_path(spark, "scopes")
    releases.write_scopes(scopes, folder)
    back = releases.load_scopes(spark, f"{folder}/scopes")
    return back.select("release", F.array_join("classes", ",").alias("classes"),
                       F.try_element_at("bbox", F.lit(3)).alias("xmax"))


@query
def scope_files(spark, sf):
    return _scope_files(spark, d.every_scope(spark, sf))


@query
def scope_files_every_month(spark, sf):
    return _scope_files(spark, d.every_scope(spark, sf))


@query
def feature_files(spark, sf):
    """Every road written as compressed features and read back."""
    path = scratch_path(spark, "features")
    geojson.write_features(_feature_lines(spark, sf), path)
    flat = geojson.read_geojson(spark, path)
    return rounded(flat.select("feature_id", "class", "name", "is_named", "geom_type", "length_km", "geom_length_km"),
                   "length_km", "geom_length_km")


@query
def verified_rewrite(spark, sf):
    source, target = scratch_path(spark, "legacy"), scratch_path(spark, "slim")
    geojson.write_features(_feature_lines(spark, sf), source)
    return rounded(rewrite.compact(spark, source, target).select("features", "different_ids", "km_before", "ok"),
                   "km_before")


@query
def boundary_cache(spark, sf):
    rings = F.transform("rings", lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))
    g = F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    box = geo.envelope(geo.geojson_vertices("geometry"))
    states = d.state_rings(spark, sf).select("state", g.alias("geometry")).select(
        "state", "geometry", box["bbox_min_lon"].alias("xmin"), box["bbox_max_lon"].alias("xmax"),
        box["bbox_min_lat"].alias("ymin"), box["bbox_max_lat"].alias("ymax"))
    path = scratch_path(spark, "boundaries")
    extracts.write_boundaries(states, path)
    edges = extracts.boundary_edges(extracts.read_boundaries(spark, path))
    return rounded(edges, "x1", "y1", "x2", "y2")


@query
def boundary_scan(spark, sf):
    """Regions of one country from boundary files in the nested layout, geometry in WKB."""
    rings = F.transform("rings", lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"])))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates")))
    number = F.regexp_extract("state", "([0-9]+)", 1).cast("int")
    path = scratch_path(spark, "divisions")
    d.state_rings(spark, sf).select(
        F.when(number % 4 == 3, "AT").otherwise("DE").alias("country"), F.when(number % 5 == 4, "county").otherwise("region").alias("subtype"),
        F.struct(F.col("state").alias("primary")).alias("names"), geo_arrow.geojson_to_wkb(shape).alias("geometry")).write.parquet(path)
    found = extracts.scan_boundaries(spark, path)
    area = r6(geo.polygon_area(geo.geojson_rings("geometry")), "area")
    return found.select("state", area, *[r6(c) for c in ("xmin", "xmax", "ymin", "ymax")])


@query
def extract_scan(spark, sf):
    """Segments in the nested release layout, scanned by class and area."""
    first, names = F.flatten("parts")[0], F.struct(F.col("name").alias("primary"))
    path = scratch_path(spark, "segments")
    (d.roads(spark, sf).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("status") == "F", "rail").otherwise("road").alias("subtype"),
        "class", names.alias("names"), F.struct(first["x"].alias("xmin"), first["y"].alias("ymin")).alias("bbox"),
        geo_arrow.geojson_to_wkb(geo.parts_geojson("parts")).alias("geometry")).write.parquet(path))
    rows = extracts.scan_segments(spark, path, (7.0, 48.0, 12.5, 53.25), ["motorway", "primary"])
    out = extracts.derive_segments(rows, d.RELEASE_A)
    return rounded(out.select("class", "is_named", "length_km", "cx", "cy", "map_id", "map_name"), "length_km")


@query
def extract_places(spark, sf):
    path = scratch_path(spark, "places")
    (d.places(spark, sf).select(
        F.col("id").cast("string").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"),
        F.struct(F.col("category").alias("primary")).alias("taxonomy"), F.lit("poi").alias("basic_category"),
        "confidence", "operating_status", F.when(F.col("operating_status") == "open", F.array(F.struct("locality")))
        .otherwise(F.array().cast("array<struct<locality:string>>")).alias("addresses"),
        F.struct(F.col("lon").alias("xmin"), F.col("lat").alias("ymin")).alias("bbox"),
        geo_arrow.geojson_to_wkb(geo.point_geojson("lon", "lat")).alias("geometry")).write.parquet(path))
    return rounded(extracts.scan_places(spark, path, FRANKFURT_NORTH), "confidence", "lon", "lat")


@query
def turn_log_files(spark, sf):
    path = scratch_path(spark, "turns")
    records.append_turns(d.turns(spark, sf), path)
    return (logs.flatten_turns(records.read_turns(spark, path)).groupBy("model")
            .agg(F.count(F.lit(1)).alias("turns"), F.sum("queries").alias("queries"),
                 F.sum("failed_queries").alias("failed_queries")))


@query
def run_files(spark, sf):
    folder = scratch_path(spark, "runs")
    rows = _scored(spark, sf).select("model", F.col("id").cast("string").alias("id"), "lang", "check", "passed", "seconds")
    records.write_run(rows, folder, "2026-10-09")
    back = spark.read.json(f"{folder}/full")
    return back.groupBy("model", F.col("run_date").cast("string").alias("run_date"), "model_name").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if("passed").alias("passed"))


# ---------------------------------------------------------------- streams

def _drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over everything that is there and read what it wrote."""
    run = (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-progress")
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query
def turn_stream(spark, sf):
    """The turn log as a stream; the last windows stay open behind the watermark."""
    path = scratch_path(spark, "turn-log")
    records.append_turns(d.turns(spark, sf), path)
    out = _drain(monitor.turn_windows(monitor.read_turn_stream(spark, path), "6 hours"), scratch_path(spark, "windows"))
    return rounded(_naive(out, "window_start", "window_end"), "mean_seconds")


def _in_turn(events: DataFrame, path: str, stretches: int = 3) -> None:
    """Events as files, the older ones first."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    step = (last - first) / stretches
    for i in range(stretches):
        later = (F.col("ts") >= first + i * step) if i else F.lit(True)
        earlier = (F.col("ts") < first + (i + 1) * step) if i + 1 < stretches else F.lit(True)
        events.where(later & earlier).write.mode("append").parquet(path)


@query
def admission_stream_capped(spark, sf):
    """The daily cap over several micro-batches, in which a day may end in the middle."""
    path = scratch_path(spark, "visits")
    events = d.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
    _in_turn(events, path)
    rule = stream_admission.SettledAdmission(scratch_path(spark, "settled"), "user_id", "ts", "event_id", 1, 21_600, 100, 3_600)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    rule.writer(stream).trigger(availableNow=True).start().awaitTermination()
    return rule.close(events)


@query
def admission_stream(spark, sf):
    stream_admission.use_rocksdb(spark)
    path = scratch_path(spark, "visits")
    rows = d.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id")
    _in_turn(rows, path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)
    return _drain(stream_admission.admit_stream(stream, "user_id", "ts", "event_id", 2, 86_400),
                  scratch_path(spark, "verdicts"))
