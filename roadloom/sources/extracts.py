"""Release extracts in Parquet: segments, places, boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.constants import CLASSIFIED, MAP_CLASSES, SIMPLIFY_DEG
from roadloom.functions import geo, geo_arrow
from roadloom.operators.cells import with_cell
from roadloom.operators.proximity import in_area


def scan_segments(spark: SparkSession, path: str, area, classes=CLASSIFIED) -> DataFrame:
    """Road segments of the wanted classes whose lower-left corner is in the area.

    Plain comparisons on leaf fields: they reach the Parquet reader, and only
    the five leaves and the geometry are read.
    """
    rows = spark.read.parquet(path).where((F.col("subtype") == "road") & F.col("class").isin(list(classes)))
    return in_area(rows, area).select("id", "class", F.col("names.primary").alias("name"), "geometry")


def derive_segments(segments: DataFrame, release: str, map_classes=MAP_CLASSES,
                    ellipsoidal: bool = True) -> DataFrame:
    """One row per segment with length, cell and, for map classes, the map fields.

    ``geometry`` is WKB; vertices and length come from one pass over each batch, and only the
    map classes get a text.  Persist the result when both the
    statistics and the map are written from it, so that the release is scanned
    once.
    """
    on_map = F.col("class").isin(list(map_classes))
    if dict(segments.dtypes)["geometry"] == "binary":
        rows = segments.withColumn("line", geo_arrow.decoded_lines("geometry", ellipsoidal)).select("*", "line.parts", "line.metres")
        rows = rows.withColumn("geometry", geo_arrow.wkb_to_geojson(F.when(on_map, F.col("geometry"))))
    else:
        rows = segments.withColumn("parts", geo.geojson_parts("geometry"))
        rows = rows.withColumn("metres", geo_arrow.spheroid_length_m("parts")) if ellipsoidal else rows
    km = F.col("metres") / 1000 if ellipsoidal else geo.parts_km("parts")
    return with_cell(rows).select(
        F.lit(release).alias("release"), "class", F.col("name").isNotNull().alias("is_named"),
        km.alias("length_km"), "cx", "cy",
        F.when(on_map, F.col("id")).alias("map_id"),
        F.when(on_map, F.col("name")).alias("map_name"),
        F.when(on_map, F.col("geometry")).alias("map_geometry"))


def map_geometry(derived: DataFrame, tolerance: float = SIMPLIFY_DEG) -> DataFrame:
    """Rows for the map sink, with thinned geometry."""
    rows = derived.where(F.col("map_id").isNotNull())
    return rows.withColumn("map_geometry", geo_arrow.simplify("map_geometry", tolerance))


def scan_places(spark: SparkSession, path: str, area) -> DataFrame:
    """Places inside the area, nested fields flattened."""
    rows = in_area(spark.read.parquet(path), area)
    is_wkb = dict(rows.dtypes)["geometry"] == "binary"
    spot = geo_arrow.first_vertex("geometry") if is_wkb else F.try_element_at(geo.geojson_vertices("geometry"), F.lit(1))
    rows = rows.withColumn("spot", spot)
    spot = F.col("spot")
    return (rows.select("id", F.col("names.primary").alias("name"), F.col("taxonomy.primary").alias("category"),
                    "basic_category", "confidence", "operating_status",
                    F.try_element_at("addresses", F.lit(1))["locality"].alias("locality"),
                    spot["x"].alias("lon"), spot["y"].alias("lat")))


def scan_boundaries(spark: SparkSession, path: str, country: str = "DE") -> DataFrame:
    """Regions of a country with geometry text and envelope."""
    rows = spark.read.parquet(path).where((F.col("country") == country) & (F.col("subtype") == "region"))
    text = geo_arrow.wkb_to_geojson("geometry") if dict(rows.dtypes)["geometry"] == "binary" else F.col("geometry")
    box = geo.envelope(geo.geojson_vertices("geometry"))
    return (rows.select(F.col("names.primary").alias("state"), text.alias("geometry"))
            .select("state", "geometry",
                    box["bbox_min_lon"].alias("xmin"), box["bbox_max_lon"].alias("xmax"),
                    box["bbox_min_lat"].alias("ymin"), box["bbox_max_lat"].alias("ymax")))


def write_boundaries(boundaries: DataFrame, path: str) -> None:
    """Boundary cache: zstd Parquet with WKB geometry."""
    (boundaries.withColumn("wkb", geo_arrow.geojson_to_wkb("geometry")).drop("geometry")
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.parquet(path).withColumn("geometry", geo_arrow.wkb_to_geojson("wkb"))
            .select("state", "geometry", "xmin", "xmax", "ymin", "ymax"))


def boundary_edges(boundaries: DataFrame) -> DataFrame:
    """Polygon edges of boundary geometry: state, x1, y1, x2, y2."""
    return geo.ring_edges(boundaries.withColumn("rings", geo.geojson_rings("geometry")), "rings", ["state"])
