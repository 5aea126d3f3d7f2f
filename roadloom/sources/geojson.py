"""GeoJSON in and out.

Extract files hold one feature per line, so they are read as text, line by
line and in parallel (a gzip file is one task).  A document in another layout is
cut into its features first, by as many tasks as it has splits.  Each file of a
folder has its own layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.functions.text import clean_key
from roadloom.session import materialize
from roadloom.sources.documents_in_splits import SMALL_GROUPS, in_larger_tasks, members

_FEATURE = ("type string, id string, properties string, geometry string, "
            "coordinates string, geometries string, features array<string>")
_FEATURE_FIELDS = _FEATURE.replace(" string", ":string").replace(" array", ":array")
#: Lines around the features, and lines of whole objects, the last perhaps with the brackets that close the collection.
_BRACKETS = (r'^(?:\{\s*"type"\s*:\s*"FeatureCollection"\s*,(?:[^\[\]]*,)?\s*"features"\s*:\s*\[|\]\s*\}?|\})$')
_OBJECTS = r"(?s)^\{.*\}$"


def read_lines(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """Text rows ``value`` ready for ``parse_features``.

    ``layout``: ``lines`` (features in lines), ``document`` (one JSON value over several lines) or ``auto``, which looks
    at every line and takes a file as a document when one of its lines is neither whole features nor a bracket.
    """
    if layout == "document":
        return _document_members(spark, path)
    lines = spark.read.text(path)
    if layout == "lines":
        return lines
    lines = in_larger_tasks(lines.select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), "value"))
    text = geo.computed(lines, _text=_stripped("value")).select("file", "_text").where("_text <> ''")
    whole = F.when(F.col("_text").startswith("{") & F.col("_text").endswith("}"), F.try_parse_json("_text"))
    found = geo.computed(text, _value=whole).select(
        "file", (F.col("_value").isNull() & ~F.col("_text").rlike(_BRACKETS)).alias("part"),
        (F.try_variant_get("_value", "$.type", "string") == "FeatureCollection").alias("collection"))
    # A collection that is all of its file is cut like one over several lines; its splits need not wait for one row.
    files = found.groupBy("file").agg(F.bool_or("part").alias("part"), F.bool_or("collection").alias("collection"), F.count(F.lit(1)).alias("n"))
    one_line = F.col("collection") & (F.col("n") == 1)
    documents = materialize(files.where(F.col("part") | one_line).select("file", F.coalesce(one_line, F.lit(False)).alias("one_line")), "documents")
    if documents.isEmpty():
        return lines.select("value")
    rest = lines.join(documents, "file", "left_anti").select("value")
    return rest.unionByName(_document_members(spark, path, documents))


def _document_members(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The features of documents, one per row.  A document that is no collection of features alone comes whole, in one row."""
    found, around = members(spark, path, files)
    shell = F.from_json("text", "type string, features array<string>")
    one = F.try_parse_json("text").isNotNull()
    # Without its members an array is empty; a second one may have had some as well.
    alone = (F.size(shell["features"]) == 0) & (F.regexp_count("text", F.lit(r"\[\s*\]")) == 1)
    around = materialize(around.select("file", F.coalesce(one & (shell["type"] == "FeatureCollection") & alone, F.lit(False)).alias("collection")), "around")
    other = found.where(F.coalesce(F.from_json("text", "type string")["type"] != "Feature", F.lit(True))).select("file").distinct()
    other = materialize(around.where(~F.col("collection")).select("file").union(other).distinct(), "other")
    value = found.select("file", F.col("text").alias("value"))
    if files is not None:
        # As ``parse_features`` has the members of a line, so that one without an id gets the same hash.
        parsed = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")[0]
        value = found.join(files, "file").select("file", F.when(F.col("one_line"), parsed).otherwise(F.col("text")).alias("value"))
    if other.isEmpty():
        return value.select("value")
    whole = spark.read.text(path, wholetext=True).select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), "value")
    return value.join(other, "file", "left_anti").select("value").unionByName(whole.join(other, "file", "left_semi").select("value"))


def _stripped(column: str) -> Column:
    space = ", \t\n\v\f\r"
    return F.rtrim(F.ltrim(F.col(column), F.lit("\ufeff" + space)), F.lit(space))


def parse_features(lines: DataFrame, column: str = "value") -> DataFrame:
    """feature_id, properties map<string,string>, geometry text.

    Accepts features, collections of features and bare geometries, several in one text if commas are between them; the
    brackets around the features give no row, anything else is an error.  Nested property values stay JSON text.  A
    feature without an id gets a stable hash of its text, since positions have no meaning in a split read.
    """
    text = _stripped(column)
    parse = lambda t: F.struct(t.alias("_text"), F.from_json(t, _FEATURE).alias("_f"))
    broken = lambda t: F.raise_error(F.concat(F.lit("not GeoJSON: "), F.substring(F.coalesce(t, F.lit("null")), 1, 200)))
    # Within brackets, what follows the value is not passed over.
    top = geo.computed(lines, _text=text).select("_text").where("_text <> ''").where(~F.col("_text").rlike(_BRACKETS))
    top = geo.computed(top, _all=F.from_json(F.concat(F.lit("["), "_text", F.lit("]")), f"array<struct<{_FEATURE_FIELDS}>>"))
    known = F.col("_text").rlike(_OBJECTS) & (F.size("_all") > 0)
    one = F.when(F.size("_all") == 1, F.array(F.struct("_text", F.element_at("_all", 1).alias("_f")))).otherwise(
        F.transform("_all", lambda f: F.struct(F.to_json(f).alias("_text"), f.alias("_f"))))
    top = top.select(F.inline(F.when(known, one).otherwise(broken(F.col("_text")))))
    wrapped = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col("_text"), F.lit("}"))
    kind = F.col("_f.type")
    member = lambda t: F.when(F.from_json(t, _FEATURE)["type"] == "Feature", parse(t)).otherwise(broken(t))
    features = (F.when(kind == "Feature", F.array(F.struct("_text", "_f")))
                .when((kind == "FeatureCollection") & F.col("_f.features").isNotNull(), F.transform("_f.features", member))
                .when(F.col("_f.coordinates").isNotNull() | F.col("_f.geometries").isNotNull(), F.array(parse(wrapped)))
                .otherwise(broken(F.col("_text"))))
    properties = F.coalesce(F.from_json("_f.properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = geo.computed(top.select(F.inline(features)), properties=properties)
    return rows.select(
        F.coalesce(F.col("_f.id"), F.xxhash64("_text").cast("string")).alias("feature_id"),
        "properties",
        F.coalesce(F.col("_f.properties"), F.lit("{}")).alias("properties_json"),
        F.col("_f.geometry").alias("geometry"))


def property_types(features: DataFrame) -> dict[str, tuple[str, str]]:
    """Raw property key -> (column name, Spark type).

    One distributed pass over all properties gives the distinct (key, type)
    pairs; what reaches the driver is the schema, not data.
    """
    spark = features.sparkSession
    source = features.select(F.try_parse_json("properties_json").alias("v")).where(F.col("v").isNotNull())
    pairs = (source.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
             .select("key", F.regexp_extract(F.schema_of_variant("value"), "^([A-Z]+)", 1).alias("t")).distinct())
    seen: dict[str, set] = {}
    names: dict[str, str] = {}
    for row in pairs.select("key", "t", clean_key("key").alias("name")).collect():
        seen.setdefault(row["key"], set()).add(row["t"])
        names[row["key"]] = row["name"]
    return {k: (names[k], _spark_type(t - {"VOID"})) for k, t in sorted(seen.items())}


def _spark_type(kinds: set) -> str:
    if kinds and kinds <= {"BIGINT"}:
        return "bigint"
    if kinds and kinds <= {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}:
        return "double"
    if kinds and kinds <= {"BOOLEAN"}:
        return "boolean"
    return "string"


def flatten_features(features: DataFrame, types: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """One column per property, plus the derived geometry columns.

    A property wins over a derived column of the same name: the derived value
    then moves to ``geom_<name>`` in the rows that have the property, and fills
    ``<name>`` in the others.  A missing ``is_named`` means true.
    """
    types = property_types(features) if types is None else types
    derived = geo.geometry_columns()
    props = F.col("properties")
    by_name: dict[str, list[tuple[str, str]]] = {}
    for key, (name, kind) in types.items():
        by_name.setdefault(name, []).append((key, kind))

    columns = [F.col("feature_id")]
    prop_columns, moved = [], []
    for name, sources in by_name.items():
        kinds = {kind for _, kind in sources}
        kind = kinds.pop() if len(kinds) == 1 else "string"
        value = F.coalesce(*[props[key].try_cast(kind) if kind != "string" else props[key] for key, _ in sources])
        if name in derived:
            given = None
            for key, _ in sources:
                has = F.map_contains_key(props, key)
                given = has if given is None else given | has
            own = derived[name]
            other = own if kind in ("double", "bigint") and name not in ("geom_type", "geometry_geojson") else own.cast("string")
            value = value.cast("double") if kind == "bigint" else value
            prop_columns.append(F.when(given, value).otherwise(other).alias(name))
            moved.append(F.when(given, own).alias(f"geom_{name}"))
        elif name == "is_named":
            prop_columns.append(F.coalesce(value.try_cast("boolean"), F.lit(True)).alias(name))
        else:
            prop_columns.append(value.alias(name))
    columns += prop_columns + moved
    columns += [c.alias(n) for n, c in derived.items() if n not in by_name]
    return geo.with_geometry(features).select(*columns)


def notes(types: dict[str, tuple[str, str]]) -> list[str]:
    """A note per property that hides a derived column."""
    from roadloom.constants import GEOMETRY_COLUMNS

    clash = sorted({name for name, _ in types.values()} & set(GEOMETRY_COLUMNS))
    return [f"{n} holds the file's property, geom_{n} what its geometry gives" for n in clash]


def read_geojson(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """``flatten_features`` of all files.  The features are written to the shared folder once, for the pass over their
    properties and for the columns."""
    parsed = parse_features(read_lines(spark, path, layout)).hint("rebalance")
    return flatten_features(in_larger_tasks(materialize(parsed, "parsed", **SMALL_GROUPS)))


# ---------------------------------------------------------------- writing

def _quoted(c: Column) -> Column:
    """A JSON string literal."""
    text = F.to_json(F.array(c.cast("string")))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def feature_line(fid: Column, properties: Column, geometry_json: Column) -> Column:
    """One compact GeoJSON feature; ``properties`` is a struct, its null fields
    are left out."""
    return F.concat(F.lit('{"type":"Feature","id":'), _quoted(fid), F.lit(',"properties":'), F.to_json(properties),
                    F.lit(',"geometry":'), geometry_json, F.lit("}"))


def road_lines(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Slim road features: id, class, state, length_km, name, is_named and a
    geometry text become one line each.  Empty names and the default flag are
    left out, lengths have 4 decimals, coordinates 5."""
    props = F.struct(
        "class", "state", F.round(F.col("length_km").cast("double"), 4).alias("length_km"),
        F.nullif(F.col("name"), F.lit("")).alias("name"),
        F.when(~F.coalesce(F.col("is_named"), F.lit(False)), F.lit(False)).alias("is_named"))
    parsed = geo.computed(df, _parsed=geo.parse_geometry(geometry))
    return parsed.select(feature_line(F.col("id"), props, geo.rounded_geometry_json(geometry, parsed=F.col("_parsed"))).alias("value"))


def place_lines(df: DataFrame) -> DataFrame:
    """Slim place features from id, name, category, basic_category, confidence,
    operating_status, locality, lon, lat."""
    props = F.struct("category", "basic_category", "name", "locality", "operating_status",
                     F.round(F.col("confidence").cast("double"), 3).alias("confidence"))
    at = F.to_json(geo.round_coordinates(F.array(F.col("lon").cast("double"), F.col("lat").cast("double")), 1))
    point = F.when(F.col("lon").isNull() | F.col("lat").isNull(), F.lit("null")).otherwise(
        F.concat(F.lit('{"type":"Point","coordinates":'), at, F.lit("}")))
    return df.select(feature_line(F.col("id"), props, point).alias("value"))


def write_features(lines: DataFrame, path: str) -> int:
    """gzip part files with one feature per line; returns the number of features.

    The writer commits its output as a whole, so no half-written file is ever
    visible.  gzip cannot be split, so the number of parts is the read
    parallelism later on.
    """
    seen = Observation()
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "gzip").text(path)
    return seen.get["n"]
