"""Road, place, region and log tables derived from the business tables.

Nothing is left out: every order becomes a road, every customer a place, every
nation a region, every event a turn or a visit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.functions import geo
from roadloom.operators.cells import with_cell
from roadloom.operators.series import incident_rules
from roadloom.session import configure

RELEASE_A, RELEASE_B = "2026-07-22.0", "2026-08-19.0"
# Roads opened after the first date are new in release B, those from before the
# second one were withdrawn in it.
OPENED_AFTER_A, WITHDRAWN_BEFORE_B = "2001-01-01", "1995-07-01"
INCIDENT_STATES = ["NATION_1", "NATION_2"]
GERMANY = [5.87, 47.27, 15.04, 55.06]
BAYERN = [8.97, 47.27, 13.84, 50.56]
PRIORITY_CLASS = {
    "1-URGENT": "motorway", "2-HIGH": "trunk", "3-MEDIUM": "primary",
    "4-NOT SPECIFIED": "secondary", "5-LOW": "tertiary",
}
LANDMARKS = [
    ("Hauptbahnhof", 8.6625, 50.1070), ("Messe", 8.6466, 50.1117),
    ("Roemer", 8.6821, 50.1106), ("Hauptwache", 8.6791, 50.1137),
]
STATEMENTS = [
    "SELECT count(*) FROM places WHERE id = {u}",
    "WITH v AS (SELECT {u} AS u) SELECT u FROM v",
    "select * from places -- ; drop table places {u}",
    "SELECT * FROM places WHERE name = 'Call Center {u}'",
    "SELECT * FROM notes WHERE note = 'it''s a set {u}'",
    "DESCRIBE places",
    "DROP TABLE places_{u}",
    "SELECT {u}; DROP TABLE places",
    "COPY places TO '/tmp/{u}.csv'",
    "SELECT * FROM read_csv('/etc/{u}')",
    "SELECT * FROM read_csv_auto('/etc/{u}')",
    "INSTALL extension_{u}",
    "SET memory = {u}",
    "",
    "/* DROP {u} */ DELETE FROM places",
    "SELECT '-- {u}' AS a, 1 AS b",
    "SELECT ';{u}' AS a",
    "SELECT load FROM engine_{u}",
    "  show tables ;; ",
    "EXPLAIN SELECT {u}",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _class(priority: str = "o_orderpriority"):
    first, *rest = PRIORITY_CLASS.items()
    out = F.when(F.col(priority) == first[0], first[1])
    for value, name in rest:
        out = out.when(F.col(priority) == value, name)
    return out


# Start of a road, and the offsets of its vertices per unit of length; roads with
# status P have the second path as well.
_X0, _Y0, _SCALE = "(6e0 + o_orderkey * 73 % 9000 / 1e3)", "(47.5e0 + o_orderkey * 151 % 7000 / 1e3)", "(1 + o_orderkey % 5)"
_MAIN_PATH = [(0.0, 0.0), (0.01, 0.004), (0.015, 0.012)]
_SIDE_PATH = [(0.02, 0.012), (0.03, 0.02)]


def _path(offsets) -> str:
    at = lambda start, off: f"{start} + {off}D * {_SCALE}" if off else start
    return "array(" + ", ".join(f"named_struct('x', {at(_X0, x)}, 'y', {at(_Y0, y)})" for x, y in offsets) + ")"


def _road_paths():
    main, side = _path(_MAIN_PATH), _path(_SIDE_PATH)
    return F.expr(f"CASE WHEN o_orderstatus = 'P' THEN array({main}, {side}) ELSE array({main}) END")


def spread(orders: DataFrame) -> DataFrame:
    """Small rows of which each makes much work, over as many tasks as a shuffle has: with that number given, adaptive execution
    does not fold them into one again."""
    return orders.repartition(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


def roads(spark, sf_dir) -> DataFrame:
    """id, class, name, status, opened, parts: one line feature per order."""
    k = F.col("o_orderkey")
    name = F.when(k % 3 != 0, F.concat(F.lit("R"), (k % 200).cast("string")))
    return spread(table(spark, sf_dir, "orders")).select(
        k.alias("id"), _class().alias("class"), name.alias("name"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("opened"), _road_paths().alias("parts"))


def road_lengths(spark, sf_dir) -> DataFrame:
    return roads(spark, sf_dir).withColumn("length_km", geo.parts_km("parts"))


def release_roads(spark, sf_dir) -> DataFrame:
    """Both releases from one scan: release, id, class, name, is_named, length_km, cx, cy."""
    day = F.col("opened")
    in_a, in_b = day < F.lit(OPENED_AFTER_A).cast("date"), day >= F.lit(WITHDRAWN_BEFORE_B).cast("date")
    releases = F.array_compact(F.array(F.when(in_a, RELEASE_A), F.when(in_b, RELEASE_B)))
    longer = F.when((F.col("release") == RELEASE_B) & (F.col("status") == "F"), F.lit(1.02)).otherwise(F.lit(1.0))
    return (with_cell(road_lengths(spark, sf_dir)).withColumn("release", F.explode(releases))
            .select("release", "id", "class", "name", F.col("name").isNotNull().alias("is_named"),
                    (F.col("length_km") * longer).alias("length_km"), "cx", "cy"))


def release_pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    both = release_roads(spark, sf_dir).select("release", "id", "class", "length_km")
    return tuple(both.where(F.col("release") == r).drop("release") for r in (RELEASE_A, RELEASE_B))


def state_rings(spark, sf_dir) -> DataFrame:
    """state, rings: a slanted 5 x 5 tiling, one quadrilateral per nation."""
    i, j = "n_nationkey % 5", "floor(n_nationkey / 5e0)"
    corner = lambda a, b: (f"named_struct('x', 6.0037D + 1.7D * ({i} + {a}) + 0.031D * ({j} + {b}), "  # noqa: E731
                           f"'y', 47.5041D + 1.3D * ({j} + {b}) + 0.023D * ({i} + {a}))")
    ring = ", ".join(corner(a, b) for a, b in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("state"),
                                                 F.expr(f"array(array({ring}))").alias("rings"))


def state_edges(spark, sf_dir) -> DataFrame:
    return geo.ring_edges(state_rings(spark, sf_dir), "rings", ["state"])


def places(spark, sf_dir) -> DataFrame:
    c = F.col("c_custkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(c.alias("id"),
                    (F.lit(8.47) + (c * 37 % 3300) / F.lit(1e4)).alias("lon"),
                    (F.lit(50.02) + (c * 91 % 2100) / F.lit(1e4)).alias("lat"),
                    F.when(c % 17 != 0, F.lower("c_mktsegment")).alias("category"),
                    F.when(F.col("c_acctbal") < 0, "permanently_closed").otherwise("open").alias("operating_status"),
                    ((F.col("c_acctbal") + F.lit(1e3)) / F.lit(11e3)).alias("confidence"),
                    F.col("c_name").alias("name"), F.col("n_name").alias("locality")))


def landmarks(spark) -> DataFrame:
    return spark.createDataFrame(LANDMARKS, "landmark string, to_lon double, to_lat double")


def supplier_sites(spark, sf_dir) -> DataFrame:
    """Suppliers as landmarks: landmark, to_lon, to_lat."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("landmark"), (F.lit(8.47) + (s * 131 % 3300) / F.lit(1e4)).alias("to_lon"),
        (F.lit(50.02) + (s * 57 % 2100) / F.lit(1e4)).alias("to_lat"))


def monthly_stats(spark, sf_dir) -> DataFrame:
    """Statistics of one release per month of orders: release, state, class,
    segments, length_km, pct_named."""
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), _class().alias("class"),
        (F.col("o_orderkey") % 3 != 0).alias("is_named"), (F.col("o_totalprice") / F.lit(1e3)).alias("km"))
    homes = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Orders are reduced to (customer, month, class) before the join.
    per_customer = orders.groupBy("o_custkey", "month", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("km").alias("km"), F.count_if("is_named").alias("named"))
    return (per_customer.join(homes, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(F.concat("month", F.lit("-15.0")).alias("release"), F.col("n_name").alias("state"), "class")
            .agg(F.sum("n").alias("segments"), F.sum("km").alias("length_km"),
                 (F.lit(100.0) * F.sum("named") / F.sum("n")).alias("pct_named")))


def every_scope(spark, sf_dir) -> DataFrame:
    """Scope records of all monthly releases: the area changes by year, the
    classes by half-year."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    months = table(spark, sf_dir, "orders").select(month.alias("m")).distinct()
    year, no = F.substring("m", 1, 4).cast("int"), F.substring("m", 6, 2).cast("int")
    bbox = F.when(year % 2 == 0, F.array(*map(F.lit, GERMANY))).otherwise(F.array(*map(F.lit, BAYERN)))
    some = [F.lit(c) for c in ("motorway", "primary", "trunk")]
    minor = [F.lit(c) for c in ("living_street", "residential", "unclassified")]
    classes = F.when(no <= 6, F.array(*some)).otherwise(F.array(*minor, *some))
    return months.select(F.concat("m", F.lit("-15.0")).alias("release"), bbox.alias("bbox"), classes.alias("classes"))


def monthly_scopes(spark, sf_dir) -> DataFrame:
    """The same where December has no record."""
    return every_scope(spark, sf_dir).where(F.substring("release", 6, 2) != "12")


def answers(spark, sf_dir) -> DataFrame:
    """Recorded answers, one per order."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    check = F.when(F.col("o_orderstatus") == "O", "number").when(F.col("o_orderstatus") == "P", "set").otherwise("refusal")
    english = F.format_number(price, 2)
    number = (F.when(k % 4 == 0, F.concat(F.lit("The total is "), english, F.lit(" km.")))
              .when(k % 4 == 1, F.concat(F.lit("Es sind "), F.translate(english, ",.", ".,"), F.lit(" Kilometer.")))
              .when(k % 4 == 2, F.concat(F.lit("About "), F.format_number(price + 1, 2), F.lit(".")))
              .otherwise(F.lit("The data does not contain this.")))
    names = (F.when(k % 4 == 0, "Living street and Motorway lead.").when(k % 4 == 1, "living-street, MOTORWAY")
             .when(k % 4 == 2, "Only motorway").otherwise("Neither."))
    refusal = (F.when(k % 4 == 0, "I cannot answer that.").when(k % 4 == 1, "Leider keine Angaben.")
               .when(k % 4 == 2, "There were 312.").otherwise("Nothing found."))
    expected = (F.when(check == "number", F.array(price.cast("string")))
                .when(check == "set", F.array(F.lit("living_street"), F.lit("motorway")))
                .otherwise(F.array().cast("array<string>")))
    return spread(table(spark, sf_dir, "orders")).select(
        k.alias("id"), F.when(k % 2 == 0, "en").otherwise("de").alias("lang"), check.alias("check"),
        # One model holds a third of all answers.
        F.when(k % 3 == 0, "granite:8b").otherwise(F.concat(F.lit("basalt-"), (k % 5).cast("string"))).alias("model"),
        F.when(check == "number", number).when(check == "set", names).otherwise(refusal).alias("answer"),
        expected.alias("expected"), F.lit(0.0).alias("rel_tol"), F.lit(0.001).alias("abs_tol"),
        F.array(F.struct(F.lit("SELECT 1").alias("sql"), (k % 7 != 0).alias("ok"))).alias("queries"),
        ((k * 37 % 9973) / F.lit(1e2)).alias("seconds"), F.to_date("o_orderdate").alias("day"))


def turns(spark, sf_dir) -> DataFrame:
    """A turn log, one turn per event."""
    failed = F.col("event_type") == "error"
    query = F.struct(F.lit("SELECT 1").alias("sql"), F.lit("").alias("purpose"), (~failed).alias("ok"),
                     F.lit(1).cast("bigint").alias("rows"), F.lit(None).cast("string").alias("error"),
                     F.lit(0.5).alias("seconds"))
    return table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        F.concat(F.lit("Question "), F.col("event_id").cast("string")).alias("question"),
        F.col("props").alias("answer"), F.lit("local").alias("provider"), F.col("event_type").alias("model"),
        F.col("value").alias("seconds"), F.lit(100).cast("bigint").alias("input_tokens"),
        F.lit(20).cast("bigint").alias("output_tokens"), F.array(query).alias("queries"),
        F.array(F.lit("places")).alias("tables"), F.lit(None).cast("string").alias("rating"))


def statements(spark, sf_dir) -> DataFrame:
    """Recorded statements, one per event."""
    choice = F.try_element_at(F.array(*[F.lit(s) for s in STATEMENTS]),
                              (F.col("event_id") % len(STATEMENTS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.replace(choice, F.lit("{u}"), F.col("user_id").cast("string")).alias("sql"))


def footers(spark, sf_dir) -> DataFrame:
    """Footer rows of an imagined layout of the roads: one file per class, one
    row group per square degree.  Trunk roads of the first column lack
    statistics."""
    first = F.flatten("parts")[0]
    groups = (roads(spark, sf_dir).select("class", first["x"].alias("x"), first["y"].alias("y"),
                                          F.size(F.flatten("parts")).alias("v"))
              .groupBy("class", (F.floor("x") * 100 + F.floor("y")).cast("int").alias("row_group_id")).agg(
                  F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
                  F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")))
    blank = (F.col("class") == "trunk") & (F.col("row_group_id") < 700)
    known = lambda c: F.when(~blank, F.col(c))
    none = F.lit(None).cast("double")

    def leaf(name, size, lo, hi):
        return F.struct(F.lit(name).alias("path_in_schema"), size.cast("bigint").alias("total_compressed_size"),
                        lo.alias("mn"), hi.alias("mx"))

    leaves = F.array(leaf("bbox, xmin", F.col("n") * 8, known("x0"), known("x1")),
                     leaf("bbox, ymin", F.col("n") * 8, known("y0"), known("y1")),
                     leaf("geometry", F.col("v") * 16, none, none), leaf("routes", F.col("n") * 999, none, none))
    return groups.select(F.concat("class", F.lit(".parquet")).alias("file_name"), "row_group_id",
                         F.explode(leaves).alias("l")).select("file_name", "row_group_id", "l.*")


def boundary_footers(spark, sf_dir) -> DataFrame:
    """Footer rows with text statistics: one file per market segment, one row
    group per nation, customer names in the place of country codes."""
    groups = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.min("c_name").alias("lo"), F.max("c_name").alias("hi"), F.sum(F.length("c_name")).alias("b"))
    none = F.lit(None).cast("string")
    leaf = lambda n, size, lo, hi: F.struct(
        F.lit(n).alias("path_in_schema"), size.cast("bigint").alias("total_compressed_size"),
        lo.alias("text_min"), hi.alias("text_max"))
    leaves = F.array(leaf("country", F.col("b"), F.col("lo"), F.col("hi")),
                     leaf("geometry", F.col("b") * 16, none, none), leaf("sources", F.col("b") * 3, none, none))
    return groups.select(F.col("c_mktsegment").alias("file_name"), F.col("c_nationkey").alias("row_group_id"),
                         F.explode(leaves).alias("l")).select("file_name", "row_group_id", "l.*")


def rules(spark) -> DataFrame:
    return incident_rules(spark, states=INCIDENT_STATES)
