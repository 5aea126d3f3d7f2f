"""Radius searches and distance joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.constants import EARTH_RADIUS_KM
from roadloom.functions import geo
from roadloom.operators.skew import skew_join

#: Places in a part of a cell, where cells are cut for counting.
PART_PLACES = 100


def _degrees(radius_m: float) -> float:
    """Latitude degrees covered by a radius, with a little room for rounding."""
    return math.degrees(radius_m / 1000 / EARTH_RADIUS_KM) * (1 + 1e-9) + 1e-9


def within_radius(df: DataFrame, lon: float, lat: float, radius_m: float,
                  x: str = "lon", y: str = "lat") -> DataFrame:
    """Rows at most ``radius_m`` from one point.

    The plain range conditions come first so that they reach the scan and prune
    row groups; the exact distance decides.
    """
    d = _degrees(radius_m)
    box = F.col(y).between(lat - d, lat + d)
    top = math.radians(min(90.0, abs(lat) + d))
    if math.cos(top) > 1e-6:
        reach = math.sin(math.radians(d)) / math.cos(math.radians(lat))
        if reach < 1:
            dx = math.degrees(math.asin(reach)) * (1 + 1e-9) + 1e-9
            if lon - dx >= -180 and lon + dx <= 180:
                box = box & F.col(x).between(lon - dx, lon + dx)
    return df.where(box).where(geo.distance_m(x, y, lon, lat) <= radius_m)


def _size(radius_m: float) -> float:
    return max(_degrees(radius_m), 1e-6)


def _columns(size: float) -> Column:
    """Cells in the band ``gy``: as many as fit a radius wide at its edge nearer to the pole."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(F.col("gy") * size), F.abs((F.col("gy") + 1) * size)))
    return F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * (360.0 / size))).cast("bigint")


def _band(lat: Column, size: float) -> Column:
    return F.floor(lat / size).cast("bigint")


def _column(lon: Column) -> Column:
    return F.floor((lon + 180.0) / 360.0 * F.col("columns")).cast("bigint")


def _keyed(places: DataFrame, size: float, x: str, y: str) -> DataFrame:
    """Places with their cell gx, gy."""
    keyed = places.withColumn("gy", _band(F.col(y), size)).withColumn("columns", _columns(size))
    return keyed.withColumn("gx", F.pmod(_column(F.col(x)), F.col("columns"))).drop("columns")


def _reached(landmarks: DataFrame, size: float) -> DataFrame:
    """Landmarks with the cells gx, gy that their circles can touch; ``at`` is the column counted through from -180 degrees, also
    across the date line, and ``columns`` the number of them in the band."""
    lat = F.col("to_lat")
    reach = F.sin(F.radians(F.lit(size))) / F.cos(F.radians(lat))
    dx = F.when((F.abs(lat) + size < 90.0) & (reach < 1), F.degrees(F.asin(reach)) + 1e-9).otherwise(F.lit(180.0))
    bands = F.sequence(_band(F.greatest(lat - size, F.lit(-90.0)), size), _band(F.least(lat + size, F.lit(90.0)), size))
    reached = landmarks.withColumn("gy", F.explode(bands)).withColumn("columns", _columns(size))
    west, east = _column(F.col("to_lon") - dx), _column(F.col("to_lon") + dx)
    span = F.sequence(west, F.least(east, west + F.col("columns") - 1))
    return reached.withColumn("at", F.explode(span)).withColumn("gx", F.pmod("at", "columns"))


def distance_join(places: DataFrame, landmarks: DataFrame, radius_m: float,
                  x: str = "lon", y: str = "lat", count_where: Column | None = None) -> DataFrame:
    """Pairs of a place and a landmark at most ``radius_m`` apart, with the
    distance in metres.

    Both sides are keyed by cells: bands of latitude a radius high, each with as
    many columns as fit a radius wide at its edge nearer to the pole.  A place
    has one cell, a landmark the cells its circle can touch, some twenty at
    most wherever it lies.  The equi join on the cell then meets only near
    neighbours; a cell may hold any share of the places, hence the skew-safe
    join.  ``landmarks``: landmark, to_lon, to_lat.

    With ``count_where``, a condition on places, pairs come counted, as rows
    (landmark, n) whose sum is the number of pairs: see ``_counted``.
    """
    size = _size(radius_m)
    if count_where is not None:
        return _counted(places.where(count_where), landmarks, radius_m, x, y)
    reached = _reached(landmarks, size).drop("at", "columns")
    return _near(_keyed(places, size, x, y), reached, ["gx", "gy"], radius_m, x, y)


def _near(keyed: DataFrame, reached: DataFrame, keys: list[str], radius_m: float, x: str, y: str) -> DataFrame:
    metres = geo.distance_m(x, y, "to_lon", "to_lat")
    return (skew_join(keyed, reached, keys).drop(*keys)
            .withColumn("distance_m", metres).where(F.col("distance_m") <= radius_m))


def _counted(places: DataFrame, landmarks: DataFrame, radius_m: float, x: str, y: str) -> DataFrame:
    """(landmark, n): the pairs of ``distance_join``, counted without making all of them.

    A cell with many places is cut into ``cut`` strips of latitude and as many parts of each, so that a part has some
    PART_PLACES.  In a strip, a circle holds a run of parts as a whole, which the running totals of the strip answer for, and touches
    some parts at its edge, whose places are joined one by one.  A landmark thus meets about the square root of the
    places around it.
    """
    size = _size(radius_m)
    known = _keyed(places.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), size, "_x", "_y")
    # Small rows of which each makes much work, over as many tasks as a shuffle has, also where a join broadcasts the other side.
    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = known.where(~F.isnan("_x") & ~F.isnan("_y")).repartition(tasks)
    cuts = known.groupBy("gx", "gy").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / PART_PLACES)).cast("int").alias("cut"))
    part = lambda c: F.least(F.greatest(F.floor(c * F.col("cut")), F.lit(0)), F.col("cut") - 1).cast("int")
    along = (F.col("_x") + 180.0) / 360.0 * F.col("columns")
    parted = skew_join(known, cuts, ["gx", "gy"]).withColumn("columns", _columns(size))
    parted = parted.select("_x", "_y", "gx", "gy", part(F.col("_y") / size - F.col("gy")).alias("py"), part(along - F.floor(along)).alias("px"))
    parts = parted.groupBy("gx", "gy", "py", "px").agg(F.count(F.lit(1)).alias("n"))

    every = cuts.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))).withColumn("px", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    upto = Window.partitionBy("gx", "gy", "py").orderBy("px").rowsBetween(Window.unboundedPreceding, 0)
    totals = every.join(parts, ["gx", "gy", "py", "px"], "left").withColumn("upto", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    totals = totals.groupBy("gx", "gy", "py").agg(F.sort_array(F.collect_list(F.struct("px", "upto")))["upto"].alias("upto"))

    strips = _reached(landmarks.select("landmark", "to_lon", "to_lat"), size).join(cuts, ["gx", "gy"]).repartition(tasks)
    strips = strips.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    low = (F.col("gy") + F.col("py") / F.col("cut")) * size
    strips = strips.withColumn("_low", low - 1e-9).withColumn("_high", low + size / F.col("cut") + 1e-9)
    inner, outer = radius_m / 1000 / EARTH_RADIUS_KM * (1 - 1e-9) - 1e-11, math.radians(size)
    lat = F.radians("to_lat")

    def half(at: Column, radius: float) -> Column:
        """Half the width of a circle at a latitude, in degrees; not a number beyond it."""
        return F.degrees(F.acos((math.cos(radius) - F.sin(F.radians(at)) * F.sin(lat)) / (F.cos(F.radians(at)) * F.cos(lat))))

    # A circle around a pole has no such width: all that it reaches is looked at one by one.
    plain = (F.abs("to_lat") + size < 89.0) & (F.lit(math.degrees(outer)) < 45.0)
    touched = plain & ((F.col("_high") < F.col("to_lat") - size) | (F.col("_low") > F.col("to_lat") + size))
    strips = strips.where(~touched)
    shortest = F.least(half(F.col("_low"), inner), half(F.col("_high"), inner))
    shortest = F.when(plain & ~F.isnan(half(F.col("_low"), inner)) & ~F.isnan(half(F.col("_high"), inner)), shortest - 1e-9).otherwise(F.lit(-1.0))
    widest = F.degrees(F.asin(F.least(F.lit(1.0), math.sin(outer) / F.cos(lat)))) + 1e-9
    peak = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(lat) / math.cos(outer)))))
    known_half = lambda at: F.when(F.isnan(half(at, outer)), F.lit(0.0)).otherwise(half(at, outer))
    reach = F.when(peak.between(F.col("_low"), F.col("_high")), widest).otherwise(F.greatest(known_half(F.col("_low")), known_half(F.col("_high"))) + 1e-9)
    width = 360.0 / F.col("columns")
    start = F.col("at") * width - 180.0 - F.col("to_lon")
    place = lambda degrees: (degrees - start) / width * F.col("cut")
    clipped = lambda c, hi: F.greatest(F.lit(0), F.least(c, hi)).cast("int")
    end = F.col("cut") - 1
    strips = (strips.withColumn("_in", shortest).withColumn("_out", F.when(plain, reach).otherwise(F.lit(1e4)))
              .withColumn("first", clipped(F.floor(place(-F.col("_out")) - 1e-6), F.col("cut"))).withColumn("last", F.least(F.floor(place(F.col("_out")) + 1e-6), end).cast("int"))
              .where("first <= last")
              .withColumn("from", F.greatest(F.col("first"), clipped(F.ceil(place(-F.col("_in")) + 1e-6), F.col("cut"))))
              .withColumn("to", F.least(F.col("last"), F.greatest(F.lit(-1), F.floor(place(F.col("_in")) - 1e-6)) - 1).cast("int"))
              .withColumn("whole", (F.col("_in") > 0) & (F.col("from") <= F.col("to")))
              .select("landmark", "to_lon", "to_lat", "gx", "gy", "py", "first", "last", "from", "to", "whole"))
    runs = strips.where("whole").join(totals, ["gx", "gy", "py"])
    before = F.when(F.col("from") > 0, F.try_element_at("upto", F.col("from"))).otherwise(F.lit(0))
    runs = runs.select("landmark", (F.try_element_at("upto", F.col("to") + 1) - before).alias("n")).where("n > 0")
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    edge = F.when(F.col("whole"), F.concat(span(F.col("first"), F.col("from") - 1), span(F.col("to") + 1, F.col("last")))).otherwise(span(F.col("first"), F.col("last")))
    edges = strips.select("landmark", "to_lon", "to_lat", "gx", "gy", "py", F.explode(edge).alias("px"))
    near = _near(parted, edges, ["gx", "gy", "py", "px"], radius_m, "_x", "_y")
    return runs.unionByName(near.groupBy("landmark").agg(F.count(F.lit(1)).alias("n")))


def in_area(df: DataFrame, area: tuple[float, float, float, float], x="bbox.xmin", y="bbox.ymin") -> DataFrame:
    """Rows whose lower-left corner lies in the closed rectangle."""
    x0, y0, x1, y1 = area
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def viewport(df: DataFrame, pad: float, columns: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Envelope of the rows, padded on every side."""
    x0, y0, x1, y1 = columns or ("lon", "lat", "lon", "lat")
    num = lambda c: F.col(c).cast("double")
    return df.agg((F.min(num(x0)) - pad).alias("west"), (F.min(num(y0)) - pad).alias("south"),
                  (F.max(num(x1)) + pad).alias("east"), (F.max(num(y1)) + pad).alias("north"))


def count_near(pairs: DataFrame, *conditions: Column) -> DataFrame:
    """Places per landmark, from pairs or from pairs that come counted."""
    for c in conditions:
        pairs = pairs.where(c)
    n = F.sum("n") if pairs.columns == ["landmark", "n"] else F.count(F.lit(1))
    return pairs.groupBy("landmark").agg(n.alias("places"))
