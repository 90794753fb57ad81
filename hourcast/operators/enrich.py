"""Enrichment from reference calendars, weather and boundaries.

Calendars and boundary sets are bounded by the calendar (a few hundred days a
year) or by the administrative map (tens of polygons), so they are the only
inputs broadcast here; the observation side is never shuffled for them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourcast.functions.calendar import to_local

# French public holidays of 2024 (metropole).
PUBLIC_HOLIDAYS_2024 = {
    "2024-01-01": "Jour de l'an", "2024-04-01": "Lundi de Pâques",
    "2024-05-01": "Fête du Travail", "2024-05-08": "Victoire 1945",
    "2024-05-09": "Ascension", "2024-05-20": "Lundi de Pentecôte",
    "2024-07-14": "Fête nationale", "2024-08-15": "Assomption",
    "2024-11-01": "Toussaint", "2024-11-11": "Armistice 1918", "2024-12-25": "Noël",
}
# School holiday periods [start, end) with zone and location;
# the Christmas period of zone C, a zone A row and an overlapping label.
SCHOOL_HOLIDAYS = [
    ("Vacances de Noël", "Zone C", "Paris", "2023-12-23", "2024-01-08"),
    ("Vacances de Noël", "Zone A", "Lyon", "2023-12-23", "2024-01-08"),
    ("Pont de janvier", "Zone C", "Paris", "2024-01-05", "2024-01-10"),
    ("Vacances d'Hiver", "Zone C", "Paris", "2024-02-10", "2024-02-26"),
]
# WMO 4677 present-weather code ranges (inclusive) and labels.
WMO_4677 = [
    (0, 3, "cloud development"), (4, 9, "haze, dust or smoke"), (10, 12, "mist or shallow fog"),
    (13, 19, "precipitation or lightning in sight"), (20, 29, "past-hour phenomena"),
    (30, 39, "duststorm, sandstorm or blowing snow"), (40, 49, "fog"), (50, 59, "drizzle"),
    (60, 69, "rain"), (70, 79, "solid precipitation"), (80, 90, "showers"),
    (91, 99, "thunderstorm"),
]
# Test boundaries – two unit squares sharing the edge x = 1 and
# a two-point ring that cannot bound an area.
POLYGONS = [
    ("A", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]),
    ("B", [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]),
    ("X", [(0.0, 0.0), (2.0, 2.0)]),
]


def holiday_map_json(holidays: dict[str, str] = PUBLIC_HOLIDAYS_2024) -> str:
    return json.dumps(holidays, ensure_ascii=False)


def public_holidays(spark: SparkSession, payload: str | None = None) -> DataFrame:
    """JSON map ``date -> label`` parsed and exploded (one row per date)."""
    payload = payload or holiday_map_json()
    df = spark.createDataFrame([(payload,)], "payload string")
    m = F.from_json("payload", T.MapType(T.StringType(), T.StringType()))
    return (df.select(F.explode(m).alias("day", "holiday_label"))
            .select(F.to_date("day").alias("day"), "holiday_label"))


def flag_public_holidays(df: DataFrame, ts_utc: str, holidays: DataFrame) -> DataFrame:
    """``is_public_holiday`` by Paris civil date (the broadcast
    threshold decides how the calendar is joined)."""
    d = df.withColumn("_day", F.to_date(to_local(ts_utc)))
    j = d.join(holidays.withColumnRenamed("day", "_day"), "_day", "left")
    return j.withColumn("is_public_holiday", F.col("holiday_label").isNotNull()).drop("_day")


def school_days(spark: SparkSession, rows=SCHOOL_HOLIDAYS, zone: str = "Zone C",
                location: str = "Paris") -> DataFrame:
    """C14 + C15: kept periods exploded to their civil days ``[start, end)``."""
    df = spark.createDataFrame(rows, "label string, zone string, location string, start string, end string")
    kept = df.filter((F.col("zone") == zone) & (F.col("location") == location)
                     & (F.to_date("start") < F.to_date("end")))
    days = F.sequence(F.to_date("start"), F.date_sub(F.to_date("end"), 1))
    return kept.select("label", F.explode(days).alias("day"))


def _part(top: Column, own: Column) -> Column:
    """What a row leaves for the largest end of another label than the top's.

    A row of another label leaves its own end or, if it becomes the top, the old
    top's.  The running maximum of these parts is right although labels change
    places: a label that comes back to the top leaves a larger end behind.
    """
    return F.when(top.isNotNull() & own.isNotNull() & ~own["l"].eqNullSafe(top["l"]), F.least(own["e"], top["e"]))


def overlap_flags(intervals: DataFrame, key: str, start: str, end: str, label: str,
                  bucket: str) -> DataFrame:
    """An interval overlapping an earlier-starting interval with a
    different label, for any number of labels.

    The earlier intervals are summed up by two ends: the largest one with its
    label, and the largest one of another label; whichever has not the row's own
    label decides.  The state at the start of a bucket comes from one small table
    (the largest end per bucket and label), joined once; inside a bucket both
    ends are running maxima over one window.  No pairs are formed and a hot key
    stays split.
    """
    base = intervals.withColumn("_kb", F.struct(key, bucket))
    entries = base.groupBy("_kb", F.col(label).alias("_l")).agg(F.max(end).alias("_e")).filter("_e IS NOT NULL")
    in_key = Window.partitionBy(f"_kb.{key}").orderBy(f"_kb.{bucket}", "_l")
    own = F.struct(F.col("_e").alias("e"), F.col("_l").alias("l"))
    before = in_key.rowsBetween(Window.unboundedPreceding, -1)
    entries = entries.withColumns({"_top": F.max(own).over(before), "_own": own})
    entries = entries.withColumns({"_second": F.max(_part(F.col("_top"), F.col("_own"))).over(in_key.rowsBetween(Window.unboundedPreceding, 0)),
                                   "_upto": F.greatest("_top", "_own")})
    # at the end of each bucket, then carried to every later bucket of the key
    ends = entries.groupBy("_kb").agg(F.max("_upto").alias("_t"), F.max("_second").alias("_s"))
    buckets = base.select("_kb").distinct().join(ends, "_kb", "left")
    earlier = Window.partitionBy(f"_kb.{key}").orderBy(f"_kb.{bucket}").rowsBetween(Window.unboundedPreceding, -1)
    carry = buckets.select("_kb", F.max("_t").over(earlier).alias("_carried"), F.max("_s").over(earlier).alias("_second"))
    inside = Window.partitionBy("_kb").orderBy(start, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.when(F.col(end).isNotNull(), F.struct(F.col(end).alias("e"), F.col(label).alias("l")))
    led = base.join(carry, "_kb").withColumn("_own", mine)
    led = led.withColumn("_top", F.greatest(F.max("_own").over(inside), F.col("_carried")))
    led = led.withColumn("_other", F.greatest(F.max(_part(F.col("_top"), F.col("_own"))).over(inside), F.col("_second")))
    latest = F.when(F.col("_top.l").eqNullSafe(F.col(label)), F.col("_other")).otherwise(F.col("_top.e"))
    return (led.withColumn("overlap_warning", F.coalesce(latest > F.col(start), F.lit(False)))
            .drop("_kb", "_carried", "_second", "_own", "_top", "_other"))


def dated_labels(rows: DataFrame, day: str, label: str, year: int) -> DataFrame:
    """One row per date with its label count and contract outcome: a date
    with several labels is ambiguous, one outside ``year`` is flagged."""
    g = rows.groupBy(F.to_date(day).alias("day")).agg(F.count_distinct(label).alias("n_labels"), F.min(label).alias("label"))
    return g.withColumn("outcome", F.when(F.year("day") != year, "out_of_year").when(F.col("n_labels") > 1, "duplicate_date")
                        .otherwise("ok"))


def period_outcomes(rows: DataFrame, zone: str, location: str, keep_zone: str, keep_location: str,
                    start: str, end: str) -> DataFrame:
    """C14: every period with its outcome, so exclusions and invalid intervals can be counted."""
    outcome = (F.when(~F.coalesce(F.col(start) < F.col(end), F.lit(False)), "quarantine:invalid_interval")
               .when(~F.col(zone).eqNullSafe(keep_zone), "excluded:zone")
               .when(~F.col(location).eqNullSafe(keep_location), "excluded:location").otherwise("kept"))
    return rows.withColumn("outcome", outcome)


def wmo_category(code: str | Column) -> Column:
    """C20: WMO 4677 code -> category label (``CASE`` ladder over the ranges)."""
    c = F.col(code) if isinstance(code, str) else code
    expr = None
    for lo, hi, name in WMO_4677:
        cond = (c >= lo) & (c <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def polygon_array() -> Column:
    """The boundary set as a literal array of (label, ring, valid) structs."""
    items = []
    for label, ring in POLYGONS:
        pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])
        items.append(F.struct(F.lit(label).alias("label"), pts.alias("ring")))
    return F.array(*items)


def _inside(x: Column, y: Column, poly: Column) -> Column:
    """Ray casting for one polygon: valid ring (>= 3 vertices), bounding box,
    odd number of edge crossings of the ray towards +x."""
    ring = poly["ring"]
    n = F.size(ring)
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    in_box = (x >= F.array_min(xs)) & (x <= F.array_max(xs)) & (y >= F.array_min(ys)) & (y <= F.array_max(ys))

    def crossing(acc, i):
        a = F.element_at(ring, i + 1)
        b = F.element_at(ring, (i + 1) % n + 1)
        straddles = (a["y"] > y) != (b["y"] > y)
        x_cross = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return acc + F.when(straddles & (x < x_cross), 1).otherwise(0)

    crossings = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crossing)
    return (n >= 3) & in_box & (crossings % 2 == 1)


def point_in_polygon(points: DataFrame, x: str, y: str) -> DataFrame:
    """The polygons containing each point, computed inside the row (the
    boundary set is a bounded literal array), so no shuffle and no pairs.
    Invalid rings never match; ``n_hits > 1`` is the several-hits warning."""
    px, py = F.col(x), F.col(y)
    hits = F.filter(polygon_array(), lambda p: _inside(px, py, p))
    labels = F.transform(hits, lambda p: p["label"])
    invalid = F.size(F.filter(polygon_array(), lambda p: F.size(p["ring"]) < 3))
    return points.withColumns({"polygons": labels, "n_hits": F.size(labels),
                               "n_invalid_rings": invalid})
