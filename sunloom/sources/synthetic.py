"""Deterministic origin rows without random numbers: a demo, and one derived from an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY, FUTURE = 96, 16
FIRST_DAY, LAST_SLOT = "2024-01-01 00:00:00", "2024-01-30 23:45:00"


def demo_origins(spark: SparkSession, stations: int = 2, origins: int = 240) -> DataFrame:
    """Stations with an origin every three hours, a sine-shaped day, and a ripple that depends on the index alone."""
    start = F.expr("timestamp_ntz'2024-03-01 00:00:00'")
    grid = spark.range(stations * origins).select(
        F.concat(F.lit("demo-"), (F.col("id") / origins).cast("int").cast("string")).alias("station"),
        F.timestamp_add("HOUR", (F.col("id") % origins * 3).cast("int"), start).alias("timestamp_win"),
        (F.lit(100.0) + F.floor(F.col("id") / origins) * 20).alias("cap_power_on"),
    )

    def day(ts: Column, minutes: Column) -> Column:
        at = (F.hour(ts) * 60 + F.minute(ts) + minutes) % 1440
        return F.greatest(F.lit(0.0), F.sin((F.pmod(at, F.lit(1440)) - 360) / 720.0 * F.lit(3.141592653589793)))

    def ripple(minutes: Column) -> Column:
        return 1.0 - F.pmod(minutes * 7 + F.dayofyear("timestamp_win") * 13, F.lit(29)) / 100.0

    back, ahead = F.sequence(F.lit(-15 * HISTORY), F.lit(-15), F.lit(15)), F.sequence(F.lit(15), F.lit(15 * FUTURE), F.lit(15))

    def floats(minutes: Column, f) -> Column:
        return F.transform(minutes, lambda m: f(day(F.col("timestamp_win"), m), m).cast("float"))

    return grid.select(
        "*",
        floats(back, lambda d, m: d * ripple(m) * F.col("cap_power_on")).alias("Power"),
        floats(back, lambda d, m: d * ripple(m) * 950.0).alias("GHI_real"),
        floats(ahead, lambda d, m: d * ripple(m) * F.col("cap_power_on")).alias("Power_predict"),
        floats(ahead, lambda d, m: d * 930.0).alias("GHI_SOLARGIS_predict"),
        floats(ahead, lambda d, m: d * 9.0 + 12.0).alias("TEMP_SOLARGIS_predict"),
        floats(ahead, lambda d, m: ripple(m) * 4.0).alias("WS_SOLARGIS_predict"),
        floats(ahead, lambda d, m: F.pmod(m, F.lit(360)) * 1.0).alias("WD_SOLARGIS_predict"),
    )


def origins_from_events(events: DataFrame) -> DataFrame:
    """Origin rows from ``events(ts, event_type, value)``: a 15-minute grid for each event type as a station.

    Irradiance, temperature, wind and capacity follow from the slot by fixed
    formulas. Rows without 96 past and 16 future slots are left out.
    """
    spark = events.sparkSession
    first = F.expr(f"timestamp_ntz'{FIRST_DAY}'")
    slots = spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{FIRST_DAY}', timestamp_ntz'{LAST_SLOT}', interval 15 minutes)")).alias("slot"))
    grid = events.select(F.col("event_type").alias("station")).distinct().crossJoin(F.broadcast(slots))
    quarter = F.floor(F.timestamp_diff("MICROSECOND", first, F.col("ts")) / 900000000).cast("int")
    sums = events.select(F.col("event_type").alias("station"), F.timestamp_add("MINUTE", quarter * 15, first).alias("slot"), "value").groupBy("station", "slot").agg(F.sum("value").alias("p"))
    minute = F.hour("slot") * 60 + F.minute("slot")
    bend = (minute - 720) / F.lit(360.0)
    d = grid.join(sums, ["station", "slot"], "left").select(
        "station", "slot", F.coalesce("p", F.lit(0.0)).cast("float").alias("p"),
        ((F.dayofmonth("slot") - 1) * 96 + F.hour("slot") * 4 + F.floor(F.minute("slot") / 15)).cast("int").alias("idx"),
        F.greatest(F.lit(0.0), F.lit(1000.0) * (F.lit(1.0) - bend * bend)).cast("float").alias("irr"),
    )
    e = d.select(
        "*", (F.lit(16.0) + F.lit(12.0) * F.col("irr") / F.lit(1000.0)).cast("float").alias("temp"), (F.lit(2.5) + F.lit(0.25) * (F.col("idx") % 7)).cast("float").alias("ws"),
        ((160 + 5 * (F.col("idx") % 40)) % 360).cast("float").alias("wd"), F.when(F.col("idx") % 97 == 0, F.lit(0.0)).otherwise(F.lit(400.0) + F.col("idx") % 5).alias("cap"),
    )
    order = Window.partitionBy("station").orderBy("slot")
    past, future = order.rowsBetween(-HISTORY, -1), order.rowsBetween(1, FUTURE)
    listed = e.select(
        "station", F.col("slot").alias("timestamp_win"), F.col("cap").alias("cap_power_on"),
        F.collect_list("p").over(past).alias("Power"), F.collect_list("irr").over(past).alias("GHI_real"), F.collect_list("p").over(future).alias("Power_predict"),
        F.collect_list("irr").over(future).alias("GHI_SOLARGIS_predict"), F.collect_list("temp").over(future).alias("TEMP_SOLARGIS_predict"),
        F.collect_list("ws").over(future).alias("WS_SOLARGIS_predict"), F.collect_list("wd").over(future).alias("WD_SOLARGIS_predict"),
    )
    return listed.where((F.size("Power") == HISTORY) & (F.size("Power_predict") == FUTURE))
