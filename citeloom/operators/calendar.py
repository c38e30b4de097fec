"""Dates, federal holidays, business days and deadlines as column expressions and small dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """A date of the form yyyy-mm-dd that exists, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def _nth(year: Column, month: int, day: str, n: int) -> Column:
    """The nth weekday of a month."""
    return F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), day), 7 * (n - 1))


def holidays(spark: SparkSession, first: int = 1990, last: int = 2100) -> DataFrame:
    """Distinct closed weekdays and holidays (``closed``) of the years: actual days, and observed ones of fixed dates on weekends."""
    y = F.col("year")
    fixed = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    rules = [
        fixed(1, 1), _nth(y, 1, "Mon", 3), _nth(y, 2, "Mon", 3), F.date_sub(F.next_day(fixed(5, 31), "Mon"), 7), F.when(y >= 2021, fixed(6, 19)),
        fixed(7, 4), _nth(y, 9, "Mon", 1), _nth(y, 10, "Mon", 2), fixed(11, 11), _nth(y, 11, "Thu", 4), fixed(12, 25),
    ]
    day = F.col("day")
    # Sunday is 1 and Saturday 7. A Saturday's observed Friday counts in the year where it falls, so the next New Year's is one of this year's.
    observed = F.when(F.dayofweek(day) == 7, F.date_sub(day, 1)).when(F.dayofweek(day) == 1, F.date_add(day, 1))
    years = spark.range(first, last + 2).select(F.col("id").cast("int").alias("year"))
    days = years.select(F.explode(F.array_compact(F.array(*rules))).alias("day"))
    both = days.select(F.explode(F.array_compact(F.array(day, observed))).alias("closed")).distinct()
    return both.where(F.year("closed").between(first, last))


def next_open_days(holidays: DataFrame, first: str, last: str) -> DataFrame:
    """(day, is_open, next_open) of all days: the first open day after each."""
    days = holidays.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.date_add(F.lit(last).cast("date"), 14))).alias("day"))
    shut = days.join(holidays.withColumnRenamed("closed", "day").withColumn("shut", F.lit(True)), "day", "left")
    known = shut.select("day", (F.col("shut").isNull() & ~F.dayofweek("day").isin(1, 7)).alias("is_open"))
    later = known.where("is_open").select(F.col("day").alias("open_day"))
    ahead = known.select("day", "is_open", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", 14))).alias("open_day"))
    return (
        ahead.join(later, "open_day").groupBy("day", "is_open").agg(F.min("open_day").alias("next_open")).where(F.col("day") <= F.lit(last).cast("date"))
    )


def anniversary(day: Column, years: Column) -> Column:
    """The same day some years on; the month's last where it has no such day."""
    return F.add_months(day, years * 12)


def deadline(start: Column, years: Column, tolling: Column) -> Column:
    """Anniversary extended by each tolled day inside the running period.

    ``tolling``: array of structs (start, end) of dates, both included; reversed
    windows and null members are ignored, overlapping ones counted once. Windows
    are merged in order of start; each whose start lies before the deadline so far
    extends it, which is the fixed point of counting and extending.
    """
    valid = F.array_sort(F.filter(tolling, lambda w: w["start"].isNotNull() & w["end"].isNotNull() & (w["end"] >= w["start"])))

    def step(acc: Column, w: Column) -> Column:
        low = F.greatest(w["start"], acc["covered"], start)
        days = F.when((low < acc["deadline"]) & (F.date_add(w["end"], 1) > low), F.datediff(F.date_add(w["end"], 1), low)).otherwise(0)
        return F.struct(F.date_add(acc["deadline"], days).alias("deadline"), F.greatest(acc["covered"], F.date_add(w["end"], 1)).alias("covered"))

    begin = F.struct(anniversary(start, years).alias("deadline"), start.alias("covered"))
    return F.aggregate(F.coalesce(valid, F.array()), begin, step, lambda acc: acc["deadline"])
