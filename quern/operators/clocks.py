"""Clocks: waves split at gaps, grains, spans, disagreements, offsets and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def waves(df: DataFrame, ts: str, gap: str = "30 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sessions split where the gap is strictly over `gap`: a session window merges partial sessions before the shuffle, so no task sorts all rows."""
    return df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value_sum"))


def grain(df: DataFrame, ts: str) -> DataFrame:
    """Distinct seconds, minutes, hours and days of a clock."""
    return df.agg(F.count("*").alias("stamps"), *[F.count_distinct(F.date_trunc(u, ts)).alias(f"distinct_{u}s") for u in ("second", "minute", "hour", "day")])


def spans(df: DataFrame, ts: str, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"), F.timestamp_diff("SECOND", F.min(ts), F.max(ts)).alias("span_s"))


def disagreement(df: DataFrame, a: Column, b: Column, days: int) -> DataFrame:
    """How two clocks of a row stand: their difference in days against a threshold."""
    d = F.datediff(b, a)
    kind = F.when(d < 0, "before").when(F.abs(d) > days, "apart").otherwise("agree")
    return df.groupBy(kind.alias("verdict")).agg(F.count("*").alias("n"), F.min(d).cast("long").alias("least_days"), F.max(d).cast("long").alias("most_days"))


def quarter_hours(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Differences rounded to quarter hours (the unit of zones), with how many fall on the quarter."""
    s = F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))
    q = F.floor(s / 900.0 + 0.5).cast("long")
    return df.groupBy(q.alias("quarters")).agg(F.count("*").alias("n"), F.count_if(s == q * 900).alias("exact"))


def shared_stamps(df: DataFrame, ts: str, size: str) -> DataFrame:
    """Stamps that rows of different sizes share."""
    return df.groupBy(ts).agg(F.count("*").alias("n"), F.count_distinct(size).alias("sizes")).where("sizes > 1")


def successive(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Steps between consecutive values of a key: monotonic, and the distinct steps."""
    w = Window.partitionBy(key).orderBy(*order)
    step = df.withColumn("step", F.col(value) - F.lag(value).over(w))
    return step.groupBy(key).agg(F.count("step").alias("steps"), F.count_if(F.col("step") < 0).alias("backwards"), F.count_distinct("step").alias("distinct_steps"))


#: Ticks a second, and seconds from the clock's zero to 1970.
READERS = {"unix": (1, 0), "unix_ms": (1000, 0), "mac": (1, 2082844800), "filetime": (10_000_000, 11644473600), "uuid1": (10_000_000, 12219292800)}
#: 1990-01-01 and 2100-01-01, in seconds from 1970.
PLAUSIBLE = (631152000, 4102444800)


def dos_seconds(value: Column) -> Column:
    """Seconds from 1970 of a packed DOS date (high 16 bits) and time (low 16 bits); null where a part is out of range."""
    bits = lambda at, n: F.shiftright(value, at).bitwiseAND(F.lit((1 << n) - 1))
    month, day, hour, minute, pair = bits(21, 4), bits(16, 5), bits(11, 5), bits(5, 6), bits(0, 5)
    first = F.make_date((bits(25, 7) + 1980).cast("int"), F.greatest(F.lit(1), F.least(month, F.lit(12))).cast("int"), F.lit(1))
    valid = value.between(0, 0xFFFFFFFF) & month.between(1, 12) & day.between(1, F.dayofmonth(F.last_day(first))) & (hour < 24) & (minute < 60) & (pair < 30)
    return F.when(valid, F.unix_date(first).cast("long") * 86400 + (day - 1) * 86400 + hour * 3600 + minute * 60 + pair * 2)


def clock_readings(df: DataFrame, value: str, window: tuple[int, int] = PLAUSIBLE) -> DataFrame:
    """A row for each reader that finds a plausible moment in the raw number: reader, and seconds from 1970. Rows none can read give none."""
    raw = F.col(value).cast("long")
    read = {name: F.expr(f"cast(`{value}` as bigint) div {ticks}") - zero for name, (ticks, zero) in READERS.items()}
    read["dos"] = dos_seconds(raw)
    cells = F.array(*[F.struct(F.lit(n).alias("reader"), s.alias("seconds")) for n, s in read.items()])
    return df.select("*", F.inline(cells)).where(F.col("seconds").between(*window))
