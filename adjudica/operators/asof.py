"""As-of joins as one stack, one shuffle and ordered scans; never a pairwise time join.

Probes and the rows of any number of feeds are stacked, cut into (key, cell) groups and scanned in time order, once per
direction for all feeds together. Cells lie between sampled times of the stack, so where a key or an hour is busy its
cells are narrow. Each cell receives what the cells before it carry over, so the result is exact for any cells; they only
bound how much of a hot key one task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Cells are found in two steps among FAN * FAN sampled times.
FAN = 16


@dataclass(frozen=True)
class Feed:
    """Rows to look up by time. ``take`` are the columns a match has; equal times take the lowest ``seq``.

    ``after`` also looks forward, as the nearest row needs; ``highest`` asks for the greatest value so far instead of rows.
    """

    name: str
    rows: DataFrame
    time: str
    take: Sequence[str]
    seq: str | None = None
    after: bool = False
    highest: bool = False


def _micros(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.round(F.col(name).cast("double") * 1_000_000).cast("long")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _cell_of(bounds: Column, t: Column) -> Column:
    """How many of the sorted bounds lie below t: first among every FAN-th of them, then among FAN neighbours."""
    return _let(F.size(F.filter(bounds["coarse"], lambda b: b < t)) * FAN,
                lambda at: at + F.size(F.filter(F.slice(bounds["all"], at + 1, F.lit(FAN)), lambda b: b < t)))


def _with_cells(stack: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Add ``_cell``; the sample is the rows of least hash, so it follows the data, and shapes the work but no result."""
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("_t").isNotNull())
    sample = stack.where(complete).select("_t", F.xxhash64("_t", "_seq", *keys).alias("h")).orderBy("h", "_t").limit(fan * FAN - 1)
    bounds = sample.agg(F.array_sort(F.collect_list("_t")).alias("all"))
    both = bounds.select(F.struct("all", F.filter("all", lambda b, k: k % FAN == FAN - 1).alias("coarse")))
    bounded = stack.withColumn("_bounds", both.scalar())
    # Probes without a key or a time match nothing; a hash spreads them, or they would be one cell.
    return bounded.withColumn("_cell", F.when(complete, _cell_of(F.col("_bounds"), F.col("_t"))).otherwise(
        F.xxhash64("_row")).cast("long")).drop("_bounds")


def _stack(probe: DataFrame, feeds: Sequence[Feed], by: Sequence[str], probe_time: str) -> DataFrame:
    def side(df: DataFrame, time: str, nth: int, seq: Column, payload: Column, name: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], _micros(df, time).alias("_t"), F.lit(nth).alias("_side"),
                         seq.alias("_seq"), payload.alias(name))

    parts = [side(probe, probe_time, 1, F.lit(None).cast("long"), F.struct(*[F.col(f"`{c}`") for c in probe.columns]), "_row")]
    for feed in feeds:
        seq = F.col(feed.seq).cast("long") if feed.seq else F.lit(0).cast("long")
        payload = F.col(feed.take[0]) if feed.highest else F.struct(
            _micros(feed.rows, feed.time).alias("_at"), seq.alias("_n"), *[F.col(c) for c in feed.take])
        rows = side(feed.rows, feed.time, 0, seq, payload, f"_f_{feed.name}")
        parts.append(rows.where(reduce(lambda a, b: a & b, [F.col(f"_k{i}").isNotNull() for i in range(len(by))], F.col("_t").isNotNull())))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan(probe: DataFrame, feeds: Sequence[Feed], by: Sequence[str], probe_time: str, fan: int = FAN) -> DataFrame:
    """The probe rows with ``_t`` and, for each feed, ``name_before``: its last row at or before the probe's time.

    With ``after``, ``name_after``: its first row at or after it; with ``highest``, ``name_before`` is the greatest value.
    Rows are structs of ``_at``, ``_n`` and the taken columns.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    stack = _with_cells(_stack(probe, feeds, by, probe_time), keys, fan)
    totals, carried, seen = [], [], {}
    for back in (True, False):
        t = F.col("_t").asc() if back else F.col("_t").desc()
        inside = Window.partitionBy(*keys, "_cell").orderBy(t, F.col("_side"), F.col("_seq").desc()).rowsBetween(Window.unboundedPreceding, 0)
        across = Window.partitionBy(*keys).orderBy(F.col("_cell").asc() if back else F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
        for feed in feeds:
            name, value = f"{feed.name}_{'before' if back else 'after'}", F.col(f"_f_{feed.name}")
            if feed.highest and back:
                totals.append(F.max(value).alias(f"_cell_{name}"))
                carried.append(F.max(f"_cell_{name}").over(across).alias(f"_carry_{name}"))
                seen[name] = (F.max(value).over(inside), F.greatest)
            elif back or feed.after:
                rank = F.when(value.isNotNull(), F.struct(F.col("_t") if back else -F.col("_t"), -F.col("_seq")))
                totals.append(F.max_by(value, rank).alias(f"_cell_{name}"))
                carried.append(F.last(f"_cell_{name}", ignorenulls=True).over(across).alias(f"_carry_{name}"))
                seen[name] = (F.last(value, ignorenulls=True).over(inside), F.coalesce)
    cells = stack.where("_t is not null").groupBy(*keys, "_cell").agg(*totals).select(*keys, "_cell", *carried)
    scanned = stack.withColumns({f"_scan_{name}": value for name, (value, _) in seen.items()})
    scanned = scanned.where("_side = 1").drop(*[f"_f_{feed.name}" for feed in feeds]).join(cells, [*keys, "_cell"], "left")
    return scanned.select("_row.*", "_t", *[both(f"_scan_{name}", f"_carry_{name}").alias(name) for name, (_, both) in seen.items()])


def last_match(name: str, take: Sequence[str]) -> Column:
    """The match of a backward scan: the taken columns and ``error_seconds``, the age of the row."""
    hit = F.col(f"{name}_before")
    return F.when(hit.isNotNull(), F.struct(*[hit[c].alias(c) for c in take], ((F.col("_t") - hit["_at"]) / 1_000_000).alias("error_seconds")))


def nearest_match(name: str, take: Sequence[str], tolerance_seconds: float) -> Column:
    """The nearer of the rows before and after, within the tolerance; equal distances take the lowest ``seq``."""
    before, after = F.col(f"{name}_before"), F.col(f"{name}_after")
    back, ahead = F.col("_t") - before["_at"], after["_at"] - F.col("_t")
    use_back = after.isNull() | (back < ahead) | ((back == ahead) & (before["_n"] <= after["_n"]))
    hit = F.when(before.isNotNull() & use_back, before).otherwise(after)
    error = F.abs(hit["_at"] - F.col("_t"))
    return F.when(error <= int(tolerance_seconds * 1_000_000), F.struct(
        *[hit[c].alias(c) for c in take], (error / 1_000_000).alias("error_seconds")))


def asof_backward(probe: DataFrame, feed: DataFrame, by: Sequence[str], probe_time: str, feed_time: str, take: Sequence[str],
                  seq: str, fan: int = FAN, out: str = "match") -> DataFrame:
    """Last feed row with ``feed_time <= probe_time``; ``out.error_seconds`` is its age."""
    found = scan(probe, [Feed("f", feed, feed_time, take, seq)], by, probe_time, fan)
    return found.select(*[F.col(f"`{c}`") for c in probe.columns], last_match("f", take).alias(out))


def asof_nearest(probe: DataFrame, feed: DataFrame, by: Sequence[str], probe_time: str, feed_time: str, take: Sequence[str],
                 tolerance_seconds: float, seq: str, fan: int = FAN, out: str = "match") -> DataFrame:
    """Nearest feed row within a tolerance; equal distances take the lowest ``seq``."""
    found = scan(probe, [Feed("f", feed, feed_time, take, seq, after=True)], by, probe_time, fan)
    return found.select(*[F.col(f"`{c}`") for c in probe.columns], nearest_match("f", take, tolerance_seconds).alias(out))


def max_until(probe: DataFrame, feed: DataFrame, by: Sequence[str], probe_time: str, feed_time: str, value: str,
              fan: int = FAN, out: str = "highest") -> DataFrame:
    """Highest ``value`` among feed rows with ``feed_time <= probe_time``."""
    found = scan(probe, [Feed("f", feed, feed_time, [value], highest=True)], by, probe_time, fan)
    return found.select(*[F.col(f"`{c}`") for c in probe.columns], F.col("f_before").alias(out))
