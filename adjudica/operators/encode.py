"""Train-only imputation and ordinal codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import BOOLEAN_FEATURES, CATEGORICAL_FEATURES, NUMERIC_FEATURES
from adjudica.functions.blanks import bool_to_int, number
from adjudica.operators.features import assert_no_leakage
from adjudica.operators.running import dense_code, running
from adjudica.session import cut_lineage

#: A dictionary of at most this many values is sent to every task: shuffled by three values, the rows would fill three tasks.
SMALL = 10_000
METADATA = ("penalty", "row_id", "incident_id", "session", "season", "penalty_severity", "split")


def raw_value(column: str) -> Column:
    """Booleans to 0/1, numbers cast, categories with blank and ``nan`` as NULL."""
    if column in BOOLEAN_FEATURES:
        return bool_to_int(column).cast("double")
    if column in NUMERIC_FEATURES:
        return number(column)
    text = F.col(f"`{column}`").cast("string")
    return F.when(~text.isin("", "nan"), text)


def coerce_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) for c in keep], *[raw_value(c).alias(f"x_{c}") for c in columns])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of all columns in one pass over the rows.

    Rows become one count per (column, value). The counts are summed in value order on the executors, in cells between
    quantiles of the values, and the values that hold the middle ranks are picked there: one row per column comes back.
    """
    medians: dict[str, float | None] = {c: None for c in columns}
    if not columns:
        return medians
    entries = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))) for c in columns]))
    counts = df.select(F.explode(entries).alias("e")).groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(counts)
    shares = [k / 64 for k in range(1, 64)]
    facts = counts.groupBy("c").agg(F.percentile_approx("v", shares, 1000).alias("bounds"), F.sum("n").alias("total"))
    placed = counts.join(facts, "c").withColumn("cell", F.size(F.filter("bounds", lambda b: b < F.col("v"))))
    summed = running(placed, ["c"], ["cell"], [F.col("v")], F.col("n"), "before")
    picks = F.lit(0)
    for rank in (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)):
        picks = picks + ((F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))).cast("int")
    middle = summed.withColumn("picks", picks).where("picks > 0").groupBy("c").agg(
        F.sum(F.col("v") * F.col("picks")).alias("sum"), F.sum("picks").alias("picks"))
    for r in middle.collect():
        assert r.picks == 2, f"median of {r.c}: {r.picks} middle ranks"
        medians[r.c] = r["sum"] / 2
    return medians


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for all categorical columns in one shuffle."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"x_{c}").alias("value")) for c in columns])
    rows = df.select(F.explode(entries).alias("e")).select("e.*").where("value is not null")
    return rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame) -> DataFrame:
    """Most frequent value per column; ties go to the smallest."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))).alias("value"))


def ordinal_codes(counts: DataFrame) -> DataFrame:
    """(column, value, code): zero-based rank in text order."""
    return dense_code(counts, "column", "value", "code")


@dataclass
class Encoder:
    """Statistics of the training split."""

    categorical: list[str]
    numeric: list[str]
    fills: dict[str, float | str]
    codes: DataFrame
    sizes: dict[str, int] = field(default_factory=dict)

    @property
    def output_columns(self) -> list[str]:
        return [f"cat__{c}" for c in self.categorical] + [f"num__{c}" for c in self.numeric]

    def transform(self, df: DataFrame, keep: Sequence[str] = METADATA) -> DataFrame:
        """Impute, then code categories; values unseen in training become -1."""
        kept = [c for c in keep if c in df.columns]
        columns = [*self.categorical, *self.numeric]
        rows = coerce_features(df, columns, kept)
        for c in self.categorical:
            codes = self.codes.where(F.col("column") == c).select(
                F.col("value").alias(f"v_{c}"), F.col("code").alias(f"cat__{c}"))
            codes = F.broadcast(codes) if self.sizes.get(c, SMALL + 1) <= SMALL else codes
            rows = rows.withColumn(f"v_{c}", F.coalesce(f"x_{c}", F.lit(self.fills[c]))).join(codes, f"v_{c}", "left")
        return rows.select(
            *kept,
            *[F.coalesce(F.col(f"cat__{c}").cast("double"), F.lit(-1.0)).alias(f"cat__{c}") for c in self.categorical],
            *[F.coalesce(f"x_{c}", F.lit(float(self.fills[c]))).alias(f"num__{c}") for c in self.numeric])


def fit_encoder(train: DataFrame, columns: Sequence[str]) -> Encoder:
    """Fit on the training split only; a column without any value is dropped."""
    assert_no_leakage([c for c in columns if c != "driver_points"])
    categorical = [c for c in columns if c in CATEGORICAL_FEATURES]
    numeric = [c for c in columns if c in NUMERIC_FEATURES or c in BOOLEAN_FEATURES]
    raw = coerce_features(train, [*categorical, *numeric])
    medians = exact_medians(raw, [f"x_{c}" for c in numeric])
    fills: dict[str, float | str] = {c: medians[f"x_{c}"] for c in numeric if medians[f"x_{c}"] is not None}
    if categorical:
        # The dictionary is read once per column, so its small table is materialised.
        counts = cut_lineage(category_counts(raw, categorical))
        fills |= {r["column"]: r["value"] for r in most_frequent(counts).collect()}
        sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
        codes = cut_lineage(ordinal_codes(counts))
    else:
        codes, sizes = train.sparkSession.createDataFrame([], "column string, value string, code long"), {}
    return Encoder([c for c in categorical if c in fills], [c for c in numeric if c in fills], fills, codes, sizes)
