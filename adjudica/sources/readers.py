"""Scans of the stored tables."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adjudica.constants import INCIDENT_COLUMNS
from adjudica.functions.blanks import number, or_empty, strip
from adjudica.functions.text import ODD_SPACES
from adjudica.functions.times import schedule_instant
from adjudica.sources import schemas as S


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def input_paths(spark: SparkSession, root: str, explicit: Sequence[str] | None = None,
                seasons: Sequence[int] | None = None, pattern: str = "processed_*.csv") -> list[str]:
    """Explicit paths, else one file per season, else everything that matches; missing is an error."""
    if explicit:
        return list(explicit)
    if seasons:
        found = {s: _glob(spark, f"{root}/processed_{s}.csv") for s in seasons}
        missing = [s for s, paths in found.items() if not paths]
        if missing:
            raise FileNotFoundError(f"no processed table for seasons {missing}")
        return [p for paths in found.values() for p in paths]
    paths = _glob(spark, f"{root}/{pattern}")
    if not paths:
        raise FileNotFoundError(f"no files matched {root}/{pattern}")
    return paths


def is_legend(incident_id: Column | str = "incident_id", drivers: Column | str = "drivers") -> Column:
    return strip(or_empty(incident_id)).startswith("*") | (strip(or_empty(drivers)) == "**")


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The column names of every file, read in one distributed scan; one row per file comes back."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("at"), "value").where("_metadata.file_block_start = 0")
    first = lines.groupBy("source_file").agg(F.min_by("value", "at").alias("header"))
    return {r.source_file: next(csv.reader([r.header]), []) for r in first.collect()}


def read_csv(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = INCIDENT_COLUMNS) -> DataFrame:
    """All-string CSV scan of any number of files, whose columns may stand in any order; one without them is an error.

    All files are one scan. Where their headers differ, each row finds its columns by the places of its file.
    """
    headers = csv_headers(spark, paths)
    if not headers:
        raise ValueError(f"no header in {list(paths)[:3]}")
    for path, header in headers.items():
        missing = [c for c in columns if c not in header]
        if missing:
            raise ValueError(f"{path} misses columns {missing}")
    width = max(map(len, headers.values()))
    schema = ", ".join(f"_c{k} string" for k in range(width))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", '"').csv(list(paths)).withColumn(
        "source_file", F.col("_metadata.file_path"))
    places = {path: [header.index(c) for c in columns] for path, header in headers.items()}
    shared = next(iter(places.values()))
    if all(own == shared for own in places.values()):
        found = [F.col(f"_c{k}") for k in shared]
    else:
        of_file = spark.createDataFrame(list(places.items()), "source_file string, _places array<int>")
        rows = rows.join(of_file, "source_file")
        cells = F.array(*[F.col(f"_c{k}") for k in range(width)])
        found = [F.get(cells, F.col("_places")[i]) for i in range(len(columns))]
    return rows.select(*[F.coalesce(value, F.lit("")).alias(c) for c, value in zip(columns, found)], "source_file")


def read_processed(spark: SparkSession, paths: Sequence[str], ordered: bool = True) -> DataFrame:
    """Processed incidents of several seasons: tagged, without legend rows, typed, ordered."""
    raw = read_csv(spark, paths)
    rows = raw.withColumn("source_season", F.regexp_extract("source_file", r"processed_([^/.]+)\.csv", 1))
    rows = rows.where(~is_legend()).withColumns({
        "season": number("season").cast("int"), "round": number("round").cast("int")})
    if not ordered:
        return rows
    return rows.orderBy(F.col("season").asc_nulls_last(), F.col("round").asc_nulls_last(), "incident_id")


def read_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Parsed documents, one JSON object per file or per line; failure lists are skipped."""
    rows = spark.read.schema(S.DOCUMENT).option("multiLine", one_per_file).json(path)
    return rows.where(~F.col("_metadata.file_name").endswith("_failures.json") & F.col("document_id").isNotNull())


def read_catalogue(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    return spark.read.schema(S.CATALOGUE).option("multiLine", one_per_file).json(path)


def read_raw_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole text files, one document each."""
    return usable_texts(spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("document_id"),
        F.col("value").alias("raw_text")))


def usable_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, raw_text) rows with text, and the others as failures."""
    rows = rows.withColumn("raw_text", F.translate(or_empty("raw_text"), ODD_SPACES, "  "))
    good = strip("raw_text") != ""
    return rows.where(good), rows.where(~good).select("document_id", F.lit("empty text").alias("error"))


def read_meta(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    return spark.read.schema(S.META).option("multiLine", one_per_file).json(path)


def _keyed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.map_entries(F.from_json("value", schema))).alias("ordinal", "e")).select(
        "ordinal", F.col("e.key").alias("key"), F.col("e.value").alias("value"))


def read_circuits(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, S.CIRCUITS).select("ordinal", F.col("key").alias("circuit"), "value.*")


def read_drivers(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, S.DRIVERS).select("ordinal", F.col("key").alias("driver"), "value.*")


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, S.TEAMS).select("ordinal", F.col("key").alias("team_id"), "value.*")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, "map<string, array<string>>").select(
        "ordinal", F.col("key").alias("incident_type"), F.col("value").alias("terms"))


def read_seasons(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Season facts, calendar, driver and team standings as four flat tables."""
    rows = _keyed(spark, path, S.SEASONS).select(F.col("key").cast("int").alias("season"), "value")
    drivers = F.col("value").getField("drivers.standings_order")
    teams = F.col("value").getField("teams.standings_order")
    return {
        "seasons": rows.select("season", "value.rounds", F.size(teams).alias("num_teams")),
        "calendar": rows.select("season", F.posexplode("value.calendar_in_order").alias("p", "circuit"))
        .select("season", "circuit", (F.col("p") + 1).alias("round")),
        "drivers": rows.select("season", F.posexplode(drivers).alias("p", "s")).select(
            "season", F.col("s.id").alias("driver"), (F.col("p") + 1).alias("position"),
            F.col("s.total_points").alias("points"), F.col("s.team").alias("team")),
        "teams": rows.select("season", F.posexplode(teams).alias("p", "s")).select(
            "season", F.col("s.id").alias("team"), (F.col("p") + 1).alias("position"),
            F.col("s.total_points").alias("points")),
    }


def _races(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(S.CALENDAR_PAYLOAD).json(path)
    table = F.col("MRData.RaceTable")
    return rows.select(table["season"].cast("int").alias("season"), F.explode(table["Races"]).alias("r"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    country = F.replace(F.lower(or_empty("r.Circuit.Location.country")), F.lit(" "), F.lit("_"))
    return _races(spark, path).select(
        "season", F.col("r.round").cast("int").alias("round"), F.col("r.raceName").alias("race_name"),
        F.col("r.Circuit.circuitId").alias("circuit_id"), country.alias("country"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return _races(spark, path).select(
        "season", F.col("r.round").cast("int").alias("round"), F.posexplode("r.Results").alias("seq", "x")).select(
        "season", "round", "seq", F.col("x.number").alias("number"), F.col("x.Driver.driverId").alias("driver_id"))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Session starts: one row per (season, round, session)."""
    r = F.col("r")
    blocks = F.array(
        F.struct(F.lit("race").alias("session"), r["date"].alias("date"), r["time"].alias("time")),
        *[F.struct(F.lit(name).alias("session"), r[key]["date"].alias("date"), r[key]["time"].alias("time"))
          for name, key in (("qualifying", "Qualifying"), ("practice", "FirstPractice"), ("sprint", "Sprint"))])
    rows = _races(spark, path).select("season", r["round"].cast("int").alias("round"), F.explode(blocks).alias("b"))
    starts = rows.select("season", "round", "b.session", schedule_instant("b.date", "b.time").alias("start_ts"))
    return starts.where("start_ts is not null")


def _lists(spark: SparkSession, path: str, field: str) -> DataFrame:
    rows = spark.read.schema(S.STANDINGS_PAYLOAD).json(path)
    table = F.col("MRData.StandingsTable")
    first = F.get(table["StandingsLists"], F.lit(0))
    return rows.select(table["season"].cast("int").alias("season"), table["round"].cast("int").alias("round"),
                       F.posexplode(first[field]).alias("ordinal", "s"))


def read_driver_standings(spark: SparkSession, path: str) -> DataFrame:
    return _lists(spark, path, "DriverStandings").select(
        "season", "round", "ordinal", F.col("s.Driver.driverId").alias("driver_id"),
        F.col("s.Driver.familyName").alias("family_name"), F.col("s.Driver.code").alias("code"),
        F.col("s.Driver.nationality").alias("nationality"),
        F.coalesce("s.position", "s.positionText").alias("position"), F.col("s.points").alias("points"),
        F.get("s.Constructors.constructorId", F.lit(0)).alias("constructor_id"))


def read_team_standings(spark: SparkSession, path: str) -> DataFrame:
    return _lists(spark, path, "ConstructorStandings").select(
        "season", "round", "ordinal", F.col("s.Constructor.constructorId").alias("constructor_id"),
        F.col("s.position").alias("position"), F.col("s.points").alias("points"))


def read_feed(spark: SparkSession, path: str, endpoint: str) -> DataFrame:
    return spark.read.schema(S.FEEDS[endpoint]).json(path)


def read_session_frame(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(S.SESSION_FRAMES[kind]).parquet(path)


def facts_by_incident(documents: DataFrame, order: str) -> DataFrame:
    """Last non-empty fact text per incident."""
    return documents.where(or_empty("fact") != "").groupBy("incident_id").agg(F.max_by("fact", order).alias("fact"))
