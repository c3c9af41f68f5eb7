"""Ranked and substring matches as equi joins on expanded keys.

"A contains B" becomes an equi join of B with every substring of A, taken over the distinct
names only, so no plan compares all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adjudica.constants import EVENT_ALIASES
from adjudica.functions.blanks import or_empty, strip
from adjudica.functions.feeds import session_type
from adjudica.functions.text import event_name, event_stem, event_token, id_slug


def substrings(text: Column) -> Column:
    """Every distinct non-empty substring."""
    length = F.length(text)
    starts = F.sequence(F.lit(1), length)
    nested = F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(1), length - i + 1), lambda n: F.substring(text, i, n)))
    return F.when(length > 0, F.array_distinct(F.flatten(nested))).otherwise(F.array().cast("array<string>"))


def local_rounds(events: DataFrame, circuits: DataFrame, calendar: DataFrame) -> DataFrame:
    """Event -> circuit (exact name, else first name containing the event) -> round.

    ``events(season, event)``, ``circuits(event_name, circuit, ordinal)``,
    ``calendar(season, circuit, round)``.
    """
    wanted = events.select("season", "event").where(or_empty("event") != "").distinct()
    names = circuits.select("event_name", "circuit", "ordinal")
    # Only the first name of a key can win, so each side keeps one row per key before it is joined.
    first = F.min(F.struct("ordinal", "circuit")).alias("first")
    exact = wanted.join(names.groupBy(F.col("event_name").alias("event")).agg(first), "event").select(
        "season", "event", F.lit(0).alias("rank"), "first")
    parts = names.select("circuit", "ordinal", F.explode(substrings(F.lower("event_name"))).alias("stem"))
    loose = wanted.withColumn("stem", event_stem("event")).join(parts.groupBy("stem").agg(first), "stem").select(
        "season", "event", F.lit(1).alias("rank"), "first")
    best = exact.unionByName(loose).groupBy("season", "event").agg(F.min(F.struct("rank", "first")).alias("b")).select(
        "season", "event", F.col("b.first.circuit").alias("circuit"))
    first_round = calendar.groupBy("season", "circuit").agg(F.min("round").alias("round"))
    return best.join(first_round, ["season", "circuit"], "left").select("season", "event", "circuit", "round")


def ranked_rounds(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Event -> round by exact name, normalised name, alias, substring, unique shared word.

    ``events(season, event)``, ``calendar(season, round, race_name)``; within a rank the
    earlier calendar entry wins.
    """
    wanted = (events.select("season", "event").where(or_empty("event") != "").distinct()
              .withColumn("target", event_name("event")))
    races = calendar.select("season", "round", "race_name").withColumn("name", event_name("race_name"))
    alias = F.lit(None).cast("string")
    for left, right in EVENT_ALIASES:
        alias = F.when(F.col("target") == left, right).when(F.col("target") == right, left).otherwise(alias)
    usable = wanted.where("target <> ''")
    named = usable.select("season", "event", "target", F.lit(0).alias("other")).unionByName(
        usable.withColumn("target", alias).where("target is not null")
        .select("season", "event", "target", F.lit(1).alias("other")))

    def found(df: DataFrame, rank: Column) -> DataFrame:
        return df.select("season", "event", rank.alias("rank"), "round")

    def first(df: DataFrame, *keys: Column) -> DataFrame:
        """The earliest and the latest round per season and key: no join below meets more than one row per key."""
        return df.groupBy("season", *keys).agg(F.min("round").alias("round"), F.max("round").alias("last"))

    exact = found(wanted.withColumn("k", F.lower("event")).join(
        first(races, F.lower("race_name").alias("k")), ["season", "k"]), F.lit(1))
    equal = found(named.join(first(races, F.col("name").alias("target")), ["season", "target"]), F.lit(2) + F.col("other"))
    spelled = first(races.where("name <> ''"), F.col("name"))
    parts = spelled.select("season", "round", F.explode(substrings(F.col("name"))).alias("target"))
    inside = found(named.join(first(parts, F.col("target")), ["season", "target"]), F.lit(4) + F.col("other"))
    around = found(
        named.select("season", "event", "other", F.explode(substrings(F.col("target"))).alias("name"))
        .join(spelled, ["season", "name"]), F.lit(4) + F.col("other"))
    words = usable.select("season", "event", F.explode(F.array_distinct(F.split("target", " "))).alias("word"))
    spoken = races.where("name <> ''").select("season", "round", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    single = (words.join(first(spoken, F.col("word")), ["season", "word"]).groupBy("season", "event")
              .agg(F.min("round").alias("round"), F.max("last").alias("last")).where(F.col("round") == F.col("last")))
    candidates = exact.unionByName(equal).unionByName(inside).unionByName(around).unionByName(
        found(single, F.lit(6)))
    # Rank and round in one number: a hash aggregate, where a struct would be sorted.
    best = candidates.groupBy("season", "event").agg(
        F.min(F.col("rank").cast("long") * (1 << 32) + F.col("round")).alias("b")).select(
        "season", "event", (F.col("b") % (1 << 32)).cast(races.schema["round"].dataType).alias("round"))
    return wanted.select("season", "event").join(best, ["season", "event"], "left")


def session_keys(wanted: DataFrame, sessions: DataFrame) -> DataFrame:
    """(season, event, session) -> the feed session of the matching meeting.

    The meeting is the first whose country, location or circuit contains the event token or
    is contained in it; the session is the first with the wanted type or name, and practice
    falls back to the first practice by name.
    """
    asked = (wanted.select("season", "event", "session").where(or_empty("event") != "").distinct()
             .withColumn("want", event_token("event")))
    meetings = sessions.groupBy("season", "meeting_key").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.array("country_name", "location", "circuit_short_name"), "seq").alias("places"))
    places = meetings.select("season", "meeting_key", "seq", F.posexplode("places").alias("nth", "place"))
    places = places.withColumn("place", strip(F.lower(or_empty("place")))).where("place <> ''")
    order = F.struct("seq", "nth")
    holds = places.select("season", "meeting_key", "seq", "nth", F.explode(
        F.array_union(F.array(F.lit("")), substrings(F.col("place")))).alias("want"))
    events = asked.select("season", "event", "want").distinct()
    # One row per key on the meeting side: only its first meeting can win.
    first = F.min(F.struct(order.alias("at"), "meeting_key")).alias("m")
    inside = events.join(holds.groupBy("season", "want").agg(first), ["season", "want"]).select("season", "event", "m")
    around = (events.select("season", "event", F.explode(substrings(F.col("want"))).alias("place"))
              .join(places.groupBy("season", "place").agg(first), ["season", "place"]).select("season", "event", "m"))
    meeting = inside.unionByName(around).groupBy("season", "event").agg(F.min("m").alias("m")).select(
        "season", "event", F.col("m.meeting_key").alias("meeting_key"))
    lowered = F.lower(or_empty("session"))
    target = session_type("session")
    rows = (asked.drop("want").join(meeting, ["season", "event"])
            .join(sessions.withColumnRenamed("seq", "_seq"), ["season", "meeting_key"]))
    direct = (F.col("session_type") == target) | (F.col("session_name") == target)
    practice = (lowered == "practice") & F.col("session_type").startswith("Practice")
    ranked = rows.withColumn(
        "_rank", F.when(direct, F.struct(F.lit(0).alias("r"), F.lit("").alias("n"), F.col("_seq").alias("s")))
        .when(practice, F.struct(F.lit(1).alias("r"), or_empty("session_name").alias("n"), F.col("_seq").alias("s"))))
    return ranked.where("_rank is not null").groupBy("season", "event", "session").agg(
        F.min_by(F.struct("meeting_key", "session_key", "date_start"), "_rank").alias("_s")
    ).select("season", "event", "session", "_s.*")


def number_keys(results: DataFrame, roster: DataFrame | None, on: Sequence[str]) -> DataFrame:
    """Driver key -> car number. Results win; then full name, last name, acronym by roster order.

    ``results(*on, driver_id, number, seq)``, ``roster(*on, full_name, name_acronym,
    driver_number, seq)``.
    """
    keyed = results.where(or_empty("number") != "").select(
        *on, id_slug("driver_id").alias("key"), F.col("number").try_cast("int").alias("number"),
        F.struct(F.lit(0).alias("src"), (-F.col("seq")).cast("long").alias("seq"), F.lit(0).alias("kind")).alias("prio"))
    if roster is not None:
        full = F.replace(F.lower(or_empty("full_name")), F.lit(" "), F.lit("_"))
        names = F.array(full, F.element_at(F.split(full, "_"), -1), F.lower(or_empty("name_acronym")))
        extra = (roster.where("driver_number is not null")
                 .select(*on, F.col("driver_number").cast("int").alias("number"),
                         F.col("seq").cast("long").alias("seq"), F.posexplode(names).alias("kind", "key"))
                 .where("key <> ''")
                 .select(*on, "key", "number", F.struct(
                     F.lit(1).alias("src"), "seq", "kind").alias("prio")))
        keyed = keyed.unionByName(extra)
    return keyed.groupBy(*on, "key").agg(F.min_by("number", "prio").alias("number"))


def driver_numbers(rows: DataFrame, numbers: DataFrame, on: Sequence[str],
                   car: str = "car_number") -> DataFrame:
    """Add ``driver_number`` to exploded (pos, driver) rows; the first uses the document's car."""
    by_id = numbers.select(*on, F.col("key").alias("driver"), F.col("number").alias("_by_id"))
    by_tail = numbers.select(*on, F.col("key").alias("_tail"), F.col("number").alias("_by_tail"))
    joined = (rows.withColumn("_tail", F.element_at(F.split("driver", "_"), -1))
              .join(by_id, [*on, "driver"], "left").join(by_tail, [*on, "_tail"], "left"))
    own = strip(or_empty(car))
    number = (F.when(F.col("driver").startswith("car_"), F.lit(None).cast("int"))
              .when((F.col("pos") == 0) & own.rlike(r"^\d+$"), own.try_cast("int"))
              .otherwise(F.coalesce("_by_id", "_by_tail")))
    return joined.withColumn("driver_number", number).drop("_tail", "_by_id", "_by_tail")
