"""As-of joins against brute force, ties and boundaries."""

import random

from pyspark.sql import functions as F

from adjudica.operators import lookup, match
from adjudica.operators import asof
from adjudica.operators.asof import Feed, asof_backward, asof_nearest, max_until


def frames(spark, probes, feed):
    left = spark.createDataFrame(probes, "id int, k string, t double")
    return left, spark.createDataFrame(feed, "k string, at double, seq int, v string")


def test_backward_boundary(spark):
    left, feed = frames(spark, [(1, "s", 100.0), (2, "s", 99.9), (3, "s", None), (4, None, 100.0)], [("s", 100.0, 1, "a"), ("s", 10.0, 0, "b"), (None, 1.0, 2, "z")])
    got = {r.id: r.match for r in asof_backward(left, feed, ["k"], "t", "at", ["v"], "seq").collect()}
    assert got[1].v == "a" and got[1].error_seconds == 0 and got[2].v == "b" and got[3] is None and got[4] is None


def test_nearest_ties_take_the_first(spark):
    left, feed = frames(spark, [(1, "s", 100.0), (2, "s", 145.1)], [("s", 110.0, 5, "late"), ("s", 90.0, 7, "early"), ("s", 90.0, 6, "early-first")])
    got = {r.id: r.match for r in asof_nearest(left, feed, ["k"], "t", "at", ["v"], 35, "seq").collect()}
    assert got[1].v == "late" and got[2] is None


def test_random_against_brute_force(spark):
    rng = random.Random(3)
    probes = [(n, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", float(rng.randrange(20000))) for n in range(300)]
    feed = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", float(rng.randrange(20000)), n, f"v{n}") for n in range(300)]
    left, right = frames(spark, probes, feed)
    back = {r.id: r.match for r in asof_backward(left, right, ["k"], "t", "at", ["v"], "seq").collect()}
    near = {r.id: r.match for r in asof_nearest(left, right, ["k"], "t", "at", ["v"], 300, "seq").collect()}
    top = {r.id: r.highest for r in max_until(left, right, ["k"], "t", "at", "seq").collect()}
    for i, k, t in probes:
        own = [f for f in feed if f[0] == k]
        before = sorted((f for f in own if f[1] <= t), key=lambda f: (-f[1], f[2]))
        assert (back[i].v if back[i] else None) == (before[0][3] if before else None)
        close = sorted((f for f in own if abs(f[1] - t) <= 300), key=lambda f: (abs(f[1] - t), f[2]))
        assert (near[i].v if near[i] else None) == (close[0][3] if close else None)
        assert top[i] == max((f[2] for f in own if f[1] <= t), default=None)


def test_ranked_event_names(spark):
    calendars = {2020: [(4, "British Grand Prix"), (5, "70th Anniversary Grand Prix")],
                 2021: [(18, "Mexico City Grand Prix"), (19, "São Paulo Grand Prix")],
                 2026: [(7, "Barcelona Grand Prix"), (14, "Spanish Grand Prix"), (20, "Brazilian Grand Prix")]}
    wanted = [(2020, "British Grand Prix", 4), (2020, "Formula 1 70th Anniversary Grand Prix", 5), (2021, "Mexican Grand Prix", 18),
              (2021, "Brazilian Grand Prix", 19), (2026, "Barcelona-Catalunya Grand Prix", 7), (2026, "Spanish Grand Prix", 14),
              (2026, "São Paulo Grand Prix", 20), (2026, "Pre-Season Testing", None)]
    calendar = spark.createDataFrame([(s, r, n) for s, c in calendars.items() for r, n in c], "season int, round int, race_name string")
    events = spark.createDataFrame([(s, e) for s, e, _ in wanted] + [(2026, "")], "season int, event string")
    got = {(r.season, r.event): r["round"] for r in match.ranked_rounds(events, calendar).collect()}
    assert got == {(s, e): r for s, e, r in wanted}


def test_team_and_standing_lookups(spark):
    teams = spark.createDataFrame([("red", 0, ["old_red", "blue"]), ("blue", 1, ["x"])], "team_id string, ordinal int, legacy_ids array<string>")
    got = {r.team_id: r.canonical for r in lookup.canonical_teams(teams).collect()}
    assert got == {"red": "red", "old_red": "red", "blue": "blue", "x": "blue"}
    top = spark.createDataFrame([(2019, 1, n, f"D-{n}") for n in range(6)], "season int, round int, ordinal int, driver_id string")
    assert lookup.top_four(top).first().current_top_4_drivers == "d_0,d_1,d_2,d_3"


def test_keyed_positions(spark):
    rows = spark.createDataFrame([("i", 2712.0, 0, 44), ("i", 2712.0, 1, None)], "incident_id string, at double, pos int, driver_number int")
    laps = spark.createDataFrame([(44, 2, 2700.0), (44, 3, 2800.0), (7, 9, 2712.0)], "driver_number int, position int, Time double")
    near = asof_nearest(rows, laps, ["driver_number"], "at", "Time", ["position"], 45, "position")
    cell = lookup.regroup(near.withColumn("p", F.col("match.position")), "incident_id", "p").first().p
    assert cell == "2,"


def test_rows_without_key_or_time_match_nothing_and_stay(spark):
    rows = [(k, None if k % 10 else "k", None if k % 3 else float(k)) for k in range(300)]
    left = spark.createDataFrame(rows, "id int, k string, t double")
    feed = spark.createDataFrame([("k", 5.0, 1), ("k", 100.0, 2), (None, 7.0, 3)], "k string, at double, seq int")
    for found in (asof_backward(left, feed, ["k"], "t", "at", ["seq"], "seq"), asof_nearest(left, feed, ["k"], "t", "at", ["seq"], 1e6, "seq")):
        got = {r.id: r.match for r in found.collect()}
        assert len(got) == 300
        assert all(got[i] is None for i, k, t in rows if k is None or t is None)
        assert all(got[i] is not None for i, k, t in rows if k is not None and t is not None and t >= 5)


def test_equal_times_take_the_lowest_sequence_in_any_order(spark):
    import itertools
    left = spark.createDataFrame([(1, "k", 10.0)], "id int, k string, t double")
    feed = [("k", 12.0, 3, "c"), ("k", 12.0, 1, "a"), ("k", 12.0, 2, "b")]
    for order in itertools.permutations(feed):
        right = spark.createDataFrame(list(order), "k string, at double, seq int, v string")
        assert asof_nearest(left, right, ["k"], "t", "at", ["v"], 60, "seq").first().match.v == "a"


def test_busy_hour_is_cut_into_many_cells(spark):
    """One key and hour hold nine tenths of the feed; no cell holds more than a twentieth of it."""
    rng = random.Random(8)
    rows = [("hot", 3600 * 5 + rng.random() * 3600, n, f"v{n}") for n in range(18_000)]
    rows += [(f"k{n % 7}", rng.random() * 86_400, n, f"v{n}") for n in range(18_000, 20_000)]
    left, right = frames(spark, [(n, "hot", 3600 * 5 + rng.random() * 3600) for n in range(50)], rows)
    stack = asof._with_cells(asof._stack(left, [Feed("f", right, "at", ["v"], "seq")], ["k"], "t"), ["_k0"], asof.FAN)
    sizes = [r["count"] for r in stack.groupBy("_k0", "_cell").count().collect()]
    assert sum(sizes) == 20_050 and max(sizes) <= 1000
    got = {r.id: r.match.v for r in asof_backward(left, right, ["k"], "t", "at", ["v"], "seq").collect()}
    hot = sorted((t, n) for k, t, n, _ in rows if k == "hot")
    for i, _, t in [tuple(r) for r in left.collect()]:
        before = [n for at, n in hot if round(at * 1e6) <= round(t * 1e6)]
        assert got[i] == f"v{before[-1]}"


def test_several_feeds_in_one_scan(spark):
    """Every feed gives what it gives alone, at any number of cells; the plan shuffles the stack by key once."""
    rng = random.Random(4)
    probes = [(n, rng.choice(["a", "b", None]), float(rng.randrange(3000))) for n in range(200)]
    one = [(rng.choice("ab"), float(rng.randrange(3000)), n, f"x{n}") for n in range(150)]
    two = [(rng.choice("ab"), float(rng.randrange(3000)), n, f"y{n}") for n in range(20)]
    left, first = frames(spark, probes, one)
    _, second = frames(spark, probes, two)
    alone = {r.id: r.match for r in asof_backward(left, first, ["k"], "t", "at", ["v"], "seq").collect()}
    near = {r.id: r.match for r in asof_nearest(left, second, ["k"], "t", "at", ["v"], 60, "seq").collect()}
    top = {r.id: r.highest for r in max_until(left, first, ["k"], "t", "at", "seq").collect()}
    feeds = [Feed("x", first, "at", ["v"], "seq"), Feed("y", second, "at", ["v"], "seq", after=True), Feed("z", first, "at", ["seq"], highest=True)]
    for fan in (1, asof.FAN):
        found = asof.scan(left, feeds, ["k"], "t", fan).select(
            "id", asof.last_match("x", ["v"]).alias("x"), asof.nearest_match("y", ["v"], 60).alias("y"), F.col("z_before").alias("z"))
        assert {r.id: (r.x, r.y, r.z) for r in found.collect()} == {i: (alone[i], near[i], top[i]) for i, _, _ in probes}
