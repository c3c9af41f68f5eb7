"""Substring, suffix-array and near dedup against brute force."""

import numpy as np
import pytest

from adjudica.llm import anchors, minhash, substring, suffix
from adjudica.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.helpers import SF, documents, empty, found, frame, odd_rows

WORDS = ("doc_id", "n_words", "n_removed", "kept_sha256")
BYTES = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(100):
        t = np.append(rng.integers(2, 2 + rng.integers(1, 5), rng.integers(1, 60)), 0).astype(np.int64)
        line = t.tolist()
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(len(line)), key=lambda i: line[i:])
        plcp, left = suffix.permuted_common_prefixes(t, sa)
        for i, j in zip(sa[1:], sa[:-1]):
            k = 0
            while line[i + k:i + k + 1] == line[j + k:j + k + 1] != []:
                k += 1
            assert plcp[i] == k and left[i] == j


def test_later_copies_are_those_with_an_earlier_start():
    rng = np.random.default_rng(2)
    contents = [bytes(rng.integers(97, 99, rng.integers(1, 40)).tolist()) for _ in range(12)]
    later = suffix.later_copies(contents, 5)
    seen, want = set(), []
    for c in contents:
        for p in range(len(c)):
            s = c[p:p + 5]
            want.append(len(s) == 5 and s in seen)
            seen.add(s)
    assert later.tolist() == want


@pytest.mark.parametrize("seed", [3, 4])
def test_substring_dedup(spark, seed):
    rows = odd_rows(seed)
    rows += rows[20:23]
    assert found(substring.digest(frame(spark, rows)), *WORDS) == brute.substring(rows)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 22])
def test_suffix_dedup(spark, block_bytes):
    rows = odd_rows()
    rows += rows[20:23]
    made = anchors.repeated(suffix.texts(frame(spark, rows)), suffix.byte_symbols, suffix.span_bytes, suffix.shards, suffix._rest_of_bytes,
                            suffix.OUT, suffix.WIDTH, suffix.GRAM, True, block_bytes)
    assert found(made, *BYTES) == brute.suffix(rows)


def test_rewrite_keeps_columns_and_rows(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    out = substring.rewrite(df)
    assert out.columns == df.columns and out.count() == len(rows)
    left = {r.doc_id: r.text for r in out.collect()}
    want = {r[0]: r for r in brute.substring(rows)}
    for i, text in rows:
        assert brute.sha(" ".join(brute.WORD.findall(left[i]))) == want[i][3]
        if not want[i][2]:
            assert left[i] == (text or "")


def test_near_dedup(spark):
    rows = odd_rows()
    assert found(minhash.group(frame(spark, rows)), *NEAR) == sorted(brute.near(rows), key=str)


def test_keep_first_keeps_one_of_each_group(spark):
    rows = odd_rows()
    df = frame(spark, rows)
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute.near(rows) if r[3])


def test_links_between_blocks_equal_set_arithmetic():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12))).astype(np.uint64) for _ in range(40)]
    got = minhash.links_between(sets[:15], sets[15:], columns=4)
    for x in range(15):
        for y in range(15, 40):
            a, b = set(sets[x].tolist()), set(sets[y].tolist())
            assert got[x, y - 15] == (100 * len(a & b) >= 75 * len(a | b))


def test_links_that_stars_miss_are_found(spark):
    """A chain of texts, each like the next and unlike the rest, in buckets with a common least member."""
    words = [f"v{k}" for k in range(400)]
    rows = [(k, " ".join(words[8 * k:8 * k + 90])) for k in range(30)]
    assert found(minhash.group(frame(spark, rows)), *NEAR) == sorted(brute.near(rows), key=str)


def test_rows_without_id_and_empty_table(spark):
    rows = [(None, "q " * 60), (1, "q " * 60), (None, None), (2, None)]
    for made, columns in ((substring.digest(frame(spark, rows)), WORDS), (suffix.digest(frame(spark, rows)), BYTES)):
        assert made.count() == 4
        assert set(columns) <= set(made.columns)
    near = {(r.doc_id, r.component_id) for r in minhash.group(frame(spark, rows)).collect()}
    assert near == {(None, 1), (1, 1), (None, None), (2, 2)}
    for operator in (substring.digest, suffix.digest, minhash.group, substring.rewrite, minhash.keep_first):
        assert operator(empty(spark)).count() == 0


def test_registered_queries(spark):
    rows = documents(spark)
    assert found(QUERIES["op2_substring_dedup"](spark, SF), *WORDS) == brute.substring(rows)
    assert found(QUERIES["op5_suffix_array_dedup"](spark, SF), *BYTES) == brute.suffix(rows)
    assert found(QUERIES["op8_minhash_near_dedup"](spark, SF), *NEAR) == sorted(brute.near(rows), key=str)


def test_near_groups_of_rows_without_id_and_of_one_id_with_many_texts(spark):
    """Rows are joined by class: K texts under one id, or under none, never meet each other."""
    import random

    from pyspark.sql import functions as F
    from adjudica.llm import minhash

    rnd = random.Random(9)
    base = [f"v{k}" for k in range(400)]

    def near(seed):
        words = random.Random(seed).sample(base, 60)
        return " ".join(words), " ".join(words[:-1] + ["other"])

    rows = []
    for k in range(120):
        a, b = near(k)
        rows += [(None, a), (7, b)] if k % 2 else [(7, a), (1000 + k, b)]
    rows += [(None, "x y z")] * 3 + [(5, None), (7, "")]
    rnd.shuffle(rows)
    got = minhash.grouped(frame(spark, rows))
    by = {}
    for r in got.join(spark.createDataFrame([(i, t or "") for i, t in rows], "i long, t string").select(
            F.col("i"), "t", F.xxhash64("t").alias("k")).distinct(), (F.col("i").eqNullSafe(F.col("doc_id"))) & (F.col("k") == F.col("key"))).collect():
        by[(r.i, r.t)] = (r.component_id, r.kept)
    for k in range(120):
        a, b = near(k)
        first, second = ((None, a), (7, b)) if k % 2 else ((7, a), (1000 + k, b))
        assert by[first][0] == by[second][0] == 7
        assert by[first][1] == (first[0] == 7) and by[second][1] == (second[0] == 7)
    assert by[(None, "x y z")] == (None, True) and by[(5, "")] == (5, True) and by[(7, "")] == (7, True)
    assert got.count() == len(rows)


def test_stages_keep_odd_columns_and_judge_rows_by_their_own_text(spark):
    from adjudica.llm import minhash, substring

    shared = " ".join(f"s{k}" for k in range(50))
    rows = [(3, "a b c d e f", 1, "p", 2), (5, "a b c d e f", 1, "q", 2), (5, "g h i j k", 1, "r", 2), (8, shared, 0, "s", 1), (9, shared + " tail", 0, "t", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, `c``d` string, _kept_id int")
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns and sorted((r[0], r[1]) for r in kept.collect()) == [(3, "a b c d e f"), (5, "g h i j k"), (8, shared)]
    left = substring.rewrite(df)
    assert left.columns == df.columns
    assert sorted(tuple(r) for r in left.collect() if r[0] > 7) == [(8, "", 0, "s", 1), (9, "tail", 0, "t", 1)]
