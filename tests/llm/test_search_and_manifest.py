"""Lexical search and the Merkle manifest against their plain versions."""

import random

import duckdb
import numpy as np
import pytest

import check_oracle
from adjudica.llm import lexical, merkle
from adjudica.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.llm.helpers import SF, documents, empty

WORDS = [f"w{k}" for k in range(80)] + ["\u00c9", "\u00e9", "Don't", "A-b", "\u65e5\u672c", "x_y"]


def searched(spark, docs, items, k=50):
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, score int, item string")
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, rank int")
    return sorted(map(tuple, lexical.search(d, q, k).collect()), key=str)


def test_search_equals_scoring_everything(spark, monkeypatch):
    rnd = random.Random(2)
    docs = [(i if i % 50 else None, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 60)))) for i in range(400)]
    docs += [(3, None), (4, ""), (5, "-- !"), (6, "w1 " * 5000), (7, "a" * 100_000)] + [(9000 + i, "w1 w2 w3 A") for i in range(120)] + [(9000, "w1 w2 w3 A")] * 3
    items = [(1, "w1 W2 w3 a"), (2, "\u00c9 x nothere"), (3, None), (4, ""), (5, "zzz"), (1, "w1 W2 w3 a"), (6, " ".join(WORDS)), (None, "w5")]
    assert searched(spark, docs, items) == brute.search(docs, items)
    assert searched(spark, docs, items, 3) == brute.search(docs, items, 3)
    # Sketches of four cells give loose bounds, and one item a block many blocks: the result is the same.
    monkeypatch.setattr(lexical, "COORDINATES", 4)
    monkeypatch.setattr(lexical, "ITEMS", 1)
    assert searched(spark, docs, items) == brute.search(docs, items)
    assert searched(spark, [], items) == searched(spark, docs, []) == searched(spark, [(1, None)], items) == []


def test_bounds_are_never_below_scores():
    doc, term, tf, terms = lexical.counted(["a b b c", "", "c d"])
    assert [terms[t] for t in term] == [b"a", b"b", b"c", b"c", b"d"] and tf.tolist() == [1, 2, 1, 1, 1] and doc.tolist() == [0, 0, 0, 2, 2]
    impact, cell = np.array([5, 9, 2, 4, 7]), np.array([0, 1, 1, 1, 0])
    cells = lexical.sketches(doc, impact, cell, 3)
    assert cells[:, :2].tolist() == [[5, 9], [0, 0], [7, 4]]


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, at int, path string")


def manifest(spark, rows):
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in merkle.proven(rows_of(spark, rows)).select(*columns).collect()), key=str)


def test_manifest_of_odd_rows(spark):
    rnd = random.Random(1)
    sources = [None, "", "a", "\u00e9", "b", *["hot"] * 6]
    rows = [(i if rnd.random() > .02 else None, rnd.choice([*sources, f"s{rnd.randrange(40)}"]), rnd.choice(["en", None]), rnd.choice([None, i]),
             rnd.choice([None, "", "x\ny", "\u65e5\u672c\n" * 3, f"t{i}"])) for i in range(2000)]
    rows += rows[5:9] + [(7, "hot", "en", 1, "same\n")] * 300
    assert manifest(spark, rows) == brute.merkle(rows)


@pytest.mark.parametrize("rows", [[(1, "a", None, None, "x\n")], [(1, "a", None, None, "x\n"), (2, "b", None, 3, "y")], [(None, None, None, None, None)] * 4])
def test_small_manifests(spark, rows):
    assert manifest(spark, rows) == brute.merkle(rows)


def test_manifest_of_an_empty_table(spark):
    assert merkle.proven(empty(spark)).count() == 0


def test_steps_fold_to_the_root_of_the_subtree():
    nodes = [merkle.digest_of(str(k)) for k in range(22)]
    for levels in (1, 2, 3):
        steps, top = merkle.steps_within(nodes[:3 ** levels], levels)
        assert {merkle.folded(n, s) for n, s in zip(nodes, steps)} == {top}


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op8_minhash_near_dedup", "op10_quality_rules", "op11_lexical_search", "op12_merkle_manifest"])
def test_sql_agrees(spark, name):
    con = check_oracle.connect(SF)
    df = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    want = check_oracle.canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert check_oracle.canonical(df.columns, [tuple(r) for r in df.collect()]) == want
    assert duckdb and documents(spark)
