"""Small tables with the odd cases that every operator must define a result for."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"


def odd_rows(seed: int = 3) -> list[tuple]:
    """(doc_id, text): null, empty and blank texts, one very long one, copies, near copies, shared passages, repeated rows."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "日本", "A", "Don't", "a" * 30, "||", "#!"]
    passages = [" ".join(rnd.choices(vocabulary, k=rnd.randint(20, 90))) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b"), (5, "A  b"), (6, "a " * 300), (7, "b" * 2500), (8, "x " + "b" * 300)]
    for i in range(9, 70):
        parts = [rnd.choice(passages) if rnd.random() < .5 else " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 50))) for _ in range(rnd.randint(1, 6))]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(parts)))
    base = rnd.choices(vocabulary, k=120)
    for i in range(70, 90):
        words = list(base)
        for _ in range(i % 9):
            words[rnd.randrange(120)] = rnd.choice(vocabulary)
        rows.append((i, " ".join(words)))
    rows.append((90, " ".join(rnd.choices(vocabulary, k=20_000))))
    return rows


def frame(spark, rows):
    """With columns whose names clash with those the operators use inside."""
    return spark.createDataFrame([(i, t, "src0", "n", 7, None) for i, t in rows],
                                 "doc_id long, text string, source string, block string, score int, label int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in rows]


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
