"""Rules, classifier, language and the pipeline."""

import random
import zlib

import numpy as np

import corpus_pipeline
from adjudica.llm import language, quality, rules
from adjudica.llm.queries import QUERIES
from adjudica.llm.stats import TextStats
from tests.llm import brute
from tests.llm.helpers import SF, documents, empty, found, frame, odd_rows

COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_base_counts(spark):
    rows = odd_rows() + [(201, "one two three four five six seven eight nine ten " * 5), (202, "x\n \nx\ny\ny"), (None, "a b")]
    rows += rows[30:32]
    want = sorted(((i, *brute.base_counts(t)) for i, t in rows), key=str)
    assert found(rules.judge(frame(spark, rows)), *COUNTS) == want
    assert rules.judge(empty(spark)).count() == rules.filter_documents(empty(spark)).count() == 0


def test_verdict_does_not_depend_on_the_order_of_rules(spark):
    rows = odd_rows()
    plain = {i for i, t in rows if not any(r.broken(TextStats(t)) for r in rules.RULES)}
    measured = rules.measure(frame(spark, rows))
    assert {m[0] for m in measured} == {r.name for r in rules.RULES}
    costs = {name: rate / max(cost, 1e-9) for name, cost, rate in measured}
    gains = [costs[r.name] for r in rules.ordered(rules.RULES, measured)]
    assert gains == sorted(gains, reverse=True)
    for order in (rules.RULES, rules.RULES[::-1]):
        assert {i for i, t in rows if rules.passes(TextStats(t), order)} == plain
    assert {r.doc_id for r in rules.filter_documents(frame(spark, rows)).collect()} == plain
    assert {r.doc_id for r in rules.judge(frame(spark, rows)).where("kept").collect()} == plain


def test_rules_keep_labelled_good_texts(spark):
    got = QUERIES["op10_quality_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed and quality = 1")
    assert got.where("kept").count() == got.count() > 0


def test_forest_walk_equals_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x, y, trees=20, depth=3)
    for row, s in zip(x[:30], forest.scores(x[:30])):
        margin = forest.bias
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            margin += forest.value[node]
        assert abs(s - 1 / (1 + np.exp(-margin))) < 1e-12
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95
    none = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert none.scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_query_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_of_odd_rows(spark):
    df = frame(spark, [*odd_rows(), (None, None), (4, "a b")])
    labels = spark.createDataFrame([(9, 1), (10, 0), (11, None), (None, 1)], "doc_id long, quality int")
    assert quality.classify(spark, df, labels).count() == df.count()
    assert quality.classify(spark, empty(spark), labels).count() == 0
    assert quality.classify(spark, df, labels.limit(0)).where("score = 0.5").count() == df.count()


def test_language_query_is_right_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op6_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95


def test_language_of_odd_rows(spark):
    rows = [(i, "der die und", "de") for i in range(20)] + [(20 + i, "the of and", "en") for i in range(20)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "12 !", None), (53, "the the", None), (None, "die die", "de"), (3, "der die und", "de")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r.lang_pred for r in language.predict(df, language.train(df)).collect()}
    assert [got[i] for i in (50, 51, 52, 53, None, 3)] == ["und", "und", "und", "en", "de", "de"]
    bare = df.where("doc_id < 0")
    assert language.predict(bare, language.train(bare)).count() == 0
    assert {r.lang_pred for r in language.predict(df, language.train(bare)).collect()} == {"und"}


def test_language_scores_equal_dense_kernel_ridge(spark):
    """With every taught text a landmark the scores are those of kernel ridge regression on sets of n-grams."""
    rnd = random.Random(8)
    words = {"aa": "kala mina suro tepa".split(), "bb": "wirk zoft haun kala".split(), "cc": "xiq oouv yee mina".split()}
    rows = [(i, " ".join(rnd.choices(words[lang], k=rnd.randint(2, 9))), lang) for i, lang in enumerate("aa bb cc".split() * 14)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def grams(text):
        return {text[i:i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}

    def kernel(a, b):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    taught = sorted({r for r in rows if fold(r[0], 3) != 1})
    own = [grams(t) for _, t, _ in taught]
    target = np.array([[1.0 if lang == name else -1.0 for name in words] for *_, lang in taught])
    alpha = np.linalg.solve(kernel(own, own) + 1e-2 * len(own) / 100 * np.eye(len(own)), target)
    want = kernel([grams(t) for _, t, _ in rows], own) @ alpha
    model = language.train(df, landmarks=3 * len(own))
    assert model.languages == list(words)
    got = model.scores([language.cells(t) for _, t, _ in rows], model.places())
    assert np.abs(got - want).max() < 0.02


def test_language_of_long_texts_and_repeated_ids(spark):
    rnd = random.Random(9)
    common = {lang: ["".join(rnd.choices(letters, k=rnd.randint(2, 7))) for _ in range(400)] for lang, letters in (("aa", "abcdefghijklmno"), ("bb", "efghijklmnopqrs"))}
    rows = [(i, " ".join(rnd.choices(common[lang], k=60)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(4, " ".join(rnd.choices(common["aa"], k=60)), "aa") for _ in range(300)] + [(4, "qqq rrr", "bb")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, rows_per_language=100, max_rows=150)
    long = [(1000 + k, " ".join(rnd.choices(common[lang], k=180_000)), lang) for k, lang in enumerate(["aa", "bb"])]
    got = language.predict(spark.createDataFrame(long, df.schema), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in long}


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "minhash_near_dedup", "substring_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    ruled = stage["quality_rules"](spark, docs, SF)
    assert {r.doc_id for r in ruled.collect()} == {i for i, t in documents(spark) if rules.passes(TextStats(t), rules.RULES)}
    near = stage["minhash_near_dedup"](spark, ruled, SF)
    kept = [(r.doc_id, r.text) for r in ruled.collect()]
    assert {r.doc_id for r in near.collect()} == {r[0] for r in brute.near(kept) if r[3]}
    cut = stage["substring_dedup"](spark, near, SF)
    assert cut.columns == near.columns == ruled.columns == docs.columns
    want = {r[0]: r[1:] for r in brute.substring([(r.doc_id, r.text) for r in near.collect()])}
    for r in cut.collect():
        words = brute.WORD.findall(r.text)
        assert brute.sha(" ".join(words)) == want[r.doc_id][2] and r.n_chars == len(r.text)


def test_pipeline_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert pieces and all(len(p.ids) == 4 * p.length for p in pieces)


def test_pipeline_of_an_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
