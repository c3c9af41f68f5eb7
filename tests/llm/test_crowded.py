"""A phrase shorter than a window, with other text around it in every document, is no key of substring and suffix dedup."""

import collections
import random

import pytest

from adjudica.llm import anchors, substring, suffix
from tests.llm import brute
from tests.llm.helpers import found, frame

LIMIT = 1024


def phrase_rows(length, n=1800):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    phrase = " ".join(rnd.choices(words, k=length))
    tails = [" ".join(rnd.choices(words, k=30)) for _ in range(40)]
    rows = []
    for i in range(n):
        head, tail = " ".join(rnd.choices(words, k=rnd.randint(0, 30))), rnd.choice(tails) if i % 3 == 0 else " ".join(rnd.choices(words, k=rnd.randint(0, 30)))
        rows.append((i, f"{head} {phrase} {tail}" if i % 50 else f"{phrase} {tail} {phrase} {tail}"))
    return rows + rows[100:103] + [(None, rows[7][1])]


def few_per_anchor(match):
    def held(batches):
        seen = collections.Counter()

        def passed():
            for batch in batches:
                seen.update(batch.column("anchor").to_pylist())
                assert not seen or max(seen.values()) <= LIMIT, "one anchor gathers the documents"
                yield batch
        yield from match(passed())
    return held


@pytest.mark.parametrize("block_bytes", [12_000, 1 << 22])
def test_substring_of_a_crowded_phrase(spark, block_bytes):
    rows = phrase_rows(32)
    made = anchors.repeated(substring.texts(frame(spark, rows)), substring.word_hashes, substring.window_hashes, few_per_anchor(substring.known_windows),
                            substring._digests, substring.OUT, substring.WIDTH, substring.GRAM, False, block_bytes)
    assert found(made, "doc_id", "n_words", "n_removed", "kept_sha256") == brute.substring(rows)


@pytest.mark.parametrize("block_bytes", [12_000, 1 << 22])
def test_suffix_of_a_crowded_phrase(spark, block_bytes):
    rows = phrase_rows(16)
    made = anchors.repeated(suffix.texts(frame(spark, rows)), suffix.byte_symbols, suffix.span_bytes, few_per_anchor(suffix.shards),
                            suffix._rest_of_bytes, suffix.OUT, suffix.WIDTH, suffix.GRAM, True, block_bytes)
    assert found(made, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.suffix(rows)
