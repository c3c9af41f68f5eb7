"""Encoding, packing, fingerprints and chat windows against brute force."""

import random
import string

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings, strategies as st

from adjudica.llm import bpe, chat, packing, pretokens, syncmers
from adjudica.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.helpers import SF, documents, empty, found, frame, odd_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
LENGTHS, KINDS = pretokens.class_runs()
TABLE = np.repeat(KINDS, LENGTHS)
DIGESTS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
ODD = ["'", "s", "re", "ve", "ll", "l", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "日", " ", " ", "🙂", "\r\n", "'S", "\x1c", "\x85", "Z"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=12).map("".join), max_size=5))
def test_words_follow_the_pattern(texts):
    words, counts = pretokens.cut(texts, TABLE)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert [w.decode() for w in words.to_pylist()] == [w for t in texts for w in pattern.findall(t)]
    assert counts.tolist() == [len(pattern.findall(t)) for t in texts]


def test_bpe_digest(spark):
    rnd = random.Random(1)
    rows = [(i, "".join(rnd.choices(ODD, k=rnd.randint(0, 14)))) for i in range(800)]
    rows += [(901, None), (902, "<|endoftext|>"), (903, "ab" * 400), (904, "".join(rnd.choices("etaoinsr", k=1500))), (905, " " * 300), (906, "日本語" * 100)]
    rows += [(1000 + i, "".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(1, 30)))) for i in range(500)]
    rows.append(rows[5])
    assert found(bpe.digest(frame(spark, rows), bpe.read_ranks(RANKS)), *DIGESTS) == brute.bpe(rows)


def test_bpe_of_very_long_words(spark):
    rnd = random.Random(2)
    kinds = ["abcdefghijklmnopqrstuvwxyz", "ab", "a", "éa日", "etaoinshrdlu"]
    rows = [(k, "".join(rnd.choices(kind, k=150_000))) for k, kind in enumerate(kinds)]
    rows += [(10 + n, "x " + "".join(rnd.choices(kinds[4], k=bpe.LONG - 2 + n)) + " tail") for n in range(5)]
    rows.append((20, "".join(rnd.choices(kinds[0], k=1_000_000)) + "!!"))
    assert found(bpe.digest(frame(spark, rows), bpe.read_ranks(RANKS)), *DIGESTS) == brute.bpe(rows)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_heap_and_plain_merges_agree(word):
    ranks = bpe.read_ranks(RANKS)
    parts = [bytes([b]) for b in word]
    while (best := min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)):
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert bpe.merged_ids(word, ranks) == [ranks[p] for p in parts]


def test_bpe_round_trip(spark):
    ranks = bpe.read_ranks(RANKS)
    rows = odd_rows()[:40]
    back = bpe.decode(bpe.encode(frame(spark, rows), ranks), ranks)
    got = {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in back.collect()}
    for i, text in rows:
        assert got[i] == (brute.encoding().encode_ordinary(text or ""), (text or "").encode())


def test_bpe_query_and_empty_table(spark):
    assert found(QUERIES["op1_byte_level_bpe"](spark, SF), *DIGESTS) == brute.bpe(documents(spark))
    assert bpe.digest(empty(spark), bpe.read_ranks(RANKS)).count() == 0


def test_best_cuts_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(100):
        ends = np.unique(np.cumsum(rng.integers(1, 6, rng.integers(1, 5))))
        cuts, penalties = packing.candidates(ends, np.unique(rng.integers(1, ends[-1] + 1, 3)), step=3)
        assert cuts[0] == 0 and cuts[-1] == ends[-1] and np.diff(cuts).max() <= 3
        price = dict(zip(cuts.tolist(), penalties.tolist()))

        def cost(chosen):
            return sum(price[b] + (0 if b - a in (2, 4) else 8 - (b - a)) for a, b in zip(chosen, chosen[1:]))

        middle = cuts[1:-1].tolist()
        ways = ([0, *(c for k, c in enumerate(middle) if m >> k & 1), int(ends[-1])] for m in range(1 << len(middle)))
        best = min(cost(w) for w in ways if max(b - a for a, b in zip(w, w[1:])) <= 8)
        assert cost(packing.best_cuts(cuts, penalties, 8, (2, 4))) == best


def test_packing(spark):
    rows = odd_rows() + [(901, "<|endoftext|> x."), (902, "z" * 9000)]
    pieces = packing.digest(frame(spark, rows).coalesce(2), JSON).collect()
    assert not brute.pieces_problems(rows, pieces)


def test_packing_query_pads_little(spark):
    pieces = QUERIES["op9_packing"](spark, SF).collect()
    assert not brute.pieces_problems(documents(spark), pieces)
    lengths = {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.05 * sum(lengths.values())
    assert packing.pack(empty(spark), JSON).count() == 0


def expected_fingerprints(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        changed = syncmers.edited(text, after)
        own, other, following = syncmers.anchors([text]) + syncmers.anchors([changed]) + syncmers.anchors([after])
        out.append((i, len(text), brute.sha(changed), syncmers.written_as(own), syncmers.written_as(other), syncmers.likeness(own, other), syncmers.likeness(own, following)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [1500, 1 << 25])
def test_fingerprints(spark, bucket_bytes):
    rows = [r for r in odd_rows() if r[0] != 90] + [(5, "dup"), (5, "dup"), (None, "lost"), (None, None)]
    made = syncmers.digest(frame(spark, rows), bucket_bytes)
    assert found(made, *made.columns) == expected_fingerprints(rows)


def test_fingerprint_properties(spark):
    assert syncmers.digest(empty(spark)).count() == 0
    made = {r.doc_id: r for r in QUERIES["op4_syncmer_fingerprints"](spark, SF).collect()}
    texts = dict(documents(spark))
    same = {}
    for i, r in made.items():
        assert same.setdefault(texts[i], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and syncmers.written_as(syncmers.read_from(r.fingerprint)) == r.fingerprint
        own, changed = syncmers.read_from(r.fingerprint), syncmers.read_from(r.edited_fingerprint)
        assert r.near_edited == syncmers.likeness(own, changed)
    assert np.mean([r.near_edited for r in made.values()]) > 0.6 > 0.1 > np.median([r.near_next for r in made.values()])


def test_anchors_are_context_free():
    rnd = random.Random(4)
    middle = "".join(rnd.choices(string.ascii_lowercase, k=400))
    for head in ("", "x", "yy zz"):
        found_at = syncmers._anchors_of_slice([head + middle])[0]
        plain = syncmers._anchors_of_slice([middle])[0]
        assert sum(found_at.get(h) == p + len(head) for h, p in plain.items()) > 0.8 * len(plain)


PARTS = ["hello", "\\", "</turn>", "### x: y", "####", "a: b", " ", "\n", "é", "### Assistant: </turn> ok", " </turn", "\\/"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=4).map("".join), st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=5))
def test_turns_read_back(turns):
    assert chat.read_back("".join(chat.formatted(r, t)[0] for r, t in turns)) == turns


def conversations():
    rnd = random.Random(6)
    rows = []
    for c in range(24):
        for k in range(700 if c == 0 else rnd.choice([1, 2, 5, 30])):
            role = "system" if k == 0 and c % 2 else rnd.choice(["user", "assistant", "tool: x", None])
            rows.append((c if c != 23 else None, k, role, None if rnd.random() < .1 else "".join(rnd.choices(PARTS, k=rnd.choice([0, 1, 5, 60, 600 if c % 5 == 0 else 9])))))
    return rows + rows[3:5]


def test_chat_windows(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(df, RANKS, public_tokenizers.PATTERN).cache()
    got = {r.conv_id: tuple(r)[:5] for r in chat.digest(made).collect()}
    assert got == brute.chat(rows)
    for w in made.collect():
        turns = chat.read_back(w.text)
        fits = len(brute.encoding().encode_ordinary(w.text)) <= 1024
        assert fits or len(turns) - w.repeated <= 1 or (len(turns) == 2 and turns[0][0] == "system")
        for span in w.loss:
            assert any(r == "assistant" and t == chat.unescape(w.text[span.begin:span.stop]) for r, t in turns[w.repeated:])


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "\\### Assistant: </turn> ok"
    want = brute.chat(rows + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)])
    got = {r.conv_id: tuple(r)[:5] for r in QUERIES["op7_chat_formatting"](spark, SF).collect()}
    assert got == want
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.windows(none, RANKS, public_tokenizers.PATTERN)).count() == 0


def test_anchors_are_closed_syncmers():
    """Each K-mer judged by itself: the least of its S-mers' hashes stands first or last."""
    def hash_of(part):
        codes = np.array([ord(c) for c in part], np.uint64)
        return int(syncmers.gram_hashes(syncmers.mixed(codes + np.uint64(1)), len(part))[0])

    rnd = random.Random(21)
    for text in ("".join(rnd.choices("abcd \u00e9\u65e5", k=rnd.choice([16, 17, 40, 700]))) for _ in range(12)):
        first = {}
        for p in range(len(text) - syncmers.K + 1):
            kmer = text[p:p + syncmers.K]
            small = [hash_of(kmer[q:q + syncmers.S]) for q in range(syncmers.K - syncmers.S + 1)]
            if min(small) in (small[0], small[-1]):
                first.setdefault(hash_of(kmer) >> 32, p)
        got = dict(syncmers.anchors(["x" * 40, text])[1].items())
        assert got == first or not first and len(got) == 1
        # All of them are written, in order.
        assert [h for h, _ in sorted(got.items(), key=lambda x: x[1])] == np.frombuffer(
            __import__("base64").b64decode(syncmers.written_as(syncmers.anchors([text])[0])), "<u4").tolist()
