"""Likeness of long texts rests on all their anchors."""

import random
import string

from adjudica.llm import syncmers


def letters(rnd, n):
    return "".join(rnd.choices(string.ascii_lowercase, k=n))


def plain(a, b):
    """From the contract: common anchors by place in a, longest ascent of their places in b."""
    a, b = dict(a.items()), dict(b.items())
    places = [b[h] for h in sorted(a.keys() & b.keys(), key=a.get)]
    best = []
    for k, p in enumerate(places):
        best.append(1 + max([best[j] for j in range(k) if places[j] < p], default=0))
    return 2 * max(best, default=0) / (len(a) + len(b))


def test_one_changed_paragraph_and_one_shared_passage_are_seen():
    rnd = random.Random(12)
    text = letters(rnd, 120_000)
    passage = text[50_000:50_600]
    for at in range(0, 120_000, 20_000):
        own, changed = syncmers.anchors([text, text[:at] + letters(rnd, 100) + text[at + 100:]])
        assert 0.99 < syncmers.likeness(own, changed) < 1
    own, other = syncmers.anchors([text, letters(rnd, 60_000) + passage + letters(rnd, 60_000)])
    assert 0.002 < syncmers.likeness(own, other) < 0.01


def test_likeness_follows_the_contract():
    rnd = random.Random(13)
    parts = [letters(rnd, 300) for _ in range(8)]
    for _ in range(30):
        a, b = syncmers.anchors(["".join(rnd.choices(parts, k=6)) for _ in range(2)])
        assert syncmers.likeness(a, b) == plain(a, b)
