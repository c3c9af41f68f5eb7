"""Plain versions of the operators, each written from its contract, for small tables."""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import math
import re
import zlib

import public_tokenizers
import tiktoken

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@functools.cache
def encoding() -> tiktoken.Encoding:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe(rows):
    out = []
    for i, text in rows:
        ids = encoding().encode_ordinary(text or "")
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    return sorted(out, key=str)


def cover(n, starts, width):
    gone = [False] * n
    for p in starts:
        gone[p:p + width] = [True] * width
    return gone


def substring(rows, width=35):
    words = [[w.encode() for w in WORD.findall(t or "")] for _, t in rows]
    seen = collections.Counter(tuple(w[p:p + width]) for w in words for p in range(len(w) - width + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = cover(len(w), [p for p in range(len(w) - width + 1) if seen[tuple(w[p:p + width])] > 1], width)
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def suffix(rows, width=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        b = (text or "").encode()
        starts = []
        for p in range(len(b) - width + 1):
            if b[p:p + width] in seen:
                starts.append(p)
            seen.add(b[p:p + width])
        gone = cover(len(b), starts, width)
        runs = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def near(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if common and 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                parent[root(x)] = root(y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)], i == least[root(k)]) for k, (i, _) in enumerate(rows))


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(words[p:p + 8]) for p in range(len(words) - 7))
    twice = cover(len(words), [p for p in range(len(words) - 7) if seen[tuple(words[p:p + 8])] > 1], 8)
    failed = len(words) < 20 or 100 * sum(twice) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(twice), failed


def chat(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(said), sha(said))
    return out


def pieces_problems(rows, pieces, limit=2048):
    """Messages on what is wrong with packed pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    bad = []
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    if set(by_doc) != {i for i, _ in rows}:
        bad.append("documents")
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            own = b"".join(x.to_bytes(4, "little") for x in ids[p.start:p.start + p.length])
            if (p.start, p.doc_tokens, p.ids_crc32) != (at, len(ids), zlib.crc32(own)):
                bad.append(("piece", p))
            at += p.length
        if at != len(ids):
            bad.append(("ids", i))
    for name, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            if p.offset != at:
                bad.append(("offset", p))
            at += p.length
        if at > limit:
            bad.append(("length", name))
    return bad


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search(docs, items, k=50):
    def terms(text):
        return [x.translate(ASCII_LOWER) for x in TERM.findall(text or "")]

    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(x for _, c in counted for x in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            if c:
                m = 50 + (50 * sum(c.values()) * n_docs) // length
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10 ** 9 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if x in c)
                scores += [(-s, i is None, i or 0)] if s else []
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    def digest(*parts):
        return sha("".join(parts))

    def leaf(row):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def steps(tree, at):
        for level in tree[:-1]:
            run = level[at - at % 3:at - at % 3 + 3]
            yield at % 3, run[:at % 3] + run[at % 3 + 1:]
            at //= 3

    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = levels([leaf(r) for r in sources[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for k, row in enumerate(sources[s]):
            path = [*steps(trees[s], k), *steps(top, j)]
            shown = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                shown = (*row[:4], row[4].replace("\n", ""))
            at = leaf(shown)
            for place, others in path:
                at = digest(*others[:place], at, *others[place:])
            out.append((row[0], leaf(row), trees[s][-1][0], top[-1][0], digest(*(x for _, others in path for x in others)), at, at == top[-1][0]))
    return sorted(out, key=str)


PRIVATE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))


def private(text):
    """(start, kind, end) of the base spans, by the patterns as they stand in the contract."""
    def valid(kind, found):
        digits = [int(c) for c in re.sub("[^0-9]", "", found)]
        if kind == 1:
            return all(int(p) <= 255 for p in found.split("."))
        if kind == 2:
            doubled = [d if k % 2 == 0 else sum(map(int, str(2 * d))) for k, d in enumerate(digits[::-1])]
            return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), kind, m.end()) for kind, p in enumerate(PRIVATE) for m in p.finditer(text or "") if valid(kind, m.group()))
