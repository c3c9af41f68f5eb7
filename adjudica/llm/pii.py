"""Personal data by base patterns and a skip-chain conditional random field.

The base patterns find e-mail and IP addresses, card and phone numbers. What they lose, a card number that runs into the
next number, a phone number that is followed by another, an address named again in another spelling, the field adds.

Its nodes are the tokens (runs between blanks) that hold a digit or an `@`; every other token is outside by definition,
and stands as a fixed neighbour. Labels are outside, or begin or continue one of the four kinds. Neighbouring tokens share
a transition potential; distant tokens of one text that repeat or resemble each other (equal letters and digits) share a
potential on their kinds, one edge per token, to the occurrence before it. Tokens under a base span are observed. Loopy
belief propagation passes messages along all edges of the document, so that the label of one mention reaches the others.

Weights are fitted by pseudo-likelihood on windows of tokens that the base patterns label, with echoes of their mentions
and mentions that run into each other.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import in_rows, texts

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

OUT = 0
LABELS = 1 + 2 * len(KINDS)
KIND_OF = np.array([0] + [k for k in range(1, len(KINDS) + 1) for _ in range(2)])
MARK = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
BLANKS = " \t\n\x0b\x0c\r"
CORE = re.compile(r"[A-Za-z0-9+(].*[A-Za-z0-9)]|[A-Za-z0-9]", re.S)
WINDOW_TOKENS = 64
ROUNDS, DAMPING = 12, 0.5
#: Beliefs below this stay outside.
SURE = 0.5
#: Tokens of one graph, unless one text has more, and rows of one matrix.
GRAPH_TOKENS, PIECE = 16_384, 16_384
OUT_COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each `@` in time linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in EMAIL_LOCAL:
            begin -= 1
        found = EMAIL_DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield begin, end
        else:
            end = max(end, at)
        at = text.find("@", max(end, at + 1))


def valid_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def valid_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def valid_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, by start and then kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    for kind, pattern, valid in ((1, IP, valid_ip), (2, CARD, valid_card), (3, PHONE, valid_phone)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the tokens that hold a digit or an `@`."""
    out, end = [], 0
    for m in MARK.finditer(text):
        begin = m.start()
        while begin > end and text[begin - 1] not in BLANKS:
            begin -= 1
        end = m.end()
        out.append((begin, end))
    return out


def bucket(n: int) -> int:
    return bisect_left((0, 1, 2, 3, 4, 6, 7, 8, 11, 13, 15, 16, 19), n)


#: Numbers of the features of one token alone, and of what stands before and after it.
SHAPES = 14
DIGITS = SHAPES
NEAR = DIGITS + 14
FEATURES = NEAR + 10


def shape(token: str) -> tuple[list[int], int]:
    """(features of a token alone, its shape as a neighbour sees it)."""
    found = CORE.search(token)
    core = found.group() if found else token
    digits = digits_of(core)
    plain = core.isascii() and core.isdigit()
    numeric = bool(digits) and all(c in "0123456789.-()+ " for c in core)
    dotted = bool(re.fullmatch(r"[0-9]+(\.[0-9]+)+", core))
    found = [0, DIGITS + bucket(len(digits))]
    signs = (
        "@" in core, "@" in core and "." in core.rpartition("@")[2], dotted and core.count(".") == 3 and valid_ip(core), dotted,
        core.startswith("+"), core.startswith("(") and core.endswith(")"), numeric and "-" in core, plain,
        valid_card(core) and all(c in "0123456789-" for c in core), bool(digits) and not numeric and "@" not in core, "=" in token or '"' in token,
        numeric and not plain and not dotted, core.startswith("+") and len(digits) >= 9)
    found += [k + 1 for k, sign in enumerate(signs) if sign]
    seen = 1 if core.startswith("+") else 2 if signs[5] else 3 if numeric else 4
    return found, seen


def key_of(token: str) -> str | None:
    """What repeated or similar tokens have in common: their letters and digits, of which four are digits or one is an `@`."""
    letters = "".join(c for c in token if c.isalnum()).lower()
    return letters if len(letters) >= 5 and ("@" in token or len(digits_of(token)) >= 4) else None


@dataclass
class Graph:
    """Nodes of some texts: features, observed labels (-1: none), chain and skip edges; place is (text, start, end)."""

    features: list[list[int]] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    place: list[tuple[int, int, int]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    alone: list[tuple[bool, bool]] = field(default_factory=list)

    def add(self, which: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        """The tokens of one text; those under a base span carry its label."""
        own = tokens(text)
        shapes = [shape(text[a:b]) for a, b in own]
        joins = [text[a[1]:b[0]].strip(BLANKS) == "" for a, b in zip(own, own[1:])]
        seen: dict[str, int] = {}
        first = len(self.label)
        labels = observed(text, own, spans)
        for k, (a, b) in enumerate(own):
            before, after = k > 0 and joins[k - 1], k < len(joins) and joins[k]
            node = first + k
            self.features.append(shapes[k][0] + [NEAR + (shapes[k - 1][1] if before else 0), NEAR + 5 + (shapes[k + 1][1] if after else 0)])
            self.label.append(labels[k])
            self.place.append((which, a, b))
            self.alone.append((not before, not after))
            if before:
                self.chain.append((node - 1, node))
            key = key_of(text[a:b])
            if key is not None:
                if key in seen and not (before and seen[key] == node - 1):
                    self.skip.append((seen[key], node))
                seen[key] = node


def observed(text: str, own: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """The label of each token that lies mostly under a base span, else -1."""
    out = [-1] * len(own)
    starts = [a for a, _ in own]
    ends = [b for _, b in own]
    for a, kind, b in reversed(sorted(spans, key=lambda s: s[1])):
        k = bisect_left(ends, a + 1)
        while k < len(own) and starts[k] < b:
            size = sum(c.isalnum() for c in text[starts[k]:ends[k]])
            under = sum(c.isalnum() for c in text[max(starts[k], a):min(ends[k], b)])
            if 5 * under >= 4 * size:
                out[k] = 1 + 2 * kind + any(c.isalnum() for c in text[a:starts[k]])
            k += 1
    return out


@dataclass
class Model:
    """Weights of features, of neighbouring labels, and of the kinds of tokens that a skip edge links."""

    unary: np.ndarray
    step: np.ndarray
    skip: np.ndarray


def one_hot(features: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(features), FEATURES))
    for row, own in enumerate(features):
        x[row, own] = 1.0
    return x


def pieces(n: int) -> Iterator[slice]:
    """Slices of at most PIECE rows, so that a text with very many tokens takes no large matrix."""
    for at in range(0, n, PIECE):
        yield slice(at, min(n, at + PIECE))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def spread(skip: np.ndarray) -> np.ndarray:
    """The potential of kinds as one of labels."""
    return skip[KIND_OF][:, KIND_OF]


def fit(g: Graph, rounds: int = 250, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Weights that make each label likely given its features and the labels around it; no nodes give weights of zero."""
    y = np.maximum(np.array(g.label, np.int64), 0)
    sizes = ((FEATURES, LABELS), (LABELS, LABELS), (len(KINDS) + 1, len(KINDS) + 1))
    weights = [np.zeros(s) for s in sizes]
    if not len(y):
        return Model(*weights)
    x = one_hot(g.features)
    before, after = np.full(len(y), OUT), np.full(len(y), OUT)
    for a, b in g.chain:
        before[b], after[a] = y[a], y[b]
    prev, nxt = np.eye(LABELS)[before], np.eye(LABELS)[after]
    linked = np.zeros((len(y), len(KINDS) + 1))
    for a, b in g.skip:
        linked[b, KIND_OF[y[a]]] += 1
        linked[a, KIND_OF[y[b]]] += 1
    gold = np.eye(LABELS)[y]
    kinds = np.eye(len(KINDS) + 1)[KIND_OF]
    first, second = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes]
    for t in range(1, rounds + 1):
        unary, step, skip = weights
        p = softmax(x @ unary + prev @ step + nxt @ step.T + linked @ skip @ kinds.T)
        off = (gold - p) / len(y)
        from_skip = linked.T @ (off @ kinds)
        grads = [x.T @ off, prev.T @ off + (nxt.T @ off).T, (from_skip + from_skip.T) / 2]
        for k, g_k in enumerate(grads):
            g_k = g_k - decay * weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g_k
            second[k] = 0.999 * second[k] + 0.001 * g_k * g_k
            weights[k] = weights[k] + rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
    return Model(*weights)


def beliefs(g: Graph, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals of all nodes after loopy belief propagation; observed labels are certain.

    Without a cycle the result is exact once messages have crossed the graph.
    """
    n = len(g.label)
    score = np.zeros((n, LABELS))
    for part in pieces(n):
        score[part] = one_hot(g.features[part]) @ model.unary
    left, right = np.array(g.alone, bool).reshape(n, 2).T
    score[left] += model.step[OUT]
    score[right] += model.step[:, OUT]
    label = np.array(g.label, np.int64)
    seen = np.flatnonzero(label >= 0)
    score[seen] = -50.0
    score[seen, label[seen]] = 0.0
    chain, skip = np.array(g.chain, np.int64).reshape(-1, 2), np.array(g.skip, np.int64).reshape(-1, 2)
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    c, s = len(chain), len(skip)
    back = np.concatenate([np.arange(c) + c, np.arange(c), 2 * c + s + np.arange(s), 2 * c + np.arange(s)])
    potentials = np.stack([model.step, model.step.T, spread(model.skip), spread(model.skip).T])
    which = np.repeat(np.arange(4), [c, c, s, s])
    message = np.zeros((len(source), LABELS))
    for _ in range(rounds if len(source) else 0):
        total = score.copy()
        np.add.at(total, target, message)
        fresh = np.zeros_like(message)
        for part in pieces(len(source)):
            cavity = (total[source[part]] - message[back[part]])[:, :, None] + potentials[which[part]]
            top = cavity.max(axis=1)
            sent = top + np.log(np.exp(cavity - top[:, None, :]).sum(axis=1))
            fresh[part] = sent - sent.max(axis=1, keepdims=True)
        message = DAMPING * message + (1 - DAMPING) * fresh if s else fresh
    np.add.at(score, target, message)
    return softmax(score) if n else score


def plausible(kind: int, text: str) -> bool:
    """A check of what the field proposes, on the text alone."""
    digits = len(digits_of(text))
    return ("@" in text, text.count(".") == 3 and digits >= 4, 12 <= digits <= 19, 7 <= digits <= 15)[kind]


def added_spans(g: Graph, found: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the field finds beside the observed ones."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in found]
    if not g.label:
        return out
    belief = beliefs(g, model)
    best = belief.argmax(axis=1)
    kind_mass = np.stack([belief[:, KIND_OF == k].sum(axis=1) for k in range(len(KINDS) + 1)], axis=1)
    joined_to = {b: a for a, b in g.chain}
    run: list[int] = []

    def close() -> None:
        if not run:
            return
        which, a, b = g.place[run[0]][0], g.place[run[0]][1], g.place[run[-1]][2]
        core = CORE.search(found[which][a:b])
        kind = int(KIND_OF[best[run[0]]]) - 1
        if core and plausible(kind, core.group()):
            out[which].append((a + core.start(), kind, a + core.end()))
        run.clear()

    for k in range(len(best)):
        label = best[k]
        sure = g.label[k] < 0 and label != OUT and kind_mass[k, KIND_OF[label]] >= SURE
        goes_on = sure and run and joined_to.get(k) == run[-1] and label % 2 == 0 and KIND_OF[label] == KIND_OF[best[run[-1]]]
        if not goes_on:
            close()
        if sure:
            run.append(k)
    close()
    return out


def echoes(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, str, int]]:
    """(a token under a span, another spelling of it, label): how a later mention of it could look."""
    for a, kind, b in spans:
        word = max(text[a:b].split(), key=len)
        digits = digits_of(word)
        spelled = word.upper() if kind == 0 else "-".join((digits[:-4], digits[-4:])) if kind in (2, 3) else word.replace(".", "-")
        if key_of(word) is not None and key_of(word) == key_of(spelled):
            yield word, spelled, 1 + 2 * kind


def lesson(windows: list[str]) -> Graph:
    """The graph of some windows of text: tokens outside all base spans count as outside.

    Every mention has two more nodes, alone in their place: another spelling of it, linked to it and of its kind; and the
    same shape with other digits, linked to nothing and outside. And every mention runs into the next one of the lesson
    once, as mentions do where the patterns lose them, with both labels known.
    """
    g = Graph()

    def taught(text: str, spans: list[tuple[int, int, int]]) -> None:
        first = len(g.label)
        g.add(0, text, spans)
        g.label[first:] = [max(x, OUT) for x in g.label[first:]]

    said = ""
    last = 0
    for text in windows:
        spans = base_spans(text)
        for a, kind, b in spans:
            here = text[a:b]
            if said:
                taught(f"{said} {here}", [(0, last, len(said)), (len(said) + 1, kind, len(said) + 1 + len(here))])
            said, last = here, kind
        first = len(g.label)
        taught(text, spans)
        named = {}
        for node in range(first, len(g.label)):
            _, a, b = g.place[node]
            named.setdefault(key_of(text[a:b]), node)
        for word, spelled, label in echoes(text, spans):
            origin = named.get(key_of(word))
            other = spelled.translate(str.maketrans("0123456789", "7418529630"))
            for token, linked, gold in ((spelled, True, label), (other, False, OUT)):
                if linked and origin is None:
                    continue
                node = len(g.label)
                g.features.append(shape(token)[0] + [NEAR, NEAR + 5])
                g.label.append(gold)
                g.place.append((0, 0, 0))
                g.alone.append((True, True))
                if linked:
                    g.skip.append((origin, node))
    return g


def train(docs: DataFrame, max_windows: int = 2000) -> Model:
    """Weights from at most max_windows windows of WINDOW_TOKENS tokens, those of least hash among all of the table.

    A window is a stretch of a text around its tokens; the driver receives these windows only.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            out, rank = [], []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                for k in range(0, len(own), WINDOW_TOKENS):
                    part = own[k:k + WINDOW_TOKENS]
                    # An x stands for the plain words between tokens, which end every pattern.
                    said = [text[part[0][0]:part[0][1]][:400]]
                    for (_, b), (a, e) in zip(part, part[1:]):
                        said += [" " if text[b:a].strip(BLANKS) == "" else " x ", text[a:e][:400]]
                    window = "".join(said)
                    out.append(window)
                    rank.append(int.from_bytes(hashlib.blake2b(window.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(rank, pa.int64())], names=["said", "rank"])

    rows = texts(docs).mapInArrow(cut, "said string, rank long").orderBy("rank", "said").limit(max_windows).collect()
    return fit(lesson([r.said for r in rows]))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """The base counts, the digest of the base spans, and all spans of every text.

    n_* and base_sha256 count base spans only; spans holds the base ones and those the field adds. A null text is empty: no
    spans, whose joined string is empty. One row per input row; ids may be null or repeat; an empty table gives no rows.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_rows(batches):
            rows = batch.column("text").to_pylist()
            base = [base_spans(text) for text in rows]
            added: list[list] = []
            g, first = Graph(), 0
            for which, text in enumerate(rows):
                g.add(which - first, text, base[which])
                if len(g.label) >= GRAPH_TOKENS or which == len(rows) - 1:
                    added += added_spans(g, rows[first:which + 1], model)
                    g, first = Graph(), which + 1
            counts = [[sum(k == kind for _, k, _ in spans) for spans in base] for kind in range(len(KINDS))]
            everything = [joined(sorted(b + [s for s in more if not any(s[1] == k and s[0] < e and a < s[2] for a, k, e in b)])) for b, more in zip(base, added)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()), pa.array(everything, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts(docs).mapInArrow(found, OUT_COLUMNS)
