"""Byte-level BPE encoding and decoding.

A task cuts its texts into words and keeps the distinct ones of a block of about BLOCK_CHARS characters. Spark's
higher-order functions encode each distinct word once: a fold over its bytes, each written as the symbol of its id, that
merges the adjacent pair of lowest rank until no pair has a rank. The ranks are a literal: an array of small maps, picked
by crc32, because a lookup in one large map would scan it. A word of more than LONG bytes, which is rare, is merged in the task that
cuts it, with a heap in place of the fold, so its time is near-linear. Decoding concatenates the binary pieces of the ids. Words stay with their block, so nothing is
shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adjudica.llm.common import in_rows, texts
from adjudica.llm.pretokens import class_runs, cut, in_slices

BUCKETS = 1 << 16
BLOCK_CHARS = 8 << 20
#: Code point of id 0 when ids are written as characters; above the surrogates, so any vocabulary's ids fit.
FIRST = 0x10000
DONE = "!"
#: Longer words, in bytes, are merged with a heap by the task that cuts them: for the fold their time is quadratic.
LONG = 2048
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def symbol(i: int) -> str:
    """An id as one character; characters order as the ids do."""
    return chr(FIRST + i)


def merge_literal(ranks: dict[bytes, int]) -> Column:
    """array<map<pair, merged and pair>> over all pairs of pieces that make a piece, in symbols.

    Constant folding turns the parsed text into a literal of the plan.
    """
    maps: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                pair = symbol(a) + symbol(b)
                maps[zlib.crc32(pair.encode()) % BUCKETS][pair] = symbol(rank) + pair
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"), ensure_ascii=False)), "array<map<string,string>>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """array<string> of the hex of each id's bytes."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    return F.split(F.lit(",".join(pieces)), ",")


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_word(word: Column, merges: Column) -> Column:
    """Symbols of a word's ids, from the symbols of its bytes.

    Each step of the fold takes the pair of adjacent symbols with the least rank and merges it wherever it stands, left to
    right. A mark at the end says that no pair has a rank, and the remaining steps pass the word on.
    """
    def merged(pair: Column) -> Column:
        return F.try_element_at(F.get(merges, (F.crc32(pair.cast("binary")) % F.lit(BUCKETS)).cast("int")), pair)

    def candidates(s: Column) -> Column:
        short = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: merged(F.substring(s, i, F.lit(2))))
        # In a long word each substring would be sought from its start.
        long = let(F.split(s, ""), lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: merged(F.concat(F.get(c, i - 1), F.get(c, i)))))
        return F.when(F.length(s) <= 64, short).otherwise(long)

    def step(s: Column, _k: Column) -> Column:
        best = let(F.array_min(candidates(s)), lambda v: F.when(v.isNull(), F.concat(s, F.lit(DONE))).otherwise(
            F.replace(s, F.substring(v, 2, 2), F.substring(v, 1, 1))))
        return F.when(F.endswith(s, F.lit(DONE)) | (F.length(s) < 2), s).otherwise(best)

    folded = F.aggregate(F.sequence(F.lit(1), F.length(word) - 1), word, step)
    return F.when(F.endswith(word, F.lit(DONE)), F.rtrim(word, F.lit(DONE))).when(F.length(word) < 2, word).otherwise(F.rtrim(folded, F.lit(DONE)))


def merged_ids(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: of all adjacent pairs the one of least rank, then the leftmost, is merged next.

    The heap holds (rank, start, end of the left piece, end of the right piece); an entry whose pieces have changed is passed over.
    """
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def pair(i: int) -> tuple | None:
        rank = ranks.get(word[i:end[end[i]]]) if i >= 0 and end[i] < n else None
        return None if rank is None else (rank, i, end[i], end[end[i]])

    heap = [p for p in map(pair, range(n)) if p]
    heapify(heap)
    while heap:
        _, i, middle, stop = heappop(heap)
        if end[i] != middle or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
        for p in (pair(before[i]), pair(i)):
            if p:
                heappush(heap, p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i:end[i]]])
        i = end[i]
    return ids


def decode_ids(ids: Column, pieces: Column) -> Column:
    """Bytes of a list of ids: their pieces one after the other."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def blocks(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Rows of about BLOCK_CHARS characters of texts: doc ids, words of each text, which word each is, distinct words.

    A word is written as one symbol per byte, a long one as the symbols of its ids and DONE.
    """
    runs = class_runs()
    of_byte = np.array([symbol(ranks[bytes([b])]).encode("utf-8") for b in range(256)], "S4")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.repeat(runs[1], runs[0])
        ids: list[pa.Array] = []
        words: list[pa.Array] = []
        counts: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            coded = pa.chunked_array(words, pa.binary()).dictionary_encode()
            known = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.binary())
            data = known.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            at = np.frombuffer(known.buffers()[1], np.int32)[known.offset:known.offset + len(known) + 1] if len(known) else np.zeros(1, np.int32)
            spelled = pa.Array.from_buffers(pa.string(), len(known), [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(of_byte[raw].tobytes())])
            lengthy = np.flatnonzero(np.diff(at) > LONG).tolist()
            if lengthy:
                whole = spelled.to_pylist()
                for k in lengthy:
                    whole[k] = "".join(map(symbol, merged_ids(known[k].as_py(), ranks))) + DONE
                spelled = pa.array(whole, pa.string())
            which = np.concatenate([x.indices.to_numpy(zero_copy_only=False) for x in coded.chunks] or [np.zeros(0)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([np.concatenate(counts)], pa.list_(pa.int32())),
                pa.array([which.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), spelled)],
                names=["ids", "counts", "which", "words"])

        for batch in in_rows(batches):
            at = 0
            for part in in_slices(batch.column("text").to_pylist()):
                found, many = cut(part, table)
                ids.append(batch.column("doc_id").slice(at, len(part)))
                words.append(found), counts.append(many.astype(np.int32))
                at += len(part)
                size += sum(map(len, part))
                if size >= BLOCK_CHARS:
                    yield block()
                    ids, words, counts, size = [], [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(packed, "ids array<long>, counts array<int>, which binary, words array<string>")


def encoded_blocks(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Blocks whose words are the symbols of their ids."""
    coded = let(merge_literal(ranks), lambda merges: F.transform("words", lambda w: encode_word(w, merges)))
    return blocks(texts(docs), ranks).select("ids", "counts", "which", coded.alias("words"))


def _rows(batches: Iterator[pa.RecordBatch]):
    """(doc ids, word index, edges of texts in it, symbols of each word) of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            counts = batch.column("counts")[k].values.to_numpy()
            yield (batch.column("ids")[k].values, np.frombuffer(batch.column("which")[k].as_buffer(), np.int32),
                   np.concatenate([[0], np.cumsum(counts)]).tolist(), batch.column("words")[k].values.to_numpy(zero_copy_only=False))


def encode(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and ids (array<int>) of every row; a null or empty text has none. One output row per input row."""
    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, which, edges, words in _rows(batches):
            for d in range(len(ids)):
                flat = [i - FIRST for w in which[edges[d]:edges[d + 1]].tolist() for i in map(ord, words[w])]
                yield pa.RecordBatch.from_arrays([ids.slice(d, 1), pa.array([flat], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encoded_blocks(docs, ranks).mapInArrow(assembled, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with a column of the bytes their ids stand for."""
    return rows.withColumn("decoded", decode_ids(F.col("ids"), piece_literal(ranks)))


def digest(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Number and digest of the ids of every whole text, and the digest of the bytes they decode to.

    Ids are those of the tiktoken library without special tokens, whose strings are ordinary text. A null text is
    empty: no ids, digests of nothing. Repeated rows and ids give a row each; an empty table gives none.
    """
    pieces = {symbol(rank): piece for piece, rank in ranks.items()}
    names = {symbol(rank): str(rank) for rank in ranks.values()}

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, which, edges, words in _rows(batches):
            codes = [" ".join([names[c] for c in w]) for w in words]
            decoded = [b"".join([pieces[c] for c in w]) for w in words]
            many = list(map(len, words))
            words = None
            n, a, b = [], [], []
            for d in range(len(ids)):
                mine = which[edges[d]:edges[d + 1]].tolist()
                n.append(sum([many[w] for w in mine]))
                a.append(hashlib.sha256(" ".join([codes[w] for w in mine]).encode()).hexdigest())
                b.append(hashlib.sha256(b"".join([decoded[w] for w in mine])).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded_blocks(docs, ranks).mapInArrow(assembled, OUT)
