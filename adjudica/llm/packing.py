"""Order-preserving packing of documents into token sequences by dynamic programming.

The tokens of a shard's documents, in the order of the table, form one line. Candidate cuts are the ends of documents,
the ends of sentences, and every HARD_STEP tokens where neither comes. With f(j) the least cost of the line up to cut j,

    f(j) = penalty(j) + min over i with c_j - c_i <= limit of f(i) + (limit - (c_j - c_i)),

so the best i has the least f(i) + c_i among the cuts in reach: the head of a monotone queue. A sequence whose length is
a power of two is not padded, which adds a few exact transitions. The penalty of a cut is that of truncating there: none
at a document's end, little at a sentence's, more elsewhere. A shard is an input partition, taken in lines of at most
LINE_TOKENS, so nothing is shuffled and a task holds one line.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.common import in_rows, texts
from adjudica.llm.pretokens import class_runs, cut, in_slices

LIMIT = 2048
HARD_STEP = 256
LINE_TOKENS = 2 << 20
SENTENCE, HARD = 1.0, 16.0
END_ID = 1
#: Words whose ids a task remembers before it starts anew; encoding does not depend on it.
KNOWN_WORDS = 400_000
CODED_CHARS = 4 << 20
POWERS = (128, 256, 512, 1024)
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int = HARD_STEP) -> tuple[np.ndarray, np.ndarray]:
    """(cuts, penalties) of a line, ascending, from 0 to its end; no gap is wider than step."""
    at = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(at)
    extra = (gaps - 1) // step
    first = np.repeat(np.cumsum(extra) - extra, extra)
    hard = np.repeat(at[:-1], extra) + (np.arange(int(extra.sum())) - first + 1) * step
    cuts = np.concatenate([at, hard])
    order = np.argsort(cuts, kind="stable")
    ends = np.minimum(np.searchsorted(doc_ends, at), len(doc_ends) - 1)
    penalty = np.concatenate([np.where(doc_ends[ends] == at, 0.0, SENTENCE), np.full(len(hard), HARD)])
    penalty[0] = 0.0
    return cuts[order], penalty[order]


def best_cuts(cuts: np.ndarray, penalties: np.ndarray, limit: int = LIMIT, powers: tuple[int, ...] = POWERS) -> list[int]:
    """Positions of the cuts that make padding plus penalties least, 0 and the end included."""
    at, cost = cuts.tolist(), penalties.tolist()
    n = len(at)
    f, came = [0.0] * n, [0] * n
    exact: list = [()] * n
    for p in powers:
        k = np.searchsorted(cuts, cuts - p)
        for j in np.flatnonzero((cuts >= p) & (cuts[k] == cuts - p)).tolist():
            exact[j] += (int(k[j]),)
    queue: deque = deque([(0.0, 0)])
    for j in range(1, n):
        c = at[j]
        while at[queue[0][1]] < c - limit:
            queue.popleft()
        value, i = queue[0]
        value += limit - c
        for k in exact[j]:
            if f[k] < value:
                value, i = f[k], k
        value += cost[j]
        f[j], came[j] = value, i
        ahead = value + c
        while queue and queue[-1][0] >= ahead:
            queue.pop()
        queue.append((ahead, j))
    out, j = [at[-1]], n - 1
    while j:
        j = came[j]
        out.append(at[j])
    return out[::-1]


def ragged(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """flat[offsets[w]:offsets[w + 1]] for each w, one after the other."""
    lengths = (offsets[1:] - offsets[:-1])[which]
    total = np.cumsum(lengths)
    at = np.repeat((offsets[:-1][which] - total + lengths).astype(np.int32), lengths)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


def word_encoder(tokenizer_path: str) -> Callable[[bytes], list[int]] | None:
    """Ids of one word by ranks instead of by the list of merges, which is several times faster.

    Only for a byte-level vocabulary whose ids ascend with its merges and begin with the 256 bytes: there both are the
    same. None for any other.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != list(range(256, 256 + len(merged))) or model.get("ignore_merges") or model.get("dropout"):
        return None
    # The printable bytes stand for themselves, the others for the characters from U+0100 on, in order.
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {}
    for token, i in vocab.items():
        if i < 256 + len(merged):
            if not all(c in byte_of for c in token):
                return None
            ranks[bytes(byte_of[c] for c in token)] = i
    if sorted(ranks.values()) != list(range(256 + len(merged))) or not all(bytes([b]) in ranks for b in range(256)):
        return None
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def pack(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: where each starts in its document, its ids (little-endian 32 bit), and its sequence.

    A document's ids are those of the tokenizers library without special tokens, whose strings are ordinary text, and
    end_id. A null or empty text has end_id alone. Each id is in exactly one piece; pieces follow in their sequence
    without a gap; no sequence exceeds limit. Repeated rows and ids are packed one by one; an empty table gives no piece.
    """
    runs = class_runs()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Spark gives a task one core; the library's own threads would take more.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        # In the byte alphabet of these vocabularies a line feed is written U+010A.
        ends_sentence = np.array([(tokenizer.id_to_token(i) or " ")[-1] in ".!?Ċ" for i in range(tokenizer.get_vocab_size())])
        piece = word_encoder(tokenizer_path)
        table = np.repeat(runs[1], runs[0])
        shard = TaskContext.get().partitionId() << 32
        known: dict[bytes, bytes] = {}
        sequences = 0
        ids: list = []
        lengths: list[np.ndarray] = []
        line: list[np.ndarray] = []
        waiting = 0

        def coded(part: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """Ids of the texts one after the other, each with end_id, and how many each has."""
            slices = [cut(s, table) for s in in_slices(part)]
            counts = np.concatenate([c for _, c in slices])
            coded_words = pa.chunked_array([w for w, _ in slices], pa.binary()).dictionary_encode()
            distinct = coded_words.chunk(coded_words.num_chunks - 1).dictionary.to_pylist()
            index = np.concatenate([x.indices.to_numpy() for x in coded_words.chunks])
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = [w for w in distinct if w not in known]
            if piece is not None:
                known.update((w, np.array(piece(w), "<u4").tobytes()) for w in new)
            else:
                for k in range(0, len(new), 8192):
                    part = new[k:k + 8192]
                    for w, e in zip(part, tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                        known[w] = np.array(e.ids, "<u4").tobytes()
            spelled = [*map(known.__getitem__, distinct), np.array([end_id], "<u4").tobytes()]
            offsets = np.cumsum([0, *map(len, spelled)]) // 4
            # The end of each text is one more word.
            which = np.insert(index, np.cumsum(counts), len(spelled) - 1)
            per_word = np.diff(offsets)[which]
            total = np.concatenate([[0], np.cumsum(per_word)])
            stops = np.cumsum(counts + 1)
            return ragged(np.frombuffer(b"".join(spelled), "<u4"), offsets, which), np.diff(np.concatenate([[0], total[stops]]))

        def flush() -> pa.RecordBatch:
            nonlocal sequences, waiting, ids, lengths, line
            tokens, size = np.concatenate(line), np.concatenate(lengths)
            doc_ends = np.cumsum(size)
            cuts, penalties = candidates(doc_ends, np.flatnonzero(ends_sentence[tokens]) + 1)
            chosen = np.array(best_cuts(cuts, penalties, limit), np.int64)
            doc_starts = doc_ends - size
            begin = np.unique(np.concatenate([chosen[:-1], doc_starts]))
            length = np.diff(np.append(begin, len(tokens)))
            doc = np.searchsorted(doc_starts, begin, side="right") - 1
            sequence = np.searchsorted(chosen, begin, side="right") - 1
            raw = np.concatenate([[0], begin[1:] * 4, [len(tokens) * 4]]).astype(np.int64)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(raw.tobytes()), pa.py_buffer(tokens.astype("<u4").tobytes())])
            out = pa.RecordBatch.from_arrays([
                pa.concat_arrays(ids).take(pa.array(doc)), pa.array(begin - doc_starts[doc]), pa.array(length), blobs.cast(pa.binary()),
                pa.array(size[doc]), pa.array(shard + sequences + sequence), pa.array(begin - chosen[sequence])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequences += len(chosen) - 1
            ids, lengths, line, waiting = [], [], [], 0
            return out

        for batch in in_rows(batches, 2048):
            at = 0
            for part in in_slices(batch.column("text").to_pylist(), CODED_CHARS):
                tokens, size = coded(part)
                ids.append(batch.column("doc_id").slice(at, len(part)))
                lengths.append(size), line.append(tokens)
                at += len(part)
                waiting += len(tokens)
                if waiting >= LINE_TOKENS:
                    yield flush()
        if waiting:
            yield flush()

    return texts(docs).mapInArrow(packed, PIECES)


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The pieces with the crc32 of their ids in place of them."""
    return pack(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
