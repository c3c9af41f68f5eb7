"""Chat formatting in budgeted windows.

A turn is written `### role: text </turn>` and a line feed; control strings inside roles and texts are escaped, so the
windows can be read back. Prefix sums of turn tokens choose turn-aligned spans of at most the budget. Every window
starts with the conversation's system turn and with as many turns before its span as the history allows; these
repetitions and all texts but new assistant turns are outside the loss mask.

Conversations are cut into cells of CELL turns, numbered in two steps (counts per stretch of turn numbers, then rows
within a stretch), so a conversation of any length is spread over tasks. A cell receives the turns that its first
history needs from the cell before it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CELL = 256
WINDOWS = "conv_id long, window long, text string, repeated int, loss array<struct<begin:int,stop:int>>"
OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
HEAD, STOP = "### ", " </turn>\n"
_IN_TEXT = re.compile(r"\\|</turn>|#{3,}")
_IN_ROLE = re.compile(r"\\|</turn>|#{3,}|: ")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### (.*?): (.*?) </turn>\n", re.S)


def escape(text: str, control: re.Pattern = _IN_TEXT) -> str:
    """Put a backslash into every control string and before every backslash."""
    def marked(m: re.Match) -> str:
        s = m.group()
        return {"</turn>": "<\\/turn>", ": ": ":\\ "}.get(s) or "".join("\\" + c for c in s)
    return control.sub(marked, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int]:
    """A turn as written, and where its text begins in it."""
    head = HEAD + escape(role, _IN_ROLE) + ": "
    return head + escape(text) + STOP, len(head)


def read_back(window: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a window."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(window)]


def _counted(turns: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Turns with the number of tokens they take as written."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            written = [formatted(r, t)[0] for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(encoding.encode_ordinary(w)) for w in written], pa.int64())],
                                             names=[*batch.schema.names, "tokens"])

    return turns.mapInArrow(counted, "conv_id long, turn long, role string, text string, tokens long")


def _same(*names: str) -> Column:
    """Null-safe equality of columns of the frames l and r."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}"))
    return out


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns with their number in the conversation, by turn, role and text; a null turn comes first."""
    rows = turns.withColumn("stretch", F.floor(F.col("turn") / CELL))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "stretch").agg(F.count("*").alias("size"))
    starts = sizes.select("conv_id", "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text")
    numbered = rows.withColumn("row", F.row_number().over(inside)).alias("l").join(starts.alias("r"), _same("conv_id", "stretch"))
    return numbered.select("l.conv_id", "l.role", "l.text", "l.tokens", (F.col("r.base") + F.col("l.row") - 1).alias("number")).withColumn(
        "cell", F.floor(F.col("number") / CELL))


def windows(turns: DataFrame, tokenizer_path: str, pattern: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """The windows of all conversations: text, how many turns at its start are repeated, and the loss spans in code points.

    Null roles and texts are empty. A conversation's system turn is its first one if its role is `system`. A turn that
    does not fit the budget beside the system turn has a window of its own, without history. An empty table has none.
    """
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                         F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = _numbered(_counted(turns, tokenizer_path, pattern))
    later = Window.partitionBy("conv_id", "cell").orderBy(F.col("number").desc())
    own = rows.select("conv_id", "cell", F.lit(2).alias("kind"), "number", "role", "text", "tokens")
    last = rows.groupBy("conv_id").agg(F.max("cell").alias("last"))
    many = rows.withColumn("behind", F.sum("tokens").over(later)).where(F.col("behind") <= history).alias("l").join(last.alias("r"), _same("conv_id"))
    tail = many.where("l.cell < r.last").select("l.conv_id", (F.col("l.cell") + 1).alias("cell"), F.lit(1).alias("kind"), "l.number", "l.role", "l.text", "l.tokens")
    first = rows.where("number = 0 and role = 'system'").alias("l").join(last.where("last > 0").alias("r"), _same("conv_id"))
    system = first.select("l.conv_id", F.explode(F.sequence(F.lit(1), F.col("r.last"))).alias("cell"), F.lit(0).alias("kind"), "l.number", "l.role", "l.text", "l.tokens")
    # A system turn close to its cell's end is there as history too; once is enough.
    cells = own.unionByName(tail.where("number > 0 or role <> 'system'")).unionByName(system)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "cell", "kind", "number", "role", "text", "tokens")]
            for conv, cell, *rest in zip(*columns):
                if waiting and unit != (conv, cell):
                    yield written(unit, waiting)
                    waiting = []
                unit = (conv, cell)
                waiting.append(rest)
        if waiting:
            yield written(unit, waiting)

    def written(unit: tuple, cell_rows: list) -> pa.RecordBatch:
        conv, cell = unit
        start = next(k for k, r in enumerate(cell_rows) if r[0] == 2)
        fixed = next((r for r in cell_rows if r[1] == 0 and r[2] == "system"), None)
        reserved = fixed[4] if fixed else 0
        turns_here = [r for r in cell_rows if r is not fixed]
        at = start - (1 if fixed and fixed[0] == 0 else 0)
        sums = [0]
        for r in turns_here:
            sums.append(sums[-1] + r[4])
        out: dict[str, list] = {"conv_id": [], "window": [], "text": [], "repeated": [], "loss": []}
        fresh = fixed is not None and fixed[0] == 2
        while at < len(turns_here) or fresh:
            # Turns at..stop are new; turns since..at are repeated.
            stop = at
            since = at
            while since > 0 and sums[at] - sums[since - 1] <= history:
                since -= 1
            if at < len(turns_here):
                while since < at and reserved + sums[at + 1] - sums[since] > budget:
                    since += 1
                stop = at + 1
                while stop < len(turns_here) and reserved + sums[stop + 1] - sums[since] <= budget:
                    stop += 1
            text, loss, repeated = "", [], 0
            for r, new in [*([(fixed, fresh)] if fixed else []), *((r, False) for r in turns_here[since:at]), *((r, True) for r in turns_here[at:stop])]:
                piece, head = formatted(r[2], r[3])
                repeated += not new
                if new and r[2] == "assistant":
                    loss.append({"begin": len(text) + head, "stop": len(text) + len(piece) - len(STOP)})
                text += piece
            for name, value in (("conv_id", conv), ("window", (cell << 32) + len(out["text"])), ("text", text), ("repeated", repeated), ("loss", loss)):
                out[name].append(value)
            at, fresh = stop, False
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([
            ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()),
            ("loss", pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])))]))

    return (cells.repartition("conv_id", "cell").sortWithinPartitions("conv_id", "cell", "kind", "number", "role", "text").mapInArrow(packed, WINDOWS))


def digest(made: DataFrame) -> DataFrame:
    """What the windows say, read back from their text and masks: one row per conversation.

    A digest runs over a whole conversation, so its windows pass through one task in order; the task holds one window and
    two hash states at a time.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_conv: list = []

        def closed() -> pa.RecordBatch:
            conv, turns, said, chars, loss, written = open_conv
            return pa.RecordBatch.from_pydict(
                {"conv_id": [conv], "n_turns": [turns], "turns_sha256": [said.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()],
                 "formatted_chars": [written]}, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                                                  ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for batch in batches:
            for conv, text, repeated, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "repeated", "loss"))):
                if open_conv and open_conv[0] != conv:
                    yield closed()
                    open_conv = []
                if not open_conv:
                    open_conv = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text)[repeated:]:
                    open_conv[1] += 1
                    open_conv[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    target = unescape(text[span["begin"]:span["stop"]])
                    open_conv[3] += len(target)
                    open_conv[4].update(target.encode("utf-8", "surrogatepass"))
                open_conv[5] += len(text)
        if open_conv:
            yield closed()

    return made.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read, OUT)
