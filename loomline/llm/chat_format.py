"""Chat formatting in budgeted, turn-aligned windows.

A turn is marked as ``<|turn|>role`` line break, text, ``<|end|>``. Control strings in
roles and texts are escaped reversibly (a backslash is doubled, and goes after the first
character of a control string), so no text can close its turn or forge another.

Prefix sums of the turns' token counts choose the windows: each takes the most new turns
that fit the budget, after the conversation's first system turn, which every window after
it retains, and after up to ``history`` of the turns before, repeated as context while
they fit. A turn that exceeds the budget alone is a window of its own, whole. The loss
mask covers assistant texts (with their end mark) of new turns only: repeated targets are
masked.

A conversation of more than ``block`` budgets is cut into blocks by its prefix sums, which
run over sorted ranges of its turns with sums carried from range to range; windows begin
anew at a block, and the turns that its first windows repeat go there too. So no task
holds more of a conversation than a block. Conversations, or blocks, are gathered by a
groupBy of their rows.

Rows are ordered by turn, then role (64 characters of it, in long conversations) and a
digest of the text. A null text, role or turn: empty text, empty role, before all turns.
Repeated rows are turns each. Rows without a conversation id are one conversation with
null id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, lean, stored
from .tokens import byte_bpe_counts

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: What a text must not say unescaped: this template's marks and those of common others.
CONTROL = (OPEN, CLOSE, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and its end mark ends."""
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body) + len(CLOSE)


_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the text's span with its end mark) of the turns in a formatted window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2) + len(CLOSE)) for m in _TURN.finditer(formatted)]


@dataclass(frozen=True)
class Window:
    """turns[first:last] are new; context lists the repeated ones before them."""

    first: int
    last: int
    context: list[int]


def windows(roles: list[str], costs: list[int], budget: int, history: int, begin: int = 0) -> list[Window]:
    """Turn-aligned windows of a run of turns, of which those before ``begin`` can only be repeated. The first system turn is retained by every window after it."""
    total = [0, *accumulate(costs)]
    system = roles.index("system") if "system" in roles else None
    out, at = [], begin
    while at < len(costs):
        kept = [system] if system is not None and system < at else []
        room = budget - sum(costs[i] for i in kept)
        back = at
        while back > max(0, at - history) and back - 1 != system and total[at + 1] - total[back - 1] <= room:
            back -= 1
        last = max(at + 1, bisect_right(total, total[back] + room) - 1)
        out.append(Window(at, min(last, len(costs)), kept + list(range(back, at))))
        at = out[-1].last
    return out


#: Windows' worth of tokens after which a long conversation's windows begin anew, so that no task holds more of it.
BLOCK = 64
SCHEMA = "window long, text string, loss array<struct<start:int,end:int>>, n_context int, first_turn long, n_turns int, n_tokens long"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_TURN_ROW = "conv long, turn long, role string, tie long, piece string, start int, end int, cost int, row long"


def marked_turns(turns: DataFrame, tokenizer: str, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One stored row per turn: its formatted piece, the span of its text in it, its token count, and a number of the row."""
    rows = turns.select(turns[conv].cast("long").alias("conv"), turns[turn].cast("long").alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = byte_bpe_counts(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
            made = [marked(r, x) for r, x in zip(roles, texts, strict=True)]
            ties = [xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in texts]
            n = len(made)
            columns = [pa.array(ties, pa.int64()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()), pa.array([bpe.count(m[0]) for m in made], pa.int32()), pa.array(range(row, row + n), pa.int64())]
            row += n
            yield pa.record_batch([*batch.columns[:3], *columns], names=[c.split()[0] for c in _TURN_ROW.split(", ")])

    return stored(rows.mapInArrow(lean(run), _TURN_ROW))


def _long_parts(turns: DataFrame, block: int, history: int) -> DataFrame:
    """turns of long conversations -> (row, place, block, new): the blocks that need each row, and its place in the conversation.

    Rows are sorted by ranges, so one conversation's turns may lie in many partitions; prefix sums run within each, and sums of whole partitions carry over.
    """
    order = ["conv", "turn", "role", "tie", "row"]
    light = turns.select("conv", "turn", F.left("role", F.lit(64)).alias("role"), "tie", "row", "cost", (F.col("role") == "system").alias("system"))
    light = light.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chat, place, tokens = TaskContext.get().partitionId(), object(), 0, 0
        for batch in batches:
            rows = []
            for c, cost in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if c != chat:
                    chat, place, tokens = c, 0, 0
                rows.append((part, place, tokens))
                place, tokens = place + 1, tokens + cost
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64())]
            yield pa.record_batch([batch.column(0), batch.column(4), batch.column(5), batch.column(6), *columns], names=["conv", "row", "cost", "system", "part", "place", "before"])

    local = stored(light.mapInArrow(lean(run), "conv long, row long, cost int, system boolean, part int, place long, before long"))
    parts = local.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    w = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("conv", "part", F.sum("n").over(w).alias("places"), F.sum("cost").over(w).alias("tokens")).where("places > 0")  # at most a row a partition
    carried = F.broadcast(stored(carried.withColumnsRenamed({"conv": "c", "part": "p"})))
    r = local.join(carried, local["conv"].eqNullSafe(carried["c"]) & (local["part"] == carried["p"]), "left")
    r = stored(r.select("conv", "row", "system", (F.col("place") + F.coalesce("places", F.lit(0))).alias("place"), F.floor((F.col("before") + F.coalesce("tokens", F.lit(0))) / F.lit(block)).alias("block")))
    first = r.groupBy("conv", "block").agg(F.min("place").alias("first")).where("block > 0")
    system = r.where("system").groupBy("conv").agg(F.min("place").alias("system")).withColumnRenamed("conv", "c")
    need = first.join(system, first["conv"].eqNullSafe(system["c"]), "left")
    back = F.transform(F.sequence(F.lit(1), F.lit(max(1, history))), lambda j: F.col("first") - j) if history else F.array().cast("array<bigint>")
    before = F.array_distinct(F.concat(back, F.when(F.col("system") < F.col("first"), F.array("system")).otherwise(F.array().cast("array<bigint>"))))
    need = need.select(F.col("conv").alias("c"), F.col("block").alias("to"), F.explode(before).alias("at"))
    context = r.join(need, r["conv"].eqNullSafe(need["c"]) & (r["place"] == need["at"])).select("row", "place", F.col("to").alias("block"), F.lit(False).alias("new"))
    return r.select("row", "place", "block", F.lit(True).alias("new")).unionAll(context)


def format_chats(turns: DataFrame, tokenizer: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 1024, history: int = 2, block: int = BLOCK) -> DataFrame:
    """One row per window: conv, window, text, loss spans (code points of the formatted text), n_context, first_turn, n_turns, n_tokens.

    tokenizer: path of a byte-level BPE's ``tokenizers`` file on every executor. window: ascending in a conversation, from 0; from block to block it leaps. n_context turns are repeated; n_turns follow them, from first_turn on.
    """
    made = marked_turns(turns, tokenizer, conv, turn, role, text)
    cut = budget * block
    long = stored(made.groupBy("conv").agg(F.sum("cost").alias("cost")).where(F.col("cost") > cut).select(F.col("conv").alias("long_conv")))
    side = F.broadcast(long) if long.count() <= BROADCAST_IDS else long
    is_long = made["conv"].eqNullSafe(side["long_conv"])
    what = ["conv", "turn", "role", "tie", "piece", "start", "end", "cost", "place", "block", "new"]
    rows = made.join(side, is_long, "left_anti").withColumns({"place": F.lit(0).cast("long"), "block": F.lit(0).cast("long"), "new": F.lit(True)}).select(*what)
    if long.limit(1).count():
        those = made.join(side, is_long, "left_semi")
        rows = rows.unionAll(those.join(_long_parts(those, cut, history), "row").select(*what))
    rows = rows.select("conv", "block", F.struct("place", "turn", "role", "tie", "piece", "start", "end", "cost", "new").alias("x"))
    chats = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    chats = chats.select("conv", "block", *[F.col(f"x.{c}").alias(c) for c in ("place", "role", "piece", "start", "end", "cost", "new")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), _LOSS, pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        names = ["conv", "window", "text", "loss", "n_context", "first_turn", "n_turns", "n_tokens"]
        for batch in batches:
            for i in range(batch.num_rows):
                chat, number, places, roles, pieces, starts, ends, costs, new = (c[i].as_py() for c in batch.columns)
                begin, out = new.index(True), []
                for w, span in enumerate(windows(roles, costs, budget, history, begin)):
                    parts, loss, at = [], [], 0
                    for j in [*span.context, *range(span.first, span.last)]:
                        if j >= span.first and roles[j] == "assistant":
                            loss.append({"start": at + starts[j], "end": at + ends[j]})
                        parts.append(pieces[j])
                        at += len(pieces[j])
                    cost = sum(costs[j] for j in span.context) + sum(costs[span.first : span.last])
                    first = places[begin] + span.first - begin
                    out.append((chat, (number << 32) + w, "".join(parts), loss, len(span.context), first, span.last - span.first, cost))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return chats.mapInArrow(lean(run), f"conv long, {SCHEMA}").withColumnRenamed("conv", conv)


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From windows alone, one row per turn: (conv, window, nth, role, text, loss); repeated turns are left out. loss: whether the mask covers the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chat, window, text, loss, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                masked = {(x["start"], x["end"]) for x in loss}
                turns = read_turns(text)[context:]
                rows = [(chat, window, i, role, x, (start, end) in masked) for i, (role, x, start, end) in enumerate(turns)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv", "window", "nth", "role", "text", "loss"])

    w = formatted.select(F.col(conv).cast("long").alias("conv"), "window", "text", "loss", "n_context")
    return w.mapInArrow(lean(run), "conv long, window long, nth int, role string, text string, loss boolean").withColumnRenamed("conv", conv)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """From windows alone, one row per conversation: (conv, n_turns, turns_sha256 of role, line break, text, line break per turn, loss_chars and loss_sha256 of all text under the mask, unescaped, formatted_chars).

    A conversation's windows come to one task in order and pass it as a stream, which is what a digest of all of them takes; a window is all that is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, n, chars, lost, said, learnt = None, 0, 0, 0, None, None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 6
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for chat, text, loss, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if said is None or chat != now:
                    if said is not None:
                        done.append((now, n, said.hexdigest(), lost, learnt.hexdigest(), chars))
                    now, n, chars, lost, said, learnt = chat, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for role, x, _, _ in read_turns(text)[context:]:
                    said.update(f"{role}\n{x}\n".encode())
                    n += 1
                for span in loss:
                    x = unescape(text[span["start"] : span["end"] - len(CLOSE)])
                    lost += len(x)
                    learnt.update(x.encode())
            yield flush()
            done.clear()
        if said is not None:
            done.append((now, n, said.hexdigest(), lost, learnt.hexdigest(), chars))
        yield flush()

    w = formatted.select(F.col(conv).cast("long").alias("conv"), "window", "text", "loss", "n_context")
    w = w.repartition("conv").sortWithinPartitions("conv", "window").select("conv", "text", "loss", "n_context")
    return w.mapInArrow(lean(run), "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)
