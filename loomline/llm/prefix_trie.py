"""Prefix trie of conversations, built as a Patricia tree from a sort.

Every conversation is a sequence of 64-bit turn hashes. Equal sequences are one item. Items
are sorted by ranges; neighbours in the order share their longest common beginnings, so one
pass over a sorted range with a stack of open points makes the compressed tree: points where
sequences branch or end, leaves among them, and between a point and the one above it an edge
whose nodes have one child and no end each. Aggregates are sums over a point's items
(conversations, leaves, bytes of their texts, bytes of distinct nodes, taken once by each
item's part behind what it shares with the one before), minima, and counts of children.

A point may span several ranges. Each range therefore sees the neighbour's item on either
side and opens every depth that is shared across the border; such points are merged by the
hash of their beginning. So nothing depends on how high the tree is or where ranges end.

At last edges are expanded: a node of an edge has the point's members, and its sum of saved
bytes is the point's and a suffix sum of the edge's bytes, the difference of two prefix sums.

Only as many turns of a long conversation are sorted as it shares with another one that goes
on differently (doubling from CUT); its unique rest is one edge, whatever its length. The
largest thing in one task is one such shared beginning. Turns' places and prefix sums come
from sorted ranges with sums carried over, so a conversation may hold any share of all rows;
the digest of the ids that end at a node is a stream over chunks of text made beforehand.

Defined results: rows without conversation id belong to none; null role or text is empty;
a null turn comes first; rows of one turn are ordered by role, then by the digest of the text;
repeated rows are turns each; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, spread_join, stored

#: Turns of a conversation that are sorted at first.
CUT = 128
#: Characters of a chunk of ids, and depths that one row of an edge is expanded to.
CHUNK, SPAN = 1 << 15, 1 << 12


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place from 1, th, bytes, cum) of every turn: its hash, the bytes of its text, and those up to it. A stored table."""
    tie = F.sha2(F.coalesce(turns[text], F.lit("")), 256)
    rows = turns.where(turns[conv].isNotNull()).select(turns[conv].cast("long").alias("conv"), turns[turn].cast("long").alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), tie.alias("tie"), F.coalesce(F.octet_length(turns[text]), F.lit(0)).cast("long").alias("bytes"))
    order = ["conv", "turn", "role", "tie"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.xxhash64("role", "tie").alias("th"), "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, b = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            run_of = np.repeat(first, np.diff(np.concatenate((first, [len(c)]))))
            place = np.arange(len(c)) - run_of + 1
            cum = np.cumsum(b)
            cum = cum - (cum[run_of] - b[run_of])
            if c[0] == last:  # goes on from the batch before
                k = first[1] if len(first) > 1 else len(c)
                place[:k] += n
                cum[:k] += total
            last, n, total = c[-1], place[-1], cum[-1]
            yield pa.record_batch([*batch.columns, pa.array(np.full(len(c), part, np.int32)), pa.array(place), pa.array(cum)], names=["conv", "th", "bytes", "part", "place", "cum"])

    local = stored(rows.mapInArrow(lean(run), "conv long, th long, bytes long, part int, place long, cum long"))
    parts = local.groupBy("conv", "part").agg(F.max("place").alias("n"), F.max("cum").alias("b"))
    w = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("conv", "part", F.sum("n").over(w).alias("n"), F.sum("b").over(w).alias("b")).where("n > 0")  # at most a row a partition
    r = local.join(F.broadcast(stored(carried)), ["conv", "part"], "left")
    zero = F.lit(0).cast("long")
    return stored(r.select("conv", (F.col("place") + F.coalesce("n", zero)).alias("place"), "th", "bytes", (F.col("cum") + F.coalesce("b", zero)).alias("cum")))


def as_they_are(turns: DataFrame) -> DataFrame:
    """(conv, d, th, cum) of placed turns; the sequences as they were said."""
    return turns.select("conv", F.col("place").alias("d"), "th", "cum")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences that share beginnings: conversation c takes the first h turns of conversation c - c % group, then its own behind its first h; h = crc32(decimal c) % most. -> (conv, d, th, cum) rows, and all ids (conv), those without turns too."""
    first = turns.where(F.col("place") < most).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "th", "bytes", "cum"))).alias("heads"))  # fewer than ``most`` a conversation
    first = stored(first)
    c = first.select("conv", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % most).cast("int").alias("h"), F.col("heads").alias("own"))
    c = c.join(first.select(F.col("conv").alias("base"), "heads"), "base", "left")
    head = F.coalesce(F.slice("heads", 1, F.col("h")), F.array().cast("array<struct<place:bigint,th:bigint,bytes:bigint,cum:bigint>>"))
    last = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, -1)["cum"]).otherwise(F.lit(0).cast("long"))
    c = stored(c.select("conv", "h", head.alias("head"), last(head).alias("head_bytes"), last(F.slice("own", 1, F.col("h"))).alias("own_bytes")))
    heads = c.select("conv", F.explode("head").alias("x")).select("conv", F.col("x.place").alias("d"), F.col("x.th").alias("th"), F.col("x.cum").alias("cum"))
    moved = c.select("conv", "h", (F.size("head") - F.col("h")).cast("long").alias("by"), (F.col("head_bytes") - F.col("own_bytes")).alias("more"))
    tails = spread_join(turns, moved, "conv").where(F.col("place") > F.col("h")).select("conv", (F.col("place") + F.col("by")).alias("d"), "th", (F.col("cum") + F.col("more")).alias("cum"))
    return stored(heads.unionAll(tails)), c.select("conv")


def _told(rows: DataFrame, where: Column | None = None) -> list[Column]:
    """Two independent order-bound hashes of a sequence's rows, which add up in any order."""
    h = [F.xxhash64("th", "d"), F.xxhash64(F.lit(1), "d", "th")]
    return [F.coalesce(F.bit_xor(F.when(where, x) if where is not None else x), F.lit(0).cast("long")).alias(f"x{i}") for i, x in enumerate(h)]


def items(rows: DataFrame, ids: DataFrame, cut: int = CUT) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (conv: the smallest id, n_ends, len, total: bytes, before: bytes before the last turn, seq and cum of the turns that are sorted), and (conv, rep): every id and its sequence's smallest."""
    last = F.max(F.struct("d", "cum"))
    whole = rows.groupBy("conv").agg(*_told(rows), last.alias("last"))
    zero = F.lit(0).cast("long")
    whole = ids.join(whole, "conv", "left").select("conv", *[F.coalesce(x, zero).alias(x) for x in ("x0", "x1")], F.coalesce("last.d", zero).alias("len"), F.coalesce("last.cum", zero).alias("total"))
    whole = stored(whole)
    same = ["x0", "x1", "len"]
    reps = stored(whole.groupBy(*same).agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_ends"), F.min("total").alias("total")))
    members = spread_join(whole.select("conv", *same), reps.select(*same, "rep"), same).select("conv", "rep")
    mine = reps.select(F.col("rep").alias("conv"), "len")

    # a long one is cut where no other sequence shares its beginning
    cuts = mine.where(F.col("len") <= cut).select("conv", F.col("len").alias("cut"))
    open_ = stored(mine.where(F.col("len") > cut))
    while open_.limit(1).count():
        heads = stored(spread_join(rows.where(F.col("d") <= cut), mine.where(F.col("len") >= cut), "conv", "inner").groupBy("conv", "len").agg(*_told(rows)))
        shared = heads.groupBy("x0", "x1").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        more = stored(heads.join(shared, ["x0", "x1"], "left_semi").where(F.col("len") > cut).select("conv", "len"))
        cuts = cuts.unionAll(open_.join(more, "conv", "left_anti").select("conv", F.lit(cut).cast("long").alias("cut")))
        cuts = cuts.unionAll(more.where(F.col("len") <= 2 * cut).select("conv", F.col("len").alias("cut")))
        open_ = more.where(F.col("len") > 2 * cut)
        cut *= 2
    known = mine.join(cuts, "conv")
    kept = spread_join(rows, known, "conv", "inner")
    turns = kept.where("d <= cut").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("d", "th", "cum"))).alias("x"))
    before = kept.where("d = len - 1").select("conv", F.col("cum").alias("before"))
    none = F.array().cast("array<bigint>")
    out = reps.withColumnRenamed("rep", "conv").join(turns, "conv", "left").join(before, "conv", "left")
    return stored(out.select("conv", "n_ends", "len", "total", F.coalesce("before", zero).alias("before"), F.coalesce("x.th", none).alias("seq"), F.coalesce("x.cum", none).alias("cum"))), stored(members)


def shared_length(x: np.ndarray, y: np.ndarray) -> int:
    n = min(len(x), len(y))
    differ = x[:n] != y[:n]
    return int(differ.argmax()) if differ.any() else n


class Point:
    """An open point of a sorted range. went_on: the range before has it too."""

    __slots__ = ("below", "children", "conv", "depth", "end", "leaves", "n", "n_ends", "went_on", "weight")

    def __init__(self, depth: int, went_on: bool = False) -> None:
        self.depth, self.went_on = depth, went_on
        self.n = self.n_ends = self.leaves = self.weight = self.below = self.children = 0
        self.conv = self.end = None


POINT = "depth long, h0 long, h1 long, p_depth long, p0 long, p1 long, conv long, n long, leaves long, weight long, below long, children long, end long, n_ends long, at long, above long"
_NAMES = [c.split()[0] for c in POINT.split(", ")]


class Builder:
    """The compressed tree of one sorted range, item by item."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.stack = [Point(0, True)]
        self.seq = self.cum = np.zeros(0, np.int64)
        self.item: tuple | None = None
        self.hashes: dict[int, tuple[int, int]] = {}

    def began_after(self, seq: np.ndarray, before: np.ndarray) -> None:
        """The first item shares a beginning with the last one of the range before."""
        self.stack += [Point(d, True) for d in range(1, shared_length(seq, before) + 1)]
        self._hash_all(seq, len(self.stack) - 1)

    def _hash_all(self, seq: np.ndarray, most: int) -> None:
        h, raw = xxhash.xxh3_128(), seq[:most].tobytes()
        for d in range(1, most + 1):
            h.update(raw[8 * d - 8 : 8 * d])
            self.hashes[d] = _halves(h.intdigest())

    def _hash(self, depth: int) -> tuple[int, int]:
        if depth not in self.hashes:
            self.hashes[depth] = _halves(xxhash.xxh3_128_intdigest(self.seq[:depth].tobytes()))
        return self.hashes[depth]

    def _bytes(self, depth: int) -> int:
        """Bytes of the current item's turns up to a depth. An end behind what is sorted is the item's own."""
        if depth <= 0:
            return 0
        if depth <= len(self.cum):
            return int(self.cum[depth - 1])
        return self.item[3] if depth == self.item[1] else self.item[4]

    def close(self, to: int, each: bool = False) -> None:
        """Closes the points deeper than ``to``, which is a point then; each: so is every depth above it, and all are closed."""
        while self.stack[-1].depth > (0 if each else to):
            q = self.stack.pop()
            up = min(q.depth - 1, to)
            if self.stack[-1].depth < up:
                self.stack.append(Point(up))
            p = self.stack[-1]
            if q.n_ends and not q.children and not (each and q.depth <= to):
                q.leaves += 1
            p.n, p.leaves, p.weight = p.n + q.n, p.leaves + q.leaves, p.weight + q.weight
            p.conv = q.conv if p.conv is None else min(p.conv, q.conv)
            p.below += q.below + (0 if q.went_on else self._bytes(q.depth) - self._bytes(p.depth))
            p.children += not q.went_on
            self._emit(q, p)

    def _emit(self, q: Point, p: Point | None) -> None:
        above = (p.depth, *self._hash(p.depth)) if p else (None, None, None)
        self.out.append((q.depth, *self._hash(q.depth), *above, q.conv, q.n, q.leaves, q.weight, q.below, q.children, q.end, q.n_ends, self._bytes(q.depth), self._bytes(q.depth - 1)))

    def add(self, conv: int, n_ends: int, length: int, total: int, before: int, seq: np.ndarray, cum: np.ndarray) -> None:
        if self.item is not None:
            shared = shared_length(self.seq, seq)
            self.close(shared)
            self.hashes = {d: h for d, h in self.hashes.items() if d <= shared}
        self.item, self.seq, self.cum = (conv, length, n_ends, total, before), seq, cum
        if self.stack[-1].depth < length:
            self.stack.append(Point(length))
        p = self.stack[-1]
        p.n, p.n_ends, p.end, p.weight = p.n + n_ends, n_ends, conv, p.weight + n_ends * total
        p.conv = conv if p.conv is None else min(p.conv, conv)

    def finish(self, after: np.ndarray | None) -> None:
        """after: the first item of the range behind."""
        shared = shared_length(self.seq, after) if after is not None else 0
        self._hash_all(self.seq, shared)
        self.close(shared, each=True)
        root = self.stack.pop()
        if root.n_ends and not root.children and after is None and self.first:
            root.leaves += 1  # the whole tree is one turnless node
        self._emit(root, None)

    first = True

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[] for _ in _NAMES]
        self.out = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _halves(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


_ITEM = ["conv", "n_ends", "len", "total", "before", "seq", "cum"]


def points(made: DataFrame) -> DataFrame:
    """The compressed tree of items: one row a point, with the depth and hash of the one above it (null: the root's)."""
    spark = made.sparkSession
    sorted_ = stored(made.select(*_ITEM).repartitionByRange("seq").sortWithinPartitions("seq").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    ends = sorted_.groupBy("part").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    ends = stored(ends.select("part", "lo", "hi", F.lag("hi").over(W.orderBy("part")).alias("prev"), F.lead("lo").over(W.orderBy("part")).alias("next")))  # a row a range
    side = lambda at, kind: F.broadcast(ends.where(f"{at} IS NOT NULL").select(F.col(at).alias("at"), F.col("part").alias("to"), F.lit(kind).alias("kind")))
    borders = [sorted_.join(side(at, kind), "at").select(*_ITEM, "at", F.col("to").alias("part"), "kind") for at, kind in (("prev", 0), ("next", 2))]
    rows = sorted_.select(*_ITEM, "at", "part", F.lit(1).alias("kind")).unionAll(borders[0]).unionAll(borders[1])
    parts = max(1, ends.count())
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "at").select(*_ITEM, "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, now, held, after = None, None, None, None
        for batch in batches:
            flat = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7, 8)]
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(5), batch.column(6))]
            for i, (conv, n_ends, length, total, before, part, kind) in enumerate(zip(*flat, strict=True)):
                seq, cum = (v[o[i] : o[i + 1]] for v, o in lists)
                if part != now:
                    if tree is not None:
                        tree.finish(after)
                        yield tree.batch()
                    tree, now, held, after = Builder(), part, None, None
                if kind == 0:
                    held = seq
                elif kind == 2:
                    after = seq.copy()
                else:
                    if tree.item is None and held is not None:
                        tree.first = False
                        tree.began_after(seq, held)
                    tree.add(conv, n_ends, length, total, before, seq.copy(), cum.copy())
            if tree is not None:
                yield tree.batch()
        if tree is not None:
            tree.finish(after)
            yield tree.batch()

    found = rows.mapInArrow(lean(run), POINT)
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "weight", "below", "children", "n_ends")]
    return stored(found.groupBy("depth", "h0", "h1").agg(*[F.max(c).alias(c) for c in ("p_depth", "p0", "p1", "end", "at", "above")], F.min("conv").alias("conv"), *sums))


def id_digests(members: DataFrame) -> DataFrame:
    """(end, ends_sha256): of the ids of each sequence, ascending, comma-joined. Chunks of ids are made where sorted ranges lie; one sequence's chunks pass a task as a stream."""
    rows = members.select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, first, said, size = None, None, [], 0
        done: list[tuple] = []
        for batch in batches:
            for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != rep or size >= CHUNK:
                    if said:
                        done.append((rep, first, ",".join(said)))
                    rep, first, said, size = r, c, [], 0
                said.append(str(c))
                size += len(said[-1]) + 1
            yield _batch(done, _CHUNKS)
            done = []
        yield _batch([(rep, first, ",".join(said))] if said else [], _CHUNKS)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, h = None, None
        done: list[tuple] = []
        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h is not None and r == rep:
                    h.update(b"," + text.encode())
                    continue
                if h is not None:
                    done.append((rep, h.hexdigest()))
                rep, h = r, hashlib.sha256(text.encode())
            yield _batch(done, _DIGESTS)
            done = []
        yield _batch([(rep, h.hexdigest())] if h is not None else [], _DIGESTS)

    made = rows.mapInArrow(lean(chunks), "rep long, first long, text string")
    return made.repartition("rep").sortWithinPartitions("rep", "first").select("rep", "text").mapInArrow(lean(digests), "end long, ends_sha256 string")


_CHUNKS = (("rep", pa.int64()), ("first", pa.int64()), ("text", pa.string()))
_DIGESTS = (("end", pa.int64()), ("ends_sha256", pa.string()))


def _batch(rows: list[tuple], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in kinds]
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def nodes(rows: DataFrame, ids: DataFrame, cut: int = CUT) -> DataFrame:
    """The trie of sequences (conv, d from 1, th, cum: bytes up to it) and of all ids (conv): one row per node, as ``op13``'s contract names its columns."""
    made, members = items(rows, ids, cut)
    found = points(made)
    over = found.select(F.col("depth").alias("p_depth"), F.col("h0").alias("p0"), F.col("h1").alias("p1"), F.col("conv").alias("p_conv"))
    found = spread_join(found, over, ["p_depth", "p0", "p1"])
    found = stored(found)
    ended = found.where("end IS NOT NULL").join(id_digests(members), "end", "left")
    found = stored(ended.unionByName(found.where("end IS NULL").withColumn("ends_sha256", F.lit(None).cast("string"))))
    top = F.col("p_depth") + 1
    saved = F.col("weight") - F.col("n") * F.col("above") - F.col("below") - (F.col("at") - F.col("above"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    what = lambda depth, parent, children, saved_, ends: [F.col("conv").alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), children.cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved_.alias("saved_tokens"), ends.alias("ends_sha256")]
    own = found.select(*what(F.col("depth"), F.when(F.col("depth") == top, F.col("p_conv")).when(F.col("depth") > 0, F.col("conv")), F.col("children"), saved, F.coalesce("ends_sha256", none)))

    # nodes of edges: some thousand depths a row at first, then each
    edges = found.where(F.col("depth") > top).select("conv", "depth", "p_depth", "p_conv", "n", "leaves", "above", saved.alias("saved"))
    some = edges.withColumn("from", F.explode(F.sequence(top, F.col("depth") - 1, F.lit(SPAN).cast("long"))))
    each = some.withColumn("d", F.explode(F.sequence("from", F.least(F.col("from") + SPAN, F.col("depth")) - 1))).drop("from")
    turn = rows.select("conv", (F.col("d") + 1).alias("d"), F.col("cum").alias("until"))
    each = each.join(turn, ["conv", "d"], "left")
    suffix = F.col("saved") + (F.col("n") - 1) * (F.col("above") - F.coalesce("until", F.lit(0).cast("long")))
    unary = each.select(*what(F.col("d"), F.when(F.col("d") == top, F.col("p_conv")).otherwise(F.col("conv")), F.lit(1), suffix, none))
    return own.unionAll(unary)


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", share: bool = False) -> DataFrame:
    """One row per node. share: of rebuilt conversations (``rebuilt``) instead of the ones that were said."""
    t = placed(turns, conv, turn, role, text)
    rows, ids = rebuilt(t) if share else (as_they_are(t), t.select("conv").distinct())
    return nodes(rows, ids)
