"""Packing as vector bin packing, for fixed-length training sequences.

An example is a demand on three capacities of a sequence: tokens, segments and
loss-bearing tokens. Whole sequences are cut off long examples first. Of the rest, a
window of examples is packed a sequence at a time: the example that fits and whose
demand has the largest weighted dot product with what is left comes next; if none fits,
the largest is cut to fill what is left. A window's last, open sequence passes its
pieces on to the next window, and a partition's last one is cut into sequences of
powers of two, which need no padding.

Each partition packs what it reads: no shuffle, no state but a window, and a lost
executor's partition is packed again alike. Sequence ids carry the partition's number.

Defined results: a null text is empty and has the end token alone; repeated rows are
examples each; a null key stays null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import blocks, lean
from .tokens import word_bpe

WINDOW = 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss: int = 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], float)


@dataclass
class Piece:
    """length ids of example ``example`` from ``start`` on, of which ``loss`` bear loss."""

    example: int
    start: int
    length: int
    loss: int


@dataclass
class Packer:
    """Turns pieces into sequences. loss_of(example, start, length): loss-bearing tokens of a span."""

    limits: Limits
    loss_of: object
    open: list[Piece] = field(default_factory=list)

    def whole(self, example: int, length: int) -> tuple[list[list[Piece]], Piece | None]:
        """Full sequences cut off the front of an example, and the rest."""
        full, at, n = [], 0, self.limits.tokens
        while length - at >= n:
            loss = self.loss_of(example, at, n)
            take = n
            while loss > self.limits.loss:
                take = max(1, take // 2)
                loss = self.loss_of(example, at, take)
            full.append([Piece(example, at, take, loss)])
            at += take
        return full, Piece(example, at, length - at, self.loss_of(example, at, length - at)) if length > at else None

    def pack(self, pieces: list[Piece]) -> list[list[Piece]]:
        """Full sequences from the open one's pieces and these; what is left over becomes the open one."""
        pieces, out, cap = self.open + pieces, [], self.limits.vector()
        demand = np.array([[p.length, 1, p.loss] for p in pieces], float).reshape(-1, 3)
        weight = demand.mean(axis=0) / cap**2 if len(pieces) else cap
        left = np.ones(len(pieces), bool)
        total = demand[:, 0].sum()
        while total > 0:
            rest, here, used = cap.copy(), [], 0
            while rest[0] > 0 and rest[1] > 0:
                fits = left & (demand <= rest).all(axis=1)
                if fits.any():
                    i = int(np.argmax(np.where(fits, demand @ (weight * rest), -1.0)))
                    here.append(pieces[i])
                    left[i] = False
                    rest -= demand[i]
                    used += pieces[i].length
                    continue
                i = int(np.argmax(np.where(left, demand[:, 0], -1.0)))
                if not left[i]:
                    break
                p = pieces[i]
                take = int(min(rest[0], p.length))
                while take and self.loss_of(p.example, p.start, take) > rest[2]:
                    take //= 2
                if not take or take == p.length:
                    break
                front = Piece(p.example, p.start, take, self.loss_of(p.example, p.start, take))
                here.append(front)
                pieces[i] = Piece(p.example, p.start + take, p.length - take, p.loss - front.loss)
                demand[i] = [pieces[i].length, 1, pieces[i].loss]
                rest -= [take, 1, front.loss]
                used += take
            total -= used
            if not left.any() and used < self.limits.tokens:
                self.open = here
                return out
            out.append(here)
        self.open = []
        return out

    def close(self) -> list[list[Piece]]:
        """The open sequence's tokens, cut into sequences of powers of two."""
        out, size = [], 1 << max(0, sum(p.length for p in self.open).bit_length() - 1)
        queue = list(self.open)
        left = sum(p.length for p in queue)
        while left:
            while size > left:
                size //= 2
            here, need = [], size
            while need:
                p = queue.pop(0)
                take = min(need, p.length)
                here.append(Piece(p.example, p.start, take, self.loss_of(p.example, p.start, take)))
                if take < p.length:
                    queue.insert(0, Piece(p.example, p.start + take, p.length - take, p.loss - here[-1].loss))
                need -= take
            out.append(here)
            left -= size
        self.open = []
        return out


SCHEMA = "{key} long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def loss_sums(spans: list | None, n: int) -> np.ndarray:
    """n + 1 running counts of the tokens inside any of the spans (start, end); null: of all tokens."""
    if spans is None:
        return np.arange(n + 1)
    bears = np.zeros(n, bool)
    for span in spans:
        if span is not None and None not in (ends := tuple(span.values())):
            bears[max(0, ends[0]) : max(0, ends[1])] = True
    return np.concatenate(([0], np.cumsum(bears)))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    tokenizer: path of the word BPE's file on every executor. loss: column of arrays of
    structs (start, end), spans of tokens that bear loss, the end token being the last; where
    it is null or not given, every token does.
    """
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        sums: dict[int, np.ndarray] = {}  # of examples with loss spans
        packer = Packer(limits, lambda example, start, length: int(sums[example][start + length] - sums[example][start]) if example in sums else length)
        sequence = TaskContext.get().partitionId() << 33
        held: dict[int, tuple[object, np.ndarray]] = {}  # examples with pieces in the window
        window: list[Piece] = []
        number = 0

        def emit(sequences: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            rows = []
            for pieces in sequences:
                at = 0
                for p in pieces:
                    k, ids = held[p.example]
                    rows.append((k, p.start, p.length, ids[p.start : p.start + p.length].tobytes(), len(ids), sequence, at))
                    at += p.length
                sequence += 1
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def turn() -> Iterator[pa.RecordBatch]:
            nonlocal window, held
            done = packer.pack(window)
            yield from emit(done)
            window = []
            held = {p.example: held[p.example] for p in packer.open}
            for example in sums.keys() - held.keys():
                del sums[example]

        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = batch.column(2).to_pylist() if loss else None
            for block in blocks(batch.column(1), size=1 << 19):
                ids, counts = bpe.encode(block)
                at, fulls = 0, []
                for i, n in enumerate(counts.tolist()):
                    own = np.empty(n + 1, "<u4")
                    own[:n], own[n] = ids[at : at + n], end
                    at += n
                    held[number] = (keys[block.first + i], own)
                    if spans and spans[block.first + i] is not None:
                        sums[number] = loss_sums(spans[block.first + i], n + 1)
                    full, rest = packer.whole(number, n + 1)
                    fulls += full
                    if rest:
                        window.append(rest)
                    number += 1
                yield from emit(fulls)
                if len(window) >= WINDOW:
                    yield from turn()
        yield from turn()
        yield from emit(packer.close())

    return docs.select(docs[key].cast("long").alias(key), docs[text].alias(text), *([docs[loss].alias("loss_spans")] if loss else [])).mapInArrow(lean(run), SCHEMA.format(key=key))
