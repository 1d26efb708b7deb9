"""Spelling variants: words at one edit from a far more frequent one, by automata of words' halves.

Words are counted over whole texts; then near words are found. A word is cut in two
segments. One inserted, deleted or replaced code point leaves one of the two as it is, at
the word's beginning or at its end. A shard holds an Aho-Corasick automaton of its words'
segments and scans all words that may have one of them, each written twice with a mark
between (``word NUL word``): the segment that begins a word is looked for behind the
mark, the one that ends it before the mark, so a match tells its offset. Matches whose
lengths fit are verified on whole words. An edit has one leftmost way to be told: it lies
behind all that two words begin with in common, so a pair is found in one gap only.

A segment that many words share is hot. Its gap, what is not in the segment, is halved
again: the pattern becomes a beginning and an end together (``end NUL beginning``). Words
that share all but one code point are as few as there are letters, so halving ends, and no
task compares more than HOT words with a word, whatever share of all words one segment has.

Defined results: a null text has no words and a null id is written as an empty one before
the colon; repeated rows count each; an empty table gives no rows; of near words of equal
count the smallest in code-point order is the form.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BROADCAST_IDS, Block, blocks, lean, runs, spread_join, stored

#: Code points of the shortest word, and occurrences of the rarest.
LEAST, OFTEN = 7, 2
#: One occurrence in DELETED loses a code point (a stated perturbation, by a checksum).
DELETED = 31
#: A form is this many times as frequent.
FAR = 10
#: Words that may share a segment; beyond it, gaps are halved again.
HOT = 64
#: Patterns of a shard's automaton, about; distinct words that a task counts before it hands them on; pairs verified at once.
SHARD, HELD, PAIRS = 40_000, 200_000, 1 << 16
#: Longer words are verified one by one.
WIDE = 64
NUL = "\0"


def occurrences(block: Block, ids: list[bytes]) -> list[bytes]:
    """The words of a block's texts, lower-cased, some with a code point deleted; ids: of its rows."""
    b = ASCII_LOWER[block.buf]
    lead = b == 0xC3  # U+00C0 to U+00FF are this byte and one more
    inside = ((b >= 0x61) & (b <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    start, end = runs(inside)
    points = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    size = points[end] - points[start]
    keep = size >= LEAST
    start, end, size = start[keep], end[keep], size[keep]
    raw, seed = b.tobytes(), [zlib.crc32(i + b":") for i in ids]
    found = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
    rows = np.searchsorted(block.at, start, "right") - 1
    h = np.array([zlib.crc32(w, seed[r]) for w, r in zip(found, rows.tolist(), strict=True)], np.int64)
    for i in np.flatnonzero(h % DELETED == 0).tolist():
        w, at = found[i].decode(), int(h[i] % size[i])
        found[i] = (w[:at] + w[at + 1 :]).encode() if size[i] > LEAST else b""
    return found


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all documents, as a stored table: counted in the tasks that read the texts, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            held.pop(b"", None)
            made = pa.record_batch([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            ids = [(x or "").encode() for x in batch.column(0).to_pylist()]
            for block in blocks(batch.column(1)):
                held.update(occurrences(block, ids[block.first : block.first + block.n]))
                if len(held) > HELD:
                    yield out()
        yield out()

    counted = docs.select(docs[key].cast("string").alias("id"), docs[text].alias("text")).mapInArrow(lean(run), "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN))


def _key() -> Column:
    """What stands around the gap from a to b of a word taken to have ``size`` code points."""
    after = F.col("size") - F.col("b")
    return F.concat(F.when(after > 0, F.substr("word", F.col("length") - after + 1, after)).otherwise(F.lit("")), F.lit(NUL), F.when(F.col("a") > 0, F.substr("word", F.lit(1), F.col("a"))).otherwise(F.lit("")))


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of each row's gap, with their keys."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    both = rows.withColumn("gap", F.explode(F.array(gap(F.col("a"), mid), gap(mid, F.col("b")))))
    return both.select("word", "n", "length", "size", "gap.a", "gap.b").where("a < b").withColumn("key", _key())


_PLACE = ["size", "a", "key"]


def segments(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, length, size, a, b, key) as a stored table: where each word may have a near one of ``size`` code points, around the gap from a to b. Rows of size = length are the patterns, at most ``hot`` a key."""
    length = F.char_length("word").cast("int")
    rows = vocabulary.select("word", "n", length.alias("length"), F.explode(F.array(length - 1, length, length + 1)).alias("size"))
    rows = stored(_halved(rows.where(F.col("size") >= LEAST).select("*", F.lit(0).alias("a"), F.col("size").alias("b"))))
    done = None
    while True:
        full = rows.where("size = length AND b - a > 1").groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(*_PLACE, F.lit(True).alias("hot"))
        full = stored(full)
        n = full.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        told = rows.join(F.broadcast(full), _PLACE, "left") if n <= BROADCAST_IDS else spread_join(rows, full, _PLACE)
        told = stored(told)
        light = told.where("hot IS NULL").drop("hot")
        done = light if done is None else done.unionByName(light)
        rows = stored(_halved(told.where("hot").select("word", "n", "length", "size", "a", "b")))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How long rows of two padded matrices agree; pads differ."""
    return np.argmin(x == y, axis=1)


class _Words:
    """Distinct words as matrices of Latin-1 bytes, padded behind and in front."""

    def __init__(self, words: list[str], pad: int) -> None:
        raw = [w.encode("latin-1")[: WIDE + 1] for w in words]
        width = max(map(len, raw), default=0) + 1
        self.size = np.array([len(w) for w in words], np.int64)
        fill = bytes([pad])
        self.left = np.frombuffer(b"".join(w.ljust(width, fill) for w in raw), np.uint8).reshape(len(raw), width)
        self.right = np.frombuffer(b"".join(w[::-1].ljust(width, fill) for w in raw), np.uint8).reshape(len(raw), width)


def _agree(x: str, y: str) -> int:
    most = min(len(x), len(y))
    lo, hi = 0, most
    while lo < hi:  # the longest common beginning, by slices
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if x[:mid] == y[:mid] else (lo, mid - 1)
    return lo


def near(x: str, y: str) -> tuple[bool, int]:
    """Whether exactly one edit lies between two words, and how long their common beginning is."""
    head = _agree(x, y)
    return x != y and abs(len(x) - len(y)) <= 1 and head + _agree(x[::-1], y[::-1]) >= max(len(x), len(y)) - 1, head


def scan_shard(rows: pa.Table) -> pa.Table:
    """One shard: (word, n_near, best_n, best) of the words that it finds near ones for."""
    word, n, length, size, a, b, key = (rows.column(c).to_pylist() for c in ("word", "n", "length", "size", "a", "b", "key"))
    texts = {w: i for i, w in enumerate(dict.fromkeys(word))}
    names, count = list(texts), dict(zip(word, n, strict=True))
    lists: dict[tuple, list[int]] = {}
    for w, s, length_, k, a_, b_ in zip(word, size, length, key, a, b, strict=True):
        if s == length_:
            lists.setdefault((k, s, a_, b_), []).append(texts[w])
    automaton = ahocorasick.Automaton()
    by_key: dict[str, list] = {}
    for (k, s, a_, b_), held in lists.items():
        by_key.setdefault(k, []).append((s, a_, b_, np.array(held, np.int64)))
    for k, found in by_key.items():
        automaton.add_word(k, (len(k), found))
    result = Result(names, count)
    if by_key:
        automaton.make_automaton()
        for i, x in enumerate(names):
            for at, (k, found) in automaton.iter(f"{x}{NUL}{x}"):
                for s, a_, b_, held in found:
                    if at == len(x) + a_ and k == a_ + 1 + s - b_ and abs(s - len(x)) <= 1:  # the segment ends where its word would begin or end, and lengths fit
                        result.add(i, held, a_, b_ if b_ < s else s + 1)
    return result.table()


class Result:
    """Candidates of a shard, verified some at a time."""

    def __init__(self, names: list[str], count: dict[str, int]) -> None:
        self.names, self.n = names, np.array([count[w] for w in names], np.int64)
        self.x, self.y = _Words(names, 0), _Words(names, 1)  # pads are no letters
        self.rank = np.argsort(np.argsort(np.array(names, object), kind="stable")) if names else np.zeros(0, np.int64)
        self.near = np.zeros(len(names), np.int64)
        self.best = np.full(len(names), -1, np.int64)
        self.held: list[tuple] = []
        self.pairs = 0

    def add(self, x: int, ys: np.ndarray, a: int, b: int) -> None:
        self.held.append((x, ys, a, b))
        self.pairs += len(ys)
        if self.pairs >= PAIRS:
            self.verify()

    def verify(self) -> None:
        if not self.held:
            return
        sizes = np.array([len(h[1]) for h in self.held])
        x, a, b = (np.repeat(np.array([h[i] for h in self.held], np.int64), sizes) for i in (0, 2, 3))
        y = np.concatenate([h[1] for h in self.held])
        self.held, self.pairs = [], 0
        most = np.maximum(self.x.size[x], self.y.size[y])
        head = _common(self.x.left[x], self.y.left[y])
        good = (x != y) & (((head >= a) & (head < b)) | (most > WIDE))
        x, y, a, b, head, most = (v[good] for v in (x, y, a, b, head, most))
        good = head + _common(self.x.right[x], self.y.right[y]) >= most - 1
        for i in np.flatnonzero(most > WIDE).tolist():
            ok, at = near(self.names[x[i]], self.names[y[i]])
            good[i] = ok and a[i] <= at < b[i]
        x, y = x[good], y[good]
        np.add.at(self.near, x, 1)
        order = np.lexsort((self.rank[y], -self.n[y], x))  # each word's best first
        x, y = x[order], y[order]
        first = np.flatnonzero(np.diff(x, prepend=-1))
        x, y = x[first], y[first]
        was = self.best[x]
        better = (was < 0) | (self.n[y] > self.n[was]) | ((self.n[y] == self.n[was]) & (self.rank[y] < self.rank[was]))
        self.best[x[better]] = y[better]

    def table(self) -> pa.Table:
        self.verify()
        at = np.flatnonzero(self.near)
        best = self.best[at]
        return pa.table({"word": pa.array([self.names[i] for i in at], pa.string()), "n_near": pa.array(self.near[at]), "best_n": pa.array(self.n[best] if len(at) else [], pa.int64()), "best": pa.array([self.names[i] for i in best], pa.string())})


def near_words(vocabulary: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): how many words are at one edit, and the most frequent of them."""
    rows = segments(vocabulary, hot)
    shards = max(1, -(-rows.where("size = length").count() // shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(scan_shard, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return stored(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best")))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, form (its near word of largest n, if that is FAR times the word's), root (the last of its forms' forms), n, n_near, form_n."""
    vocabulary = words(docs, key, text)
    near_ = near_words(vocabulary)
    is_form = F.col("best_n") >= FAR * F.col("n")
    told = stored(vocabulary.join(near_, "word", "left").select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")))
    # each step of a chain is FAR times as frequent, so the largest count bounds the steps; each round doubles those that are taken
    largest, steps = told.agg(F.max("n")).first()[0] or 0, 1
    root = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while OFTEN * FAR**steps < largest:
        root = stored(root)
        further = root.select(F.col("word").alias("via"), F.col("root").alias("end"))
        root = root.join(further, root["root"] == further["via"], "left").select("word", F.coalesce("end", "root").alias("root"))
        steps *= 2
    return told.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
