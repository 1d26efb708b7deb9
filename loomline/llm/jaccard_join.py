"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles (64-bit hashes). Equal sets are
collapsed into classes first. Shingles have one global order: by the product of their
words' counts over all documents (words that are not frequent count 1), but shingles
that are themselves frequent come last; any order is exact, this one keeps prefixes rare. If J(x, y) >= t, the first |x| - ceil(t|x|) + l shingles of x and
those of y share l of them. Each class posts the prefix for the largest l; posting lists
of one class end there.

For each class, the list lengths of its prefix tell what each l would cost in postings
read and sets verified, and the cheapest is taken: longer prefixes, and as many more
shared tokens demanded. A pair takes the larger l of its two classes.

Hot lists are never multiplied out. First each class is verified against the commonest
smallest member of its lists, which settles groups of near copies by one pair a member.
After that only classes of different components meet, on conditions that lengths, places
and parity bitmaps decide inside the join; long lists are dealt over tasks by bands of
sizes and shares of their rows. Pairs of one component say nothing new, so no
link between components is lost, and verification of the sets decides every pair that
the result rests on.

Defined results: null, empty or wordless text has an empty set and links with nothing,
being its own component; fewer words than a shingle are one shingle; rows that repeat an
id are one document with the links of all its texts; a row of null id belongs to its
class and takes its component, null if no id is in it; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BROADCAST_IDS, U64, Block, blocks, lean, mix, runs, span_hashes, spread_join, stored
from .components import components

LEVELS = 6
#: Frequent shingles and words that the order knows, and how often one must occur in 4 MB of text to be counted.
FREQUENT, FREQUENT_WORDS, OFTEN = 50_000, 200_000, 3
PARITY = 512
WORDS = PARITY // 64
_BITS = 22
_TOP = U64(64 - _BITS)
#: Lists up to this length are left to the pairing of groups.
STAR = 4
#: Rows of a list that meet in one task; longer lists are split by bands of sizes and into shares.
SPLIT = 2_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_MULT = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and shingle hashes of a block's texts, in order, each shingle's first word, and where each text's shingles begin (n + 1)."""
    b = ASCII_LOWER[block.buf]
    start, end = runs(~_SPACE[b])
    words = span_hashes(b, start, end)
    at = np.searchsorted(start, block.at)
    count = np.diff(at)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    total = np.zeros(len(words), U64)
    for i in range(k):
        m = U64((_MULT[i % 8] + 2 * (i // 8)) & 0xFFFFFFFFFFFFFFFF)
        total[: len(words) - i] += (words[i:] if i else words) * m
    short = np.flatnonzero((count > 0) & (count < k))
    for d in short:  # fewer words than a shingle: their own sum, apart from all others
        w = words[at[d] : at[d + 1]]
        total[at[d]] = sum(int(x) * _MULT[i % 8] for i, x in enumerate(w)) + len(w) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF
    first = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    first = first + np.arange(len(first))
    return words, mix(total[first]), first, np.concatenate(([0], np.cumsum(n)))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))


@dataclass(frozen=True)
class Order:
    """The global order of shingles. words: by the hash's top bits, eight times the binary logarithm of a frequent word's count (0: not frequent). hot: frequent shingles, ascending, and hot_n their counts; some: their top bits, as a quick test."""

    words: np.ndarray
    hot: np.ndarray
    hot_n: np.ndarray
    some: np.ndarray

    def keys(self, weights: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Sort keys of shingles s with the summed word weights given: frequent shingles come last, by count."""
        out = weights.astype(np.int64)
        maybe = np.flatnonzero(self.some[(s >> _TOP).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hot, s[maybe]), len(self.hot) - 1)
            hit = self.hot[at] == s[maybe]
            out[maybe[hit]] = (1 << 20) + np.minimum(self.hot_n[at[hit]], 1 << 40)
        return out


def count_order(docs: DataFrame, k: int) -> Order:
    """Counts words and shingles over all documents and keeps the most frequent of each: at most FREQUENT_WORDS and FREQUENT, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for kind, parts in enumerate(held):
                s, n = np.unique(np.concatenate(parts), return_counts=True)
                often = n >= OFTEN
                yield pa.record_batch([pa.array(np.full(often.sum(), kind, np.int32)), pa.array(s[often].view(np.int64)), pa.array(n[often])], names=["kind", "hash", "n"])

        for batch in batches:
            for block in blocks(batch.column(0)):
                words, every, _, _ = shingles(block, k)
                held[0].append(words)
                held[1].append(every)
                size += len(block.buf)
                if size >= 4 << 20:
                    yield from out()
                    held, size = ([], []), 0
        if held[0]:
            yield from out()

    counts = stored(docs.select("text").mapInArrow(lean(run), "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")))
    top = lambda kind, most: counts.where(F.col("kind") == kind).orderBy(F.desc("n"), "hash").limit(most).select("hash", "n").toPandas().sort_values("hash")
    words, hot = top(0, FREQUENT_WORDS), top(1, FREQUENT)
    table = np.zeros(1 << _BITS, np.uint8)
    slot = (words["hash"].to_numpy(np.int64).view(U64) >> _TOP).astype(np.int64)
    np.maximum.at(table, slot, np.clip(np.round(8 * np.log2(np.maximum(words["n"].to_numpy(float), 1))), 0, 255).astype(np.uint8))
    h = hot["hash"].to_numpy(np.int64).view(U64)
    by = np.argsort(h)
    some = np.zeros(1 << _BITS, bool)
    some[(h >> _TOP).astype(np.int64)] = True
    return Order(table, h[by], hot["n"].to_numpy(np.int64)[by], some)


def need(n: int, percent: int) -> int:
    """ceil(t n): what a set of n shares at least with any that it links with."""
    return -(-n * percent // 100)


def summaries(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, hi, lo, prefix, parity) of every row: size and 128-bit digest of its set, its longest prefix, and by the set's shingles modulo PARITY the parities of their numbers, as eight longs."""
    shared = docs.sparkSession.sparkContext.broadcast(count_order(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                words, every, first, at = shingles(block, k)
                total = np.concatenate(([0], np.cumsum(order.words[(words >> _TOP).astype(np.int64)], dtype=np.int64)))
                keys = order.keys(total[np.minimum(first + k, len(words))] - total[first], every)
                n, hi, lo, own, odd = [], [], [], [], []
                for d in range(block.n):
                    s, once = np.unique(every[at[d] : at[d + 1]], return_index=True)
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    n.append(len(s))
                    hi.append(digest >> 64)
                    lo.append(digest & 0xFFFFFFFFFFFFFFFF)
                    size = min(len(s), len(s) - need(len(s), percent) + LEVELS)
                    odd.append(np.packbits(np.bincount((s & U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).view(np.int64))
                    own.append(s[np.argsort(keys[at[d] : at[d + 1]][once], kind="stable")[:size]].view(np.int64))
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(own), pa.int64()))
                half = lambda x: pa.array(np.array(x, U64).view(np.int64))
                parity = pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * WORDS, pa.int32()), pa.array(np.concatenate(odd)))
                yield pa.record_batch([ids.slice(block.first, block.n), pa.array(n, pa.int64()), half(hi), half(lo), lists, parity], names=["id", "n", "hi", "lo", "prefix", "parity"])

    return stored(docs.mapInArrow(lean(run), "id long, n long, hi long, lo long, prefix array<bigint>, parity array<bigint>"))


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the named rows: their sorted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                _, every, _, at = shingles(block, k)
                sets = [np.unique(every[at[d] : at[d + 1]]).tobytes() for d in range(block.n)]
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), pa.array(sets, pa.binary())], names=["id", "set"])

    ids = stored(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return stored(docs.join(ids, "id", "left_semi").select("id", "text").mapInArrow(lean(run), "id long, set binary"), large_rows=True)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = batch.columns
            keep = np.zeros(len(a), bool)
            for i in range(len(a)):
                s, t = np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64)
                if len(s) > len(t):
                    s, t = t, s
                if 100 * len(s) < percent * len(t):
                    continue
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum())
                keep[i] = 100 * both >= percent * (len(s) + len(t) - both)
            keep = pa.array(keep)
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole longest prefixes leave room for a link. Of two prefixes, the one that ends first in the global order holds all shingles that the sets share up to there, so what they share is at most what the prefixes share and the rest of one of them."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"p_{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("p_a", "p_b"))
    rest = F.greatest(F.col("n_a") - F.size("p_a"), F.col("n_b") - F.size("p_b"))
    fewest = F.least(F.lit(LEVELS), need_of("n_a", percent), need_of("n_b", percent))
    asked = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100.0 + percent) - 1e-9)
    return j.where((both >= fewest) & (both + rest >= asked)).select("a", "b")


def decided(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, as a stored table: only texts of plausible pairs are read again."""
    pairs = stored(plausible(pairs, classes, percent))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    return stored(verified(pairs, sets_of(docs, ids, k), percent))


def _parts(df: DataFrame, percent: int | None, left: bool) -> DataFrame:
    """df (token, id, c: the list's length, n) with part, in which the two sides of a long list meet in many tasks: bands of sizes, of which only neighbours can link, and within a band a share of the left side's rows with all of the right's. A short list is one part."""
    shares = F.ceil(F.col("c") / F.lit(SPLIT)).cast("int")
    if percent is None:
        bands, band = [0], F.lit(0)
    else:  # a little wider than the largest ratio of sizes, so that rounding moves no link two bands apart
        bands, band = [-1, 0, 1], F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")
    part = lambda b, s: F.struct(b.cast("int").alias("band"), s.cast("int").alias("share"))
    if left:
        dealt = F.transform(F.array(*map(F.lit, bands)), lambda d: part(band + d, F.pmod(F.xxhash64("id"), shares)))
    else:
        dealt = F.transform(F.sequence(F.lit(0), shares - 1), lambda s: part(band, s))
    return df.withColumn("part", F.explode(F.when(F.col("c") > SPLIT, dealt).otherwise(F.array(part(F.lit(0), F.lit(0))))))


def _candidates(p: DataFrame, percent: int) -> DataFrame:
    """(a, b, l) per shared token of postings of different components that may link; l: shared tokens that the pair needs.

    The conditions stand in the joins, so that only what passes becomes a row: lengths; room after the token's places for the overlap asked for; and differing parities, each of which is at least one shingle that only one set has. Single documents meet single ones and members of components; components meet each other by pairs of components, so a large one never meets itself. Long lists are dealt over tasks.
    """
    side = lambda df, x: df.select("token", "part", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("token", "part", "c")])
    here = lambda df, x: side(_parts(df, percent, x == "a"), x)
    met = lambda x, y: (x["token"] == y["token"]) & (x["part"] == y["part"])
    length = F.greatest("l_a", "l_b")
    asked = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100.0 + percent) - 1e-9)
    room = length - 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(WORDS)), F.lit(0))
    fit = (F.col("level_a") <= length) & (F.col("level_b") <= length) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (room >= asked) & (differ <= F.col("n_a") + F.col("n_b") - 2 * asked)
    what = [F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.least(length, need_of("n_a", percent), need_of("n_b", percent)).alias("l")]
    single, member = p.where("component IS NULL"), p.where("component IS NOT NULL")
    x, y, z = here(single, "a"), here(single, "b"), here(member, "a")
    alone = x.join(y, met(x, y) & (F.col("id_a") < F.col("id_b")) & fit).select(*what)
    mixed = z.join(y, met(z, y) & fit).select(*what)
    comps = member.groupBy("token", "comp").agg(F.max("c").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("m")).withColumn("id", F.col("comp"))
    one, other = (side(_parts(comps, None, x == "a"), x) for x in "ab")
    sizes = (100 * F.col("most_a") >= percent * F.col("least_b")) & (100 * F.col("most_b") >= percent * F.col("least_a"))
    two = one.join(other, met(one, other) & (F.col("comp_a") < F.col("comp_b")) & sizes).select(one["token"], "comp_a", "comp_b", "m_a", "m_b")
    # most lists have a few rows of a component
    two = stored(two)
    few = (F.col("m_a") <= SPLIT) & (F.col("m_b") <= SPLIT)
    plain = lambda x, df=member: df.select("token", *[F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("token", "c")])
    pair = ["token", "comp_a", "comp_b"]
    w, v = two.where(few).select(*pair).join(plain("a"), ["token", "comp_a"]), plain("b")
    large = w.join(v, (w["token"] == v["token"]) & (w["comp_b"] == v["comp_b"]) & fit).select(*what)
    if two.where(~few).limit(1).count():
        # both sides' rows are dealt into shares, and each two shares meet in a task of their own
        many = two.where(~few)
        shares = lambda x: F.ceil(F.col(f"m_{x}") / F.lit(SPLIT)).cast("int")
        held = stored(many.select("token", F.col("comp_a").alias("comp"), shares("a").alias("shares")).unionAll(many.select("token", F.col("comp_b"), shares("b"))).distinct())
        dealt = spread_join(member, held, ["token", "comp"], "inner").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).drop("shares")
        each = lambda x: F.explode(F.sequence(F.lit(0), shares(x) - 1))
        many = many.withColumn("share_a", each("a")).withColumn("share_b", each("b")).select(*pair, "share_a", "share_b")
        u, v = many.join(plain("a", dealt), ["token", "comp_a", "share_a"]), many.join(plain("b", dealt), ["token", "comp_b", "share_b"])
        both = [*pair, "share_a", "share_b"]
        met_ = u.join(v.withColumnsRenamed({c: f"{c}_" for c in both}), reduce(and_, [F.col(c) == F.col(f"{c}_") for c in both]) & fit)
        large = large.unionAll(met_.select(*what))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "l")
    return ordered(alone).unionAll(ordered(mixed)).unionAll(ordered(large))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable by links of J >= percent / 100)."""
    docs = _texts(docs, key, text)
    rows = summaries(docs, k, percent)
    classes = stored(rows.where("n > 0").groupBy("hi", "lo").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "prefix", "parity"))).alias("c")).where("c IS NOT NULL").select("hi", "lo", "c.id", "c.n", "c.prefix", "c.parity"))
    least = F.ceil(F.col("n") * percent / F.lit(100)).cast("long")  # ceil(t n)
    posted = classes.select("id", "n", (F.col("n") - least + 1).alias("base"), F.posexplode("prefix").alias("pos", "token"))
    level = F.greatest(F.lit(1), F.col("pos") - F.col("base") + 2).cast("int")
    posted = posted.select("token", "id", "n", F.col("pos").cast("int").alias("pos"), level.alias("level"))
    lists = stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low")).where("c > 1"))
    shared = stored(spread_join(posted, lists, "token", "inner", counts=lists.select("token", F.col("c").alias("hot_n"))))

    # what each l costs a class: postings read, and sets verified at about its own length
    cost = [F.sum(F.when(F.col("level") <= i, F.col("c") - 1).otherwise(0)) * (1 + F.max("n") / F.lit(50.0 * i)) + F.lit(float(i)) for i in range(1, LEVELS + 1)]
    adaptive = shared.groupBy("id").agg(*[c.alias(f"c{i}") for i, c in enumerate(cost, 1)])
    best = F.least(*[F.col(f"c{i}") for i in range(1, LEVELS + 1)])
    adaptive = adaptive.select("id", F.coalesce(*[F.when(F.col(f"c{i}") == best, i) for i in range(1, LEVELS + 1)]).alias("l"))

    # one pair a class: the smallest member that most of its hot lists name
    star = shared.where((F.col("c") > STAR) & (F.col("low") < F.col("id"))).groupBy("id", "low").agg(F.count(F.lit(1)).alias("m"))
    star = star.groupBy("id").agg(F.max(F.struct("m", (-F.col("low")).alias("low"))).alias("x")).select(F.col("id").alias("a"), (-F.col("x.low")).alias("b"))
    first = decided(star, classes, docs, k, percent)
    near = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))

    parity = classes.select("id", *[F.col("parity")[i].alias(f"s{i}") for i in range(WORDS)])
    p = shared.join(adaptive, "id").join(near.select(F.col("node").alias("id"), "component"), "id", "left")
    p = p.select("token", "id", "n", "c", "pos", "level", "l", "component", F.coalesce("component", "id").alias("comp"))
    several = p.groupBy("token").agg(F.min("comp").alias("lo_c"), F.max("comp").alias("hi_c")).where("lo_c <> hi_c").select("token")
    p = stored(p.join(several, "token", "left_semi").join(parity, "id"))
    pairs = _candidates(p, percent)
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.max("l").alias("l")).where("m >= l").select("a", "b")
    second = decided(pairs, classes, docs, k, percent)
    edges = first.unionAll(second)
    comp = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    whole = classes.select("hi", "lo", F.col("id").alias("class_id"))
    out = rows.select("id", "n", "hi", "lo").join(whole, ["hi", "lo"], "left").join(comp.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    own = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("class_id"), F.coalesce("component", own).alias("component_id"))


def need_of(n: str, percent: int):
    return F.ceil(F.col(n) * percent / F.lit(100)).cast("int")
