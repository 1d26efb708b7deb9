"""MinHash-like near duplicates by SetSketch registers, with likelihood and exact verification.

A document is the set of its distinct word shingles. Register i of its sketch is
floor(1 - log_b of the smallest of its shingles' i-th hash values), cut to 0 to 65,535, the
values being exponential with rate A: registers are maxima, so sketches of parts merge by
the larger (``merged``), and two documents agree in a register with a probability that grows
with their Jaccard similarity. A shingle's values are made in ascending order, as sums of
exponential gaps dealt to the registers by a permutation of its own, and it stops at the first
that can't raise any register; so a set of n shingles costs about n + M ln M steps, not n M.

Equal sets are one class. Classes whose registers agree in a whole band meet. A pair that
meets is judged by all registers jointly: with both sizes known, how many registers are
larger, smaller and equal has a likelihood for each similarity; a pair goes on unless its best
explanation below the threshold is TRUST natural log units likelier than the threshold itself.
What remains is verified on full sets.

Bounds: with 32 bands of 4 registers a pair at a similarity of 0.8 meets in none with a
probability of 5e-8 (at 0.85: 6e-11), and a linked pair is judged away with one below 1e-7.
Hot bands are never multiplied out: first each class meets the smallest of its bands' members,
then only classes of different components meet, dealt over tasks by sizes and shares.

Defined results are those of ``jaccard_join``: null, empty or wordless text has an empty set
and links with nothing; fewer words than a shingle are one shingle; rows that repeat an id are
one document; a row of null id takes its class's component, null if no id is in it; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, lean, mix, spread_join, stored
from .components import components
from .jaccard_join import PARITY, STAR, WORDS, _candidates, _texts, sets_of, shingles, verified

#: Registers (a power of two) and registers a band.
M, ROWS = 128, 4
B, A, LARGEST = 1.001, 20.0, 65_535
LN_B = float(np.log(B))
#: Natural log units by which a smaller similarity must be likelier to drop a pair.
TRUST = 16.0
#: Similarities below the threshold whose likelihood is looked at.
GRID = 64
_BAND = np.array([pow(0x9FB21C651E98DF25, i + 1, 1 << 64) for i in range(ROWS)], U64)


def sketches(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Registers (documents x M) of sets laid end to end; at: where each begins (n + 1)."""
    n = len(at) - 1
    low = np.zeros(n * M, np.uint16)
    doc = np.repeat(np.arange(n), np.diff(at))
    h = mix(sets ^ U64(0x6A09E667F3BCC909))
    slot, step = (h & U64(M - 1)).astype(np.int64), (h >> U64(32)).astype(np.int64) | 1
    x, seed = np.zeros(len(sets)), sets
    for j in range(M):
        if not len(doc):
            break
        u = (mix(seed + U64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)) >> U64(11)).astype(np.float64)
        x = x - np.log((u + 0.5) * 2.0**-53) / (A * (M - j))
        value = np.clip(np.floor(1 - np.log(x) / LN_B), 0, LARGEST)
        np.maximum.at(low, doc * M + ((slot + j * step) & (M - 1)), value.astype(np.uint16))
        if j < 8 or j % 8 == 7:  # who can still raise a register of its document
            least = low.reshape(n, M).min(axis=1).astype(np.float64)
            on = value >= least[doc]
            doc, slot, step, x, seed = doc[on], slot[on], step[on], x[on], seed[on]
    return low.reshape(n, M)


def merged(parts: np.ndarray) -> np.ndarray:
    """The sketch of a union from the sketches (rows) of its parts."""
    return parts.max(axis=0)


def band_tokens(registers: np.ndarray) -> np.ndarray:
    """64-bit hashes of each band's registers (documents x M // ROWS)."""
    r = registers.astype(U64).reshape(len(registers), M // ROWS, ROWS) + U64(1)
    return mix((r * _BAND).sum(axis=2, dtype=U64) + np.arange(M // ROWS, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _larger(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger in the set that alone has the share x of the union."""
    return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / LN_B


def log_likelihood(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity, given how many registers of a are larger, smaller and equal, and both sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = _larger(u - v * similarity), _larger(v - u * similarity)
    tiny = 1e-300
    return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))


def plausible(x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int, trust: float = TRUST) -> np.ndarray:
    """Which pairs of sketches (rows of x and y) may be as similar as the threshold."""
    above, below = (x > y).sum(axis=1)[:, None], (x < y).sum(axis=1)[:, None]
    a, b = n_a.astype(float)[:, None], n_b.astype(float)[:, None]
    most = np.minimum(percent / 100, np.minimum(a, b) / np.maximum(a, b))  # sizes alone allow no more
    least = np.array([1e-6])
    tried = least + (most - least) * np.linspace(0, 1, GRID)
    told = log_likelihood(above, below, M - above - below, a, b, tried)
    return told.max(axis=1) - told[:, -1] <= trust


def summaries(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, hi, lo, registers, tokens, parity) of every row: size and 128-bit digest of its set, its sketch, its bands' hashes, and the parities of its shingles' numbers modulo PARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(batch.column(1)):
                _, every, _, at = shingles(block, k)
                sets = [np.unique(every[at[d] : at[d + 1]]) for d in range(block.n)]
                n = np.array([len(s) for s in sets], np.int64)
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                odd = [np.packbits(np.bincount((s & U64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).view(np.int64) for s in sets]
                registers = sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))))
                half = lambda x: pa.array(np.array(x, U64).view(np.int64))
                lists = lambda m, width: pa.ListArray.from_arrays(pa.array(np.arange(block.n + 1) * width, pa.int32()), pa.array(m.reshape(-1).view(np.int64)))
                columns = [
                    ids.slice(block.first, block.n), pa.array(n), half([d >> 64 for d in digests]), half([d & 0xFFFFFFFFFFFFFFFF for d in digests]),
                    pa.array([r.tobytes() for r in registers], pa.binary()), lists(band_tokens(registers), M // ROWS), lists(np.concatenate(odd), WORDS),
                ]
                yield pa.record_batch(columns, names=["id", "n", "hi", "lo", "registers", "tokens", "parity"])

    return stored(docs.mapInArrow(lean(run), "id long, n long, hi long, lo long, registers binary, tokens array<bigint>, parity array<bigint>"))


def judged(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches' joint likelihood doesn't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, x, y = batch.columns
            matrix = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(c), M)
            keep = pa.array(plausible(matrix(x), matrix(y), n_a.to_numpy(), n_b.to_numpy(), percent) if len(a) else np.zeros(0, bool))
            yield pa.record_batch([a.filter(keep), b.filter(keep)], names=["a", "b"])

    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return stored(j.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(lean(run), "a long, b long"))


def decided(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link, as a stored table: only texts of pairs that were not ruled out are read again."""
    pairs = judged(pairs, classes, percent)
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    return stored(verified(pairs, sets_of(docs, ids, k), percent))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable by links of J >= percent / 100), kept (whether it is that one)."""
    docs = _texts(docs, key, text)
    rows = summaries(docs, k)
    classes = stored(rows.where("n > 0").groupBy("hi", "lo").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n", "registers", "tokens", "parity"))).alias("c")).where("c IS NOT NULL").select("hi", "lo", "c.*"))
    posted = classes.select(F.explode("tokens").alias("token"), "id", "n")
    lists = stored(posted.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("low")).where("c > 1"))
    shared = stored(spread_join(posted, lists, "token", "inner", counts=lists.select("token", F.col("c").alias("hot_n"))))

    # one pair a class: the smallest member that most of its hot bands name
    star = shared.where((F.col("c") > STAR) & (F.col("low") < F.col("id"))).groupBy("id", "low").agg(F.count(F.lit(1)).alias("m"))
    star = star.groupBy("id").agg(F.max(F.struct("m", (-F.col("low")).alias("low"))).alias("x")).select(F.col("id").alias("a"), (-F.col("x.low")).alias("b"))
    first = decided(star, classes, docs, k, percent)
    near = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # then only what lies in different components meets; any one shared band suffices
    p = shared.join(near.select(F.col("node").alias("id"), "component"), "id", "left")
    p = p.select("token", "id", "n", "c", F.lit(0).alias("pos"), F.lit(1).alias("level"), F.lit(1).alias("l"), "component", F.coalesce("component", "id").alias("comp"))
    several = p.groupBy("token").agg(F.min("comp").alias("lo_c"), F.max("comp").alias("hi_c")).where("lo_c <> hi_c").select("token")
    parity = classes.select("id", *[F.col("parity")[i].alias(f"s{i}") for i in range(WORDS)])
    p = stored(p.join(several, "token", "left_semi").join(parity, "id"))
    second = decided(_candidates(p, percent).select("a", "b").distinct(), classes, docs, k, percent)
    comp = components(first.unionAll(second).select(F.col("a").alias("u"), F.col("b").alias("v")))
    whole = classes.select("hi", "lo", F.col("id").alias("class_id"))
    out = rows.select("id", "n", "hi", "lo").join(whole, ["hi", "lo"], "left").join(comp.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    own = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))
    component = F.coalesce("component", own)
    return out.select("id", F.col("n").alias("n_shingles"), own.alias("class_id"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
