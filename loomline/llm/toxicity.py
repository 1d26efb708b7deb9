"""Toxicity by weak supervision.

Many voters, each a yes or an abstention on a text: words of a seed lexicon; words, word
beginnings and sets of words that begin alike, mined from the labelled training rows;
patterns over these (two different ones, a dense text, one right after an address). Votes are counted over all
documents: means and pairwise second moments, a fixed-size matrix summed over tasks.

The label model is generative. Given the true label, voters are independent but for
listed pairs, so off those pairs the covariance of votes has rank one: cov(i, j) =
var(Y) s_i s_j, where s is a voter's rate on toxic texts less its rate on others. So each
triplet of voters gives var(Y) s_i s_i = cov(i, j) cov(i, k) / cov(j, k), and the median
over triplets is the estimate, which a few correlated pairs don't move; pairs whose
covariance exceeds the fit are set aside as correlated, and the fit repeated. A voter's weight in the posterior is
divided by one plus the correlation it shares with its pairs. A training row's own
label counts as one more voter of a fixed accuracy, which the others can outvote.

A linear classifier, logistic regression over hashed words, word beginnings and sets of
words that begin alike that the training rows support, is trained on the posteriors and scores every whole text. Model
and matrices have fixed sizes. Training rows are at most ``bound`` labelled ones and, of
all other documents outside the held-out fold, about ``bound`` taken by a hash of the id
and about ``PER_VOTER`` of those that a lexicon voter votes on, for each such voter: a
word that is rare in the corpus is not rare in the training rows.

Defined results: null or empty text has no features and gets the intercept's score;
repeated rows are scored each; without labels the seed lexicon's voters alone teach the
classifier; documents of null id train nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, U64, Block, blocks, lean, runs, span_hashes
from .folds import is_held_out, training_rows

BOUND = 8_000
BINS = 1 << 20
FEATURES = 4096
MINED = 64
GOLD = 0.97
PER_VOTER = 64
#: Rows that the rates from the votes' moments weigh as much as.
TRUST = 50
#: A mined voter must vote on rows that fewer voters than this vote on.
COVER = 4
#: Bytes of word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7)
#: So many different words of a text that begin alike are a feature, and may be a voter, of their own: BINS + the beginning's bin. Inflected words seldom repeat, their stem does.
MANY = 3
SEED = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool imbecile garbage ugly hate "
    "idiota imbécil estúpido basura asqueroso tonto inútil idiot imbécile connard stupide ordure débile "
    "dumm idiotin arschloch abschaum dreck widerlich"
).split()
ADDRESS = "you your this that what an a du sie tu vous eres es".split()
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


def _hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def _words(block: Block) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(owner of each word, its bins: the word's, then its beginnings' (-1: it is no longer than that), words per text)."""
    b = ASCII_LOWER[block.buf]
    upper = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
    b[upper] += 0x20
    start, end = runs(_LETTER[b])
    owner = np.searchsorted(block.at, start, "right") - 1
    bins = [_bin(span_hashes(b, start, end))]
    for n in BEGINNINGS:
        long = end - start > n
        own = np.full(len(start), -1)
        own[long] = _bin(span_hashes(b, start[long], start[long] + n) + U64(n))
        bins.append(own)
    return owner, bins, np.bincount(owner, minlength=block.n)


def _many(owner: np.ndarray, word: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, what) of those that MANY different words share. what: below 1 << 21, -1 for none."""
    some = np.flatnonzero(what >= 0)
    keys = np.unique(owner[some] << 41 | what[some] << 20 | word[some]) >> 20
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    keys = keys[new[np.diff(np.concatenate((new, [len(keys)]))) >= MANY]]
    return keys >> 21, keys & ((1 << 21) - 1)


def _bin(h: np.ndarray) -> np.ndarray:
    return (h >> U64(44)).astype(np.int64)


@dataclass(frozen=True)
class Voters:
    """table: for each feature, 1 + the voter it wakes (0: none); address: bins of words that a text addresses someone by."""

    table: np.ndarray
    address: np.ndarray
    lexicon: int

    @property
    def n(self) -> int:
        return self.lexicon + 4

    def votes(self, block: Block) -> np.ndarray:
        """texts x voters, 0 or 1: lexicon voters, then two different, three, dense, addressed."""
        owner, bins, words = _words(block)
        out = np.zeros((block.n, self.n), bool)
        any_of = np.zeros(len(owner), bool)
        for b in bins:
            v = np.where(b >= 0, self.table[b], 0)
            hit = v > 0
            out[owner[hit], v[hit] - 1] = True
            any_of |= hit
        for b in bins[1:]:
            v = np.where(b >= 0, self.table[BINS + b], 0)
            text, voter = _many(owner, bins[0], v - 1)
            out[text, voter] = True
        distinct = out[:, : self.lexicon].sum(axis=1)
        hits = np.bincount(owner[any_of], minlength=block.n)
        out[:, -4], out[:, -3] = distinct >= 2, distinct >= 3
        out[:, -2] = hits * 200 >= np.maximum(words, 1)
        after = any_of[1:] & self.address[bins[0][:-1]] & (owner[1:] == owner[:-1])
        out[owner[1:][after], -1] = True
        return out


def _presence(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(owner, feature) of the distinct features of each text."""
    owner, bins, _ = _words(block)
    parts = [(owner[b >= 0], b[b >= 0]) for b in bins]
    parts += [(o, BINS + b) for o, b in (_many(owner, bins[0], b) for b in bins[1:])]
    keys = np.unique(np.concatenate([o << 32 | b for o, b in parts]))
    return keys >> 32, keys & 0xFFFFFFFF


def _sample(rows: DataFrame, key: str, voters: Voters | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The distinct bins, labels and votes of training rows, ordered by id and label."""
    width = voters.n if voters else 0
    shared = rows.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for block in blocks(batch.column(1)):
                o, b = _presence(block)
                cut = np.searchsorted(o, np.arange(block.n + 1))
                own = [b[cut[i] : cut[i + 1]].astype("<i4").tobytes() for i in range(block.n)]
                votes = v.votes(block) if v else np.zeros((block.n, 0), bool)
                yield pa.record_batch([batch.column(0).slice(block.first, block.n), pa.array(own, pa.binary()), batch.column(2).slice(block.first, block.n), pa.array([x.tobytes() for x in votes], pa.binary())], names=["key", "bins", "y", "votes"])

    found = rows.select(F.col(key).cast("string").alias("key"), "text", "y").mapInArrow(lean(run), "key string, bins binary, y double, votes binary").toPandas().sort_values(["key", "y"])
    votes = np.array([np.frombuffer(x, bool) for x in found["votes"]], bool).reshape(len(found), width)
    return [np.frombuffer(b, "<i4") for b in found["bins"]], (found["y"].to_numpy(float) > 0).astype(float), votes


def _unlabelled(docs: DataFrame, labels: DataFrame, label: str, key: str, folds: int, fold: int, voters: Voters, chance: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bins and votes of documents without a label and outside the fold, ordered by id, one row of an id that is repeated. chance: of a document, by each lexicon voter that votes on it, and (last) of any."""
    shared = docs.sparkSession.sparkContext.broadcast((voters, chance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, c = shared.value
        for batch in batches:
            draw = batch.column(2).to_numpy()
            for block in blocks(batch.column(1)):
                votes = v.votes(block)
                most = np.maximum(np.where(votes[:, : v.lexicon], c[:-1], 0).max(axis=1, initial=0), c[-1])
                taken = np.flatnonzero(draw[block.first : block.first + block.n] < most)
                if len(taken):
                    o, b = _presence(block)
                    own = [b[np.searchsorted(o, i) : np.searchsorted(o, i + 1)].astype("<i4").tobytes() for i in taken]
                    yield pa.record_batch([batch.column(0).take(pa.array(block.first + taken)), pa.array(own, pa.binary()), pa.array([x.tobytes() for x in votes[taken]], pa.binary())], names=["key", "bins", "votes"])

    d = docs.where(F.col(key).isNotNull() & ~is_held_out(F.col(key), folds, fold))
    draw = F.pmod(F.xxhash64(F.lit("draw"), key), F.lit(1 << 40)) / float(1 << 40)
    d = d.select(F.col(key).cast("string").alias("key"), "text", draw.alias("draw"))
    found = d.mapInArrow(lean(run), "key string, bins binary, votes binary")
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).cast("string").alias("key"))
    one = F.min(F.struct("bins", "votes")).alias("one")  # a row of an id: repeated ids share their draw, and all of them could be very many
    found = found.join(known, "key", "left_anti").groupBy("key").agg(one).select("key", "one.bins", "one.votes").toPandas()
    found = found.sort_values(["key", "bins"])
    return [np.frombuffer(b, "<i4") for b in found["bins"]], np.array([np.frombuffer(x, bool) for x in found["votes"]], bool).reshape(len(found), voters.n)


def _supported(bins: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins by how far their toxic and other rows differ: (bin, log-odds ratio, z), strongest first. y may be shares."""
    pos, total = np.zeros(2 * BINS), np.zeros(2 * BINS)
    for i in range(0, len(bins), 1000):  # some rows at a time: all features with their labels would be the driver's largest arrays
        part = bins[i : i + 1000]
        every = np.concatenate(part)
        pos += np.bincount(every, np.repeat(y[i : i + 1000], [len(b) for b in part]), 2 * BINS)
        total += np.bincount(every, minlength=2 * BINS)
    neg = total - pos
    p, n = y.sum(), len(y) - y.sum()
    some = np.flatnonzero(total >= 3)
    a, b = pos[some] + 0.5, neg[some] + 0.5
    odds = np.log(a / (p - pos[some] + 0.5)) - np.log(b / (n - neg[some] + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b + 1 / (p - pos[some] + 0.5) + 1 / (n - neg[some] + 0.5))
    order = np.argsort(-np.abs(z), kind="stable")
    return some[order], odds[order], z[order]


def _voters(bins: list[np.ndarray], y: np.ndarray) -> Voters:
    """A voter per seed word and per mined bin that is toxic well beyond chance, but for bins in the same rows as a voter's (a word and its beginnings are one voter) and in rows that COVER voters know."""
    table, n = np.zeros(2 * BINS, np.int32), 0
    for w in dict.fromkeys(SEED):
        n += 1
        table[_bin(np.array([_hash(w)], U64))[0]] = n
    if len(y) and 0 < y.sum() < len(y):
        found, odds, z = _supported(bins, y)
        found = found[(z > 3) & (odds > 2)]
        rows: dict[int, set[int]] = {int(b): set() for b in [*found, *np.flatnonzero(table)]}
        for i, own in enumerate(bins):
            for b in own[np.isin(own, list(rows))]:
                rows[int(b)].add(i)
        taken = [rows[int(b)] for b in np.flatnonzero(table)]
        covered = np.zeros(len(y), int)
        for own in taken:
            covered[list(own)] += 1
        for b in found:
            if n >= MINED + len(dict.fromkeys(SEED)):
                break
            own = rows[int(b)]
            fresh = sum(covered[i] < COVER and y[i] > 0 for i in own)
            if not table[b] and fresh >= 3 and all(len(own & r) < 0.8 * len(own | r) for r in taken):
                n += 1
                table[b] = n
                taken.append(own)
                covered[list(own)] += 1
    address = np.zeros(BINS, bool)
    address[_bin(np.array([_hash(w) for w in ADDRESS], U64))] = True
    return Voters(table, address, n)


def _moments(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray]:
    """Documents, and how often each pair of voters votes together (the diagonal: each voter), over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total, n = np.zeros((v.n, v.n)), 0
        for batch in batches:
            for block in blocks(batch.column(0)):
                votes = v.votes(block)
                votes = votes[votes.any(axis=1)].astype(float)
                total += votes.T @ votes
                n += block.n
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array([-1, *at.tolist()], pa.int64()), pa.array([float(n), *total.ravel()[at]])], names=["cell", "n"])

    total, n = np.zeros(voters.n**2), 0
    for cell, x in docs.select("text").mapInArrow(lean(run), "cell long, n double").groupBy("cell").agg(F.sum("n")).collect():
        if cell < 0:
            n = int(x)
        else:
            total[cell] = x
    return n, total.reshape(voters.n, voters.n)


@dataclass(frozen=True)
class LabelModel:
    """Rates of each voter on toxic and other texts, weights for its correlations, the share of toxic texts, and how much abstentions say (1: as much as if they were independent)."""

    on: np.ndarray
    off: np.ndarray
    weight: np.ndarray
    prior: float
    correlated: np.ndarray
    quiet: float = 1.0

    def heard(self, votes: np.ndarray, y: np.ndarray) -> "LabelModel":
        """The model after labelled rows: its rates count as TRUST rows of either label beside these. Abstentions are scaled to what those of all voters together say on these rows: a text in one language wakes no voter of another, so they are far from independent."""
        ones = y > 0
        rates = [(votes[of].sum(axis=0) + TRUST * rate) / (of.sum() + TRUST) for of, rate in ((ones, self.on), (~ones, self.off))]
        on, off = np.clip(np.maximum(*rates), 1e-4, 0.98), np.clip(np.minimum(*rates), 1e-4, 0.98)
        some = votes.any(axis=1)
        a1, a0 = ((some[of].sum() + 1) / (of.sum() + 2) for of in (ones, ~ones))
        every = float((self.weight * np.log((1 - on) / (1 - off))).sum())
        return replace(self, on=on, off=off, quiet=float(np.clip(np.log((1 - a1) / (1 - a0)) / every, 0, 1)) if every < 0 else 1.0)

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        yes, no = np.log(self.on / self.off), self.quiet * np.log((1 - self.on) / (1 - self.off))
        return np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * (yes - no)) + float((self.weight * no).sum())


def label_model(n: int, together: np.ndarray, prior: float, rounds: int = 4) -> LabelModel:
    """Fits the voters' rates and correlations to their moments over n documents."""
    k = len(together)
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    free = ~np.eye(k, dtype=bool)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    sure = cov > 4 * np.outer(scale, scale) / np.sqrt(max(n, 1))
    s = excess = None
    for turn in range(rounds):
        use = free & sure
        ratio = np.where(use[:, :, None] & use[:, None, :] & use[None], cov[:, :, None] * cov[:, None, :] / np.where(use, cov, 1)[None], np.nan)
        flat = ratio.reshape(k, -1)
        some = ~np.isnan(flat).all(axis=1)
        s = np.where(some, np.sqrt(np.maximum(np.nanmedian(np.where(some[:, None], flat, 0), axis=1), 0)), 0)
        excess = (cov - np.outer(s, s)) / np.outer(scale, scale)
        if turn < rounds - 1:
            free &= ~(excess > 0.1)
    correlated = np.where(free | np.eye(k, dtype=bool), 0, np.clip(excess, 0, 1))
    spread = np.sqrt(prior * (1 - prior))
    gap = s / spread
    on = np.clip(mean + (1 - prior) * gap, 1e-4, 0.98)
    off = np.clip(np.maximum(mean - prior * gap, on * prior / (1 - prior) * (1 - GOLD) / GOLD), 1e-4, 0.98)  # no vote is surer than a label
    return LabelModel(np.maximum(on, off), np.minimum(on, off), 1 / (1 + correlated.sum(axis=1)), prior, correlated)


@dataclass(frozen=True)
class Classifier:
    bins: np.ndarray  # ascending
    weight: np.ndarray
    intercept: float

    def score(self, block: Block) -> np.ndarray:
        owner, bins, _ = _words(block)
        place = lambda b: np.minimum(np.searchsorted(self.bins, b), len(self.bins) - 1)
        keys = [np.zeros(0, np.int64)]
        for b in bins if len(self.bins) else ():
            at = place(b)
            hit = self.bins[at] == b
            keys.append(owner[hit] << 32 | at[hit])
        for b in bins[1:] if len(self.bins) else ():
            at = place(BINS + b)
            text, at = _many(owner, bins[0], np.where((b >= 0) & (self.bins[at] == BINS + b), at, -1))
            keys.append(text << 32 | at)
        keys = np.unique(np.concatenate(keys))
        margin = self.intercept + np.bincount(keys >> 32, self.weight[keys & 0xFFFFFFFF], block.n)
        return 1 / (1 + np.exp(-margin))


def _logistic(rows: list[np.ndarray], target: np.ndarray, width: int, l2: float = 0.3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows and soft targets, by accelerated gradient steps."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    n = len(target)
    base = np.log((target.sum() + 1) / (n - target.sum() + 1))
    w, c, v, vc = np.zeros(width), base, np.zeros(width), base
    rate = 4.0 / (max([len(r) for r in rows], default=1) + 1 + l2)
    for i in range(steps):
        error = 1 / (1 + np.exp(-(np.bincount(owner, v[column], n) + vc))) - target
        nw, nc = v - rate * (np.bincount(column, error[owner], width) + l2 * v) / max(1.0, n / 200), vc - rate * error.sum() / max(n, 1)
        m = i / (i + 3)
        v, vc = nw + m * (nw - w), nc + m * (nc - c)
        w, c = nw, nc
    return w, float(c)


def posteriors(model: LabelModel, votes: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """Chance of toxic by the voters, and by the row's label y as one more voter of accuracy GOLD."""
    odds = model.log_odds(votes.astype(float))
    if y is not None:
        odds = odds + np.where(y > 0, 1, -1) * np.log(GOLD / (1 - GOLD))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0, bound: int = BOUND, key: str = "doc_id") -> tuple[Classifier, LabelModel, Voters]:
    """docs has key and text. Label model over all documents, classifier on the posteriors of labelled and other training rows."""
    rows = training_rows(docs, labels, label, folds, fold, bound, key)
    bins, y, _ = _sample(rows, key)
    voters = _voters(bins, y)
    prior = (y.sum() + 1) / (len(y) + 10)
    n, together = _moments(docs, voters)
    model = label_model(n, together, float(prior))
    bins, y, votes = _sample(rows, key, voters)
    model = model.heard(votes, y)
    target = posteriors(model, votes, y)
    chance = np.append(PER_VOTER / np.maximum(np.diag(together)[: voters.lexicon], 1), bound / max(n, 1))
    more, heard = _unlabelled(docs, labels, label, key, folds, fold, voters, chance)
    bins, target = bins + more, np.concatenate([target, posteriors(model, heard)])
    if not len(target):
        return Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior)))), model, voters
    y = target
    found, _, z = _supported(bins, y)
    kept = np.sort(found[np.abs(z) > 2][:FEATURES])
    rows = []
    for b in bins:
        at = np.minimum(np.searchsorted(kept, b), max(0, len(kept) - 1))
        rows.append(at[kept[at] == b] if len(kept) else np.zeros(0, np.int64))
    w, c = _logistic(rows, target, len(kept))
    return Classifier(kept, w, c), model, voters


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    d = docs.select(docs[key].alias(key), docs[text].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(d, labels, key=key)[0])
    kind = d.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(b) for b in blocks(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(s) if s else np.zeros(0))], names=["key", "score"])

    s = d.mapInArrow(lean(run), f"key {kind}, score double")
    return s.select(F.col("key").alias(key), is_held_out(F.col("key"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
