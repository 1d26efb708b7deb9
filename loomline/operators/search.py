"""Content search: ranked through the index, literally, exhaustively, or in part.

The query is a literal, planned on the driver; what runs is a filter of the postings to
the query's terms, one aggregate by document with a column per phrase, and an excerpt
function on the rows that are shown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spot
from ..functions import text as X
from ..functions.query import Query, Term
from .postings import Index

K1, B = 1.2, 0.75
MENTIONS = 1000
TERM_WEIGHT = 1e6


def _matches(token: str, prefix: bool) -> Column:
    return F.col("term").startswith(token) if prefix else F.col("term") == token


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - by)


def _frequencies(index: Index, phrases: list[tuple[list[str], bool]]) -> DataFrame:
    """(path, dl, f0, f1, ...): how often each phrase occurs in each document that has one of its words, and its length."""
    needs = sorted({(t, last and i == len(words) - 1) for words, last in phrases for i, t in enumerate(words)})
    any_of = reduce(lambda a, b: a | b, [_matches(t, p) for t, p in needs])
    rows = index.postings.where(any_of)
    aggs, outs = [], []
    for n, (words, last) in enumerate(phrases):
        if len(words) == 1:
            aggs.append(F.sum(F.when(_matches(words[0], last), F.col("tf")).otherwise(0)).alias(f"f{n}"))
            outs.append(F.col(f"f{n}"))
            continue
        for i, t in enumerate(words):
            at = F.flatten(F.collect_list(F.when(_matches(t, last and i == len(words) - 1), F.col("positions"))))
            aggs.append(_shifted(at, i).alias(f"p{n}_{i}"))
        outs.append(F.size(reduce(F.array_intersect, [F.col(f"p{n}_{i}") for i in range(len(words))])).cast("bigint").alias(f"f{n}"))
    return rows.groupBy("path").agg(F.max("dl").alias("dl"), *aggs).select("path", "dl", *outs)


def _scored(index: Index, freq: DataFrame, n: int, every: Column) -> DataFrame:
    """(path, score) by BM25 of the rows of freq that hold for ``every``. The few numbers that it takes over all documents are one row each, joined as such; their shuffle is the ranking's own, used again."""
    having = freq.agg(*[F.count_if((F.col("dl") > 0) & (F.col(f"f{i}") > 0)).alias(f"n{i}") for i in range(n)])
    rows = freq.where(every).crossJoin(F.broadcast(having)).crossJoin(F.broadcast(index.totals))
    score = sum((bm25(F.col(f"f{i}"), F.col("dl"), F.col("docs"), F.col("mean"), F.col(f"n{i}")) for i in range(n)), F.lit(0.0))
    return rows.select("path", score.alias("score"))


def bm25(f: Column, dl: Column, docs: Column, mean: Column, having: Column) -> Column:
    """One phrase's share; a phrase in over half of the documents counts next to nothing, not against."""
    idf = F.log((docs - having + 0.5) / (having + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean))


def indexed(index: Index, query: Query) -> DataFrame:
    """(path, score) of the documents that match every term."""
    terms = [t.phrases() for t in query.terms if t.has_words]
    phrases = [p for t in terms for p in t]
    if not phrases:
        return index.lengths.limit(0).select("path", F.lit(0.0).alias("score"))
    freq, at, every = _frequencies(index, phrases), 0, F.lit(True)
    for t in terms:
        every = every & reduce(lambda a, b: a | b, [F.col(f"f{at + i}") > 0 for i in range(len(t))], F.lit(False))
        at += len(t)
    return _scored(index, freq, len(phrases), every)


def partial(index: Index, query: Query) -> DataFrame:
    """(path, terms, score) of the documents with some of the terms, scores summed by term."""
    found = [indexed(index, Query((t,), t.text)) for t in query.terms if t.has_words]
    rows = reduce(DataFrame.unionAll, found)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("terms"), F.sum("score").alias("score"))


def mentions(text: Column, spelling: str) -> Column:
    """Non-overlapping places of a spelling, at most a thousand."""
    return F.least((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(spelling), F.lit("")))) / F.lit(len(spelling.encode())), F.lit(float(MENTIONS)))


def literal(bodies: DataFrame, query: Query, key: str = "path", text: str = "text", low: str | None = None) -> DataFrame:
    """(path, text, score) of the prose with every term as written, by damped counts. low: a column that holds the text in lower case already.

    Rows are chosen by ``contains`` first, which stops at a first place; places are counted in those alone.
    """
    ways = [[s.translate(str.maketrans(X.UPPER, X.LOWER)) for s in dict.fromkeys(t.spellings())] for t in query.terms]
    folded = bodies[low] if low else X.ascii_lower(bodies[text])
    some = lambda ss: reduce(lambda a, b: a | b, [F.contains("low", F.lit(s)) for s in ss])
    every = reduce(lambda a, b: a & b, map(some, ways), F.lit(bool(ways)))
    rows = bodies.select(bodies[key].alias("path"), bodies[text].alias("text"), folded.alias("low")).where(every)
    counts = [sum((mentions(F.col("low"), s) for s in ss), F.lit(0.0)) for ss in ways]
    return rows.select("path", "text", sum((F.log1p(c) for c in counts), F.lit(0.0)).alias("score"))


def scan(lines: DataFrame, query: Query) -> DataFrame:
    """(path, excerpt) of the transcripts whose conversation lines have every term somewhere. lines: path, offset, raw."""
    groups = query.needles()
    raw = F.col("raw")
    low = X.ascii_lower(raw)
    talk = ~raw.startswith('{"type":"') & ~raw.contains('"isMeta":true') & (raw.contains('"role":"user"') | raw.contains('"role":"assistant"'))
    some = reduce(lambda a, b: a | b, [low.contains(w) for ways in groups for w in ways], F.lit(False))
    hits = lines.where(talk & some).select("path", "offset", F.explode(spot.line_hits(raw, groups)).alias("hit"))
    by = hits.groupBy("path").agg(F.count_distinct("hit.group").alias("n"), F.min_by("hit.snippet", F.struct("offset", "hit.group")).alias("excerpt"))
    return by.where(F.col("n") == len(groups)).select("path", "excerpt")


def _values(raw: Column, keys: str) -> Column:
    return F.regexp_extract_all(raw, F.lit(f'"(?:{keys})":"([^"]*)"'), F.lit(1))


def file_hits(lines: DataFrame, typed: str) -> DataFrame:
    """Lines with a file's path in it that has the query in its value."""
    ways = Query((), typed).needles(whole=True)[0]
    return lines.where(F.exists(_values(F.col("raw"), "file_path|notebook_path|path"), lambda v: reduce(lambda a, b: a | b, [X.ascii_lower(v).contains(w) for w in ways])))


def tool_hits(lines: DataFrame, typed: str) -> DataFrame:
    """Lines of tool calls with the query in a name."""
    ways = Query((), typed).needles(whole=True)[0]
    named = F.exists(_values(F.col("raw"), "name"), lambda v: reduce(lambda a, b: a | b, [X.ascii_lower(v).contains(w) for w in ways]))
    return lines.where(F.col("raw").contains('"tool_use"') & named)


def structured(lines: DataFrame, typed: str, mode: str) -> DataFrame:
    """(path, excerpt) of a file or tool search."""
    found = (file_hits if mode == "file" else tool_hits)(lines, typed)
    return found.groupBy("path").agg(F.min_by("raw", "offset").alias("raw")).select("path", spot.excerpt(F.col("raw"), typed, True).alias("excerpt"))


def lifted(hits: DataFrame, titles: DataFrame, typed: str) -> DataFrame:
    """hits (path, score, ...) of known sessions (path, title), up to doubled by the share of the terms that the title has."""
    n = len(spot.Spotter.of(typed).terms)
    h = hits.join(titles, "path")
    return h.withColumn("score", F.col("score") * (1 + spot.terms_in(F.col("title"), typed) / F.lit(float(n)))) if n else h


def run(index: Index, bodies: DataFrame, lines: DataFrame, sessions: DataFrame, typed: str, mode: str = "content") -> tuple[DataFrame, str]:
    """(path, score, excerpt or null) and how it was found: indexed, scanned or partial. mode: content, file, tool, everything."""
    titles = sessions.select("path", "title")
    q = Query.parse(typed)
    none = sessions.limit(0).select("path", F.lit(0.0).alias("score"), F.lit("").alias("excerpt"))
    if not typed.strip():
        return none, "indexed"
    if mode == "content" and q:
        if q.beyond_tokens():
            found = lifted(literal(bodies, q), titles, typed).select("path", "score", spot.excerpt(F.col("text"), typed).alias("excerpt"))
        else:
            found = lifted(indexed(index, q), titles, typed).select("path", "score", F.lit(None).cast("string").alias("excerpt"))
        if not found.isEmpty():
            return found, "indexed"
    if mode in ("file", "tool"):
        hits = structured(lines, typed, mode)
    else:
        hits = scan(lines, q if q else Query((Term(typed.strip()),), typed))
    hits = hits.join(titles, "path", "left_semi").select("path", F.lit(0.0).alias("score"), "excerpt")
    if mode != "content" or len(q.terms) < 2 or q.beyond_tokens() or not hits.isEmpty():
        return hits, "scanned"
    some = partial(index, q)
    some = lifted(some, titles, typed).select("path", (F.col("terms") * TERM_WEIGHT + F.col("score")).alias("score"), F.lit(None).cast("string").alias("excerpt"))
    return (hits, "scanned") if some.isEmpty() else (some, "partial")


def with_excerpts(hits: DataFrame, bodies: DataFrame, typed: str) -> DataFrame:
    """Fills the excerpts of hits that have none from the stored prose."""
    return hits.join(bodies.select("path", "text"), "path", "left").select(*[c for c in hits.columns if c != "excerpt"], F.coalesce("excerpt", spot.excerpt(F.col("text"), typed)).alias("excerpt"))


def parents_of_hits(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """(id) of the sessions whose subagents were found."""
    return sessions.where("is_subagent AND parent IS NOT NULL").join(hits.select("path"), "path", "left_semi").select(F.col("parent").alias("id")).distinct()


def session_scores(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, score): a session's own best and its subagents'; a subagent scores under its own id too."""
    s = sessions.join(hits.select("path", "score"), "path")
    ids = F.array_distinct(F.when(F.col("is_subagent"), F.array("parent", "id")).otherwise(F.array("id")))
    return s.select(F.explode(ids).alias("id"), "score").where("id IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))


def results(sessions: DataFrame, hits: DataFrame) -> DataFrame:
    """Sessions to list for hits, best first: parents stand in for their subagents, orphans for themselves. (id, path, title, cwd, mtime, score, excerpt, rank order applied)."""
    tops = sessions.where("NOT is_subagent").select("id")
    orphan = sessions.where("is_subagent").join(tops.withColumnRenamed("id", "parent"), "parent", "left_anti").select("path")
    shown = sessions.where("NOT is_subagent").select("path").unionAll(orphan)
    kids = sessions.where("is_subagent").join(hits, "path").where("excerpt <> ''").groupBy(F.col("parent").alias("id")).agg(F.min_by("excerpt", F.struct(-F.col("mtime"), "path")).alias("kid_excerpt"))
    own = hits.select("path", F.col("excerpt").alias("own_excerpt"))
    s = sessions.join(shown, "path", "left_semi").join(session_scores(sessions, hits), "id").join(own, "path", "left").join(kids, "id", "left")
    return s.select("id", "path", "title", "cwd", "mtime", "score", F.coalesce("own_excerpt", "kid_excerpt", F.lit("")).alias("excerpt")).orderBy(F.desc("score"), F.desc("mtime"), "path")
