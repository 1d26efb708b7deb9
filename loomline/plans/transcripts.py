"""Queries that send whole JSON lines through the transcript path, with their SQL.

Conversations become transcripts: a message line a turn, a title line for what the system
says, a last-prompt line beside each question of every other conversation, and one
injected line each. Offsets are 10 a turn. All of it runs through the library's own
classification, rollup, prose and turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lines as L
from ..operators import prose, report, rollup, short, turns
from ..sources import sink
from ..sources import transcripts as source
from ..sources.storage import work_dir
from .base import REAL, SQUASH, SQUASH_ALL, dealt, query

_STAMP = "1700000000 + conv_id * 1000 + turn * 7"
LINES = f"""ln AS (SELECT conv_id, turn, turn * 10 AS off, role AS kind, coalesce(text, '') AS text, {_STAMP} AS ts FROM conversations
 UNION ALL SELECT conv_id, turn, turn * 10 + 5, 'last-prompt', coalesce(text, ''), NULL FROM conversations WHERE role = 'user' AND conv_id % 2 = 1
 UNION ALL SELECT conv_id, turn, turn * 10 + 7, 'meta', 'injected note', {_STAMP} FROM conversations WHERE turn = 0)"""


def transcript_lines(t) -> DataFrame:
    """(path, offset, raw) of all conversations as JSON lines."""
    c = dealt(t("conversations")).select(F.col("conv_id").cast("string").alias("path"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("turn") * 7), "yyyy-MM-dd'T'HH:mm:ss'.250Z'").alias("timestamp")
    inner = {"user": F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))}
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    model = F.when(F.col("turn") % 3 == 2, "<synthetic>").otherwise(F.concat(F.lit("m"), F.col("turn") % 3)).alias("model")
    usage = F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens"), F.lit(1).alias("cache_read_input_tokens"), F.lit(2).alias("cache_creation_input_tokens")).alias("usage")
    inner["assistant"] = F.struct(F.lit("assistant").alias("role"), block.alias("content"), model, F.concat(F.lit("r"), F.floor(F.col("turn") / 4)).alias("id"), usage)
    place = [F.concat(F.lit("/w/r"), F.col("conv_id") % 5, F.lit("/s"), F.col("turn") % 3).alias("cwd"), F.concat(F.lit("b"), "turn").alias("gitBranch"), F.lit("1.2.3").alias("version")]
    message = lambda role: F.to_json(F.struct(F.lit("u").alias("uuid"), inner[role].alias("message"), F.lit(role).alias("type"), *place, stamp))
    titled = F.to_json(F.struct(F.lit("ai-title").alias("type"), F.col("text").alias("aiTitle")))
    asked = F.to_json(F.struct(F.lit("last-prompt").alias("type"), F.col("text").alias("lastPrompt")))
    injected = F.to_json(F.struct(F.lit("u").alias("uuid"), F.lit(True).alias("isMeta"), F.struct(F.lit("user").alias("role"), F.lit("injected note").alias("content")).alias("message"), F.lit("user").alias("type"), stamp))
    line = lambda raw, more: F.struct((F.col("turn") * 10 + more).alias("offset"), raw.alias("raw"))
    main = F.when(F.col("role") == "user", message("user")).when(F.col("role") == "assistant", message("assistant")).otherwise(titled)
    every = F.array(line(main, 0), F.when((F.col("role") == "user") & (F.col("conv_id") % 2 == 1), line(asked, 5)), F.when(F.col("turn") == 0, line(injected, 7)))
    return c.select("path", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("l")).select("path", "l.offset", "l.raw")


def sessions(t, **most: int | None) -> DataFrame:
    """most: of titles and prompts, as classify has it."""
    typed = L.classify(transcript_lines(t), **most)
    files = t("conversations").select(F.col("conv_id").cast("string").alias("path")).distinct()
    files = files.select("path", F.col("path").alias("id"), F.lit("p").alias("project_dir"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), F.lit(False).alias("is_subagent"), F.lit(None).cast("string").alias("parent"))
    return rollup.sessions(rollup.segments(typed), files)


_SAYS = "kind IN ('user', 'assistant')"
_USAGE = "SELECT *, lag(turn // 4) OVER (PARTITION BY conv_id ORDER BY off) AS before FROM ln WHERE kind = 'assistant'"
SESSIONS = f"""WITH {LINES}, u AS (SELECT conv_id, sum(length(text)) AS in_tokens, sum(turn) AS out_tokens, count(*) AS cache_read, 2 * count(*) AS cache_write FROM ({_USAGE}) WHERE before IS DISTINCT FROM turn // 4 GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS entries, count(*) FILTER (kind IN ('user', 'meta')) AS user_msgs, count(*) FILTER (kind = 'assistant') AS assistant_msgs,
 arg_max({SQUASH.format(c="text", n=160)}, off) FILTER (kind = 'system' AND trim(text) <> '') AS ai_title, arg_min({SQUASH.format(c="text", n=200)}, off) FILTER (kind = 'user' AND {REAL}) AS first_prompt,
 arg_max({SQUASH.format(c="text", n=200)}, off) FILTER (kind = 'last-prompt' AND {REAL}) AS last_prompt, arg_min('/w/r' || conv_id % 5 || '/s' || turn % 3, off) FILTER ({_SAYS}) AS cwd, arg_min('b' || turn, off) FILTER ({_SAYS}) AS git_branch,
 arg_max('m' || turn % 3, off) FILTER (kind = 'assistant' AND turn % 3 <> 2) AS model, arg_min(ts, off) FILTER (ts IS NOT NULL AND (kind IN ('user', 'assistant', 'meta'))) AS first_ts, max(ts) FILTER (kind IN ('user', 'assistant', 'meta')) AS last_ts FROM ln GROUP BY conv_id)
SELECT s.conv_id::VARCHAR AS path, entries, user_msgs, assistant_msgs, coalesce(ai_title, '') AS ai_title, coalesce(first_prompt, '') AS first_prompt, coalesce(last_prompt, '') AS last_prompt, coalesce(cwd, '') AS cwd, coalesce(git_branch, '') AS git_branch, coalesce(model, '') AS model,
 coalesce(first_ts, 0) AS first_ts, coalesce(last_ts, 0) AS last_ts, coalesce(in_tokens, 0)::BIGINT AS in_tokens, coalesce(out_tokens, 0)::BIGINT AS out_tokens, coalesce(cache_read, 0)::BIGINT AS cache_read, coalesce(cache_write, 0)::BIGINT AS cache_write FROM s LEFT JOIN u ON s.conv_id = u.conv_id"""
#: With whole first prompts.
SESSIONS_ASKED = SESSIONS.replace(SQUASH.format(c="text", n=200), SQUASH_ALL.format(c="text"))
FIELDS = "path entries user_msgs assistant_msgs ai_title first_prompt last_prompt cwd git_branch model first_ts last_ts in_tokens out_tokens cache_read cache_write".split()


@query(SESSIONS)
def session_rollup(t):
    return sessions(t).select(*FIELDS)


@query(SESSIONS, "session_rollup_merged")
def _merged(t):
    """The same from two halves of every transcript, merged."""
    typed = L.classify(transcript_lines(t))
    two = rollup.merge(rollup.segments(typed.where("offset < 25")), rollup.segments(typed.where("offset >= 25")))
    files = sessions(t).select("path", "id", "project_dir", "size", "mtime", "is_subagent", "parent")
    return rollup.sessions(two, files).select(*FIELDS)


@query(f"SELECT path, CASE WHEN ai_title <> '' THEN ai_title WHEN first_prompt <> '' THEN first_prompt ELSE '(untitled session)' END AS title FROM ({SESSIONS})")
def title_fallback(t):
    return sessions(t).select("path", X.title(F.col("custom_title"), F.col("ai_title"), F.col("first_prompt"), F.col("is_subagent")).alias("title"))


_OPENING = "regexp_replace(lower({c}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_CUE = "CASE WHEN last_prompt <> '' THEN last_prompt ELSE first_prompt END"


@query(f"SELECT path, CASE WHEN left({_OPENING.format(c='cue')}, 24) = left({_OPENING.format(c='title')}, 24) AND {_OPENING.format(c='cue')} <> '' THEN '' ELSE cue END AS cue FROM (SELECT path, {_CUE} AS cue, CASE WHEN ai_title <> '' THEN ai_title WHEN first_prompt <> '' THEN first_prompt ELSE '(untitled session)' END AS title FROM ({SESSIONS}))")
def left_off(t):
    s = sessions(t).withColumn("title", X.title(F.col("custom_title"), F.col("ai_title"), F.col("first_prompt"), F.col("is_subagent")))
    return s.select("path", X.left_off(F.col("title"), F.col("first_prompt"), F.col("last_prompt")).alias("cue"))


@query(f"SELECT * FROM (SELECT unnest(['sessions', 'subagents', 'bytes', 'entries', 'with_title', 'with_cwd', 'with_branch', 'in_tokens', 'out_tokens', 'cache_read', 'cache_write', 'total_tokens']) AS metric, unnest([count(*), 0, 0, sum(entries), count(*) FILTER (ai_title <> ''), count(*) FILTER (cwd <> ''), count(*) FILTER (git_branch <> ''), sum(in_tokens), sum(out_tokens), sum(cache_read), sum(cache_write), sum(in_tokens + out_tokens + cache_read + cache_write)])::BIGINT AS value FROM ({SESSIONS}))")
def corpus_stats(t):
    return report.stats(sessions(t))


@query(f"WITH {LINES} SELECT conv_id::VARCHAR AS path, string_agg(regexp_replace(text, '[\\n\\t\\r]', ' ', 'g') || ' ', '' ORDER BY off) AS text FROM ln WHERE {_SAYS} AND text <> '' GROUP BY conv_id")
def prose_bodies(t):
    return prose.bodies(L.classify(transcript_lines(t)))


_TRIM = "regexp_replace({c}, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g')"
TURNS = f"WITH {LINES} SELECT conv_id::VARCHAR AS path, off AS \"offset\", CASE WHEN kind = 'user' THEN 'you' ELSE 'assistant' END AS role, {_TRIM.format(c='text')} AS text FROM ln WHERE {_SAYS} AND {_TRIM.format(c='text')} <> '' AND (kind = 'assistant' OR ({REAL}))"


@query(TURNS, "turns")
def _turns(t):
    return turns.extract(transcript_lines(t)).select("path", F.col("offset").cast("long").alias("offset"), "role", "text")


@query(f"SELECT path, \"offset\", terms, terms > 0 AND row_number() OVER (PARTITION BY path ORDER BY terms DESC, \"offset\") = 1 AS focus FROM (SELECT path, \"offset\", (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])the'))::INT + (regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])an'))::INT AS terms FROM ({TURNS}))", "marked_turns")
def _marked(t):
    return turns.marked(turns.extract(transcript_lines(t)), "the an").select("path", F.col("offset").cast("long").alias("offset"), "terms", "focus")


@query(f"WITH {LINES} SELECT conv_id::VARCHAR AS path, off AS \"offset\", kind = 'user' OR kind = 'meta' AS is_user, kind = 'assistant' AS is_assistant, CASE WHEN {_SAYS} OR kind = 'meta' THEN ts END AS ts, CASE WHEN {_SAYS} THEN '/w/r' || conv_id % 5 || '/s' || turn % 3 END AS cwd, CASE WHEN kind = 'assistant' AND turn % 3 <> 2 THEN 'm' || turn % 3 END AS model, CASE WHEN kind = 'assistant' THEN 'r' || turn // 4 END AS usage_id FROM ln")
def classified_lines(t):
    return L.classify(transcript_lines(t)).select("path", F.col("offset").cast("long").alias("offset"), "is_user", "is_assistant", "ts", "cwd", "model", "usage_id")


@query(f"WITH {LINES} SELECT conv_id::VARCHAR AS path, off AS \"offset\", CASE WHEN kind IN ('user', 'meta') THEN text ELSE '' END AS said FROM ln")
def user_texts(t):
    """Of user lines; what others say is no user's text."""
    ln = transcript_lines(t)
    user = ~F.col("raw").startswith('{"type":"') & F.col("raw").contains('"role":"user"')
    return ln.select("path", F.col("offset").cast("long").alias("offset"), F.when(user, L.user_text(F.col("raw"))).otherwise("").alias("said"))


@query(f"WITH {LINES} SELECT conv_id::VARCHAR AS path, off AS \"offset\", CASE kind WHEN 'system' THEN text END AS title, CASE kind WHEN 'last-prompt' THEN text END AS prompt FROM ln")
def json_strings(t):
    raw = F.col("raw")
    return transcript_lines(t).select("path", F.col("offset").cast("long").alias("offset"), X.json_string(raw, "aiTitle").alias("title"), X.json_string(raw, "lastPrompt").alias("prompt"))


@query("SELECT user_id::VARCHAR AS path, count(*) AS entries, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, arg_min(floor(epoch(ts))::BIGINT, event_id) AS first_ts, max(floor(epoch(ts))::BIGINT) AS last_ts, count(*) FILTER (event_type = 'click') AS user_msgs FROM events GROUP BY user_id")
def first_last_seen(t):
    none = lambda c: F.lit(None).cast("string").alias(c)
    others = [c for c in (*rollup.FIRST, *rollup.LAST, "user_prompt", "usage_id") if c not in ("cwd", "model")]
    e = t("events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("offset"), F.lit("").alias("raw"), (F.col("event_type") == "click").alias("is_user"), F.lit(False).alias("is_assistant"), F.unix_seconds("ts").alias("ts"), F.col("event_type").alias("cwd"), F.col("event_type").alias("model"), F.lit(False).alias("has_usage"), *map(none, others), *[F.lit(0).cast("long").alias(c) for c in rollup.TOKENS])
    return rollup.segments(e).select("path", "entries", F.col("cwd.v").alias("first_type"), F.col("model.v").alias("last_type"), F.col("first_ts.v").alias("first_ts"), "last_ts", "user_msgs")


_SQUASHED = SQUASH.format(c="text", n=1000000000)
_HEAD = f"SELECT conv_id, coalesce(arg_min('/w/r' || conv_id % 5 || '/s' || turn % 3, off) FILTER ({_SAYS}), '?') AS cwd, coalesce(rtrim(left(arg_min({_SQUASHED}, off) FILTER (kind = 'user' AND {REAL}), 110)), '(no user message)') AS title FROM ln GROUP BY conv_id"


@query(f"WITH {LINES} SELECT conv_id::VARCHAR AS path, cwd, title FROM ({_HEAD})")
def short_heads(t):
    return short.heads(transcript_lines(t))


@query(f"WITH {LINES} SELECT lpad(conv_id % 80 || 's', 8, ' ') || '  ' || rpad(left(cwd, 24), 24, ' ') || '  ' || title || chr(9) || conv_id || chr(9) || conv_id || chr(9) || cwd AS value FROM ({_HEAD})")
def short_listing(t):
    files = t("conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("conv_id").cast("string").alias("id"), (1000 - F.col("conv_id") % 80).alias("mtime"), F.lit(False).alias("is_subagent")).distinct()
    return short.listing(short.heads(transcript_lines(t)), files, 1000).select("value")


@query(f"WITH {LINES}, m AS (SELECT conv_id, off, kind, {_SQUASHED} AS text FROM ln WHERE {_SAYS}), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY off DESC) AS back FROM m WHERE {REAL}) SELECT conv_id::VARCHAR AS path, row_number() OVER (PARTITION BY conv_id ORDER BY off) AS turn_no, kind AS role, left(text, 400) AS said FROM r WHERE back <= 8")
def short_preview(t):
    return short.preview(transcript_lines(t))


# ---- through files: written by the sink, read by the source


def _files(t) -> str:
    """A folder of all conversations' transcripts, those of each fifth conversation beside the others' folder."""
    lines = transcript_lines(t)
    root = work_dir(lines.sparkSession).removeprefix("file://")
    project = F.when(F.col("path").cast("long") % 5 == 0, "-w-fifth").otherwise("-w-rest")
    sink.write(lines.select(project.alias("project"), F.col("path").alias("session"), F.lit(None).cast("string").alias("parent"), "offset", "raw"), root)
    return root


def _id():
    return F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)


@query(SESSIONS, "session_files")
def _session_files(t):
    """Transcript files in byte ranges of 4 KB, rolled up with what their paths say."""
    root, spark = _files(t), t("conversations").sparkSession
    typed = L.classify(source.read(spark, root, splitBytes="4096"))
    return rollup.sessions(rollup.segments(typed), source.files(spark, root)).select(F.col("id").alias("path"), *FIELDS[1:])


@query(f"WITH {LINES} SELECT conv_id::VARCHAR AS path, count(*) AS lines, count(*) FILTER (kind = 'assistant') AS answers FROM ln GROUP BY conv_id", "unread_lines")
def _unread(t):
    """What a first catching up reads: tasks list the folders, find the ends of whole lines and read in pieces of 4 KB."""
    root, spark = _files(t), t("conversations").sparkSession
    known = spark.createDataFrame([], "path string, read_to long")
    typed = L.classify(source.spans(source.unread(source.listed(spark, root), known), split=4096))
    return typed.groupBy(_id().alias("path")).agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_assistant").alias("answers"))


@query(f"SELECT path, role, text FROM ({TURNS}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY \"offset\" DESC) = 1", "tail_turn")
def _tail_turn(t):
    """The last turn of every transcript, from all lines of the files."""
    root, spark = _files(t), t("conversations").sparkSession
    return turns.tail_turns(spark, root, 1).select(_id().alias("path"), "role", "text")
