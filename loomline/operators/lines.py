"""Raw transcript lines to typed columns, without parsing a line that needs no parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

# Models that stand for no model.
PLACEHOLDERS = ("<synthetic>", "inherit", "sniff")
_BLOCKS = "array<struct<type:string,text:string,name:string>>"


def parsed_content(content: Column, mended: Column) -> tuple[Column, Column]:
    """(content if it is a string, else null; its blocks if it is a list, else null) of a parsed message's content, which for a list is its JSON."""
    items = F.from_json(mended, "message struct<content:array<string>>", X.LONG)["message"]["content"]
    listed = content.startswith("[") & F.get(items, F.lit(0)).isNotNull()
    return F.when(~listed, content), F.when(listed, F.from_json(content, _BLOCKS, X.LONG))


def content_blocks(raw: Column) -> tuple[Column, Column]:
    """(content if it is a string, else null; its blocks if it is a list, else null)."""
    mended = X.mend_surrogates(raw)
    return parsed_content(F.from_json(mended, "message struct<content:string>", X.LONG)["message"]["content"], mended)


def _said(plain: Column, blocks: Column) -> Column:
    said = F.filter(blocks, lambda b: (b["type"] == "text") & X.is_real_user_text(b["text"]))
    return F.coalesce(plain, F.array_join(F.transform(said, lambda b: b["text"]), " "), F.lit(""))


def user_text(raw: Column) -> Column:
    """What a user message says: its string, or its real text blocks joined by a space."""
    return _said(*content_blocks(raw))


def classify(lines: DataFrame, title: int | None = 160, prompt: int | None = 200) -> DataFrame:
    """Lines (path, offset, raw, ...) with what each contributes to its session; null where it contributes nothing. title, prompt: the most characters of titles and prompts, None for all.

    Kinds are told first. A line is then mended and parsed once, and only if its kind has a field to parse; each of the steps is a projection of its own, as the optimizer doesn't fold what is used more than once.
    """
    raw = F.col("raw")
    meta, kind, user, asst, mended, whole = (F.col(f"_{c}") for c in ("meta", "kind", "user", "asst", "mended", "json"))
    at = lambda c: F.col(f"_{c}")
    nonempty = lambda c: F.nullif(c, F.lit(""))
    t = lines.where(raw != "").withColumn("_meta", raw.startswith('{"type":"'))
    t = t.withColumns({"_kind": F.when(meta, F.regexp_extract(raw, r'^\{"type":"([^"]*)"', 1)), "_user": ~meta & raw.contains('"role":"user"'), "_injected": raw.contains('"isMeta":true')})
    t = t.withColumn("_asst", ~meta & ~user & raw.contains('"role":"assistant"'))
    parses = kind.isin("custom-title", "ai-title", "last-prompt") | (user & ~at("injected"))
    t = t.withColumn("_mended", F.when(parses, F.when(raw.contains("\\u"), X.mend_surrogates(raw)).otherwise(raw)))
    t = t.withColumn("_json", F.from_json(mended, "customTitle string, aiTitle string, lastPrompt string, message struct<content:string>", X.LONG))
    asked = F.when(user & ~at("injected") & (F.get_json_object(mended, "$.type") == "user"), _said(*parsed_content(whole["message"]["content"], mended)))
    t = t.withColumns({"_stamp": X.json_string(raw, "timestamp"), "_usage": asst & raw.contains('"usage"'), "_model": F.when(asst, X.json_string(raw, "model")), "_prompt": asked})
    of_kind = lambda k, c: F.when(kind == k, c)
    ai, last = whole["aiTitle"], whole["lastPrompt"]
    return t.select(
        *lines.columns,
        kind.alias("kind"),
        user.alias("is_user"),
        asst.alias("is_assistant"),
        F.nullif(N.iso_to_epoch(at("stamp")), F.lit(0)).alias("ts"),
        *[nonempty(X.json_string(raw, k)).alias(n) for k, n in (("cwd", "cwd"), ("gitBranch", "git_branch"), ("version", "version"), ("agentId", "agent_id"))],
        of_kind("custom-title", X.squash(whole["customTitle"], title)).alias("custom_title"),
        of_kind("ai-title", F.when(X.trimmed(ai) != "", X.squash(ai, title))).alias("ai_title"),
        of_kind("last-prompt", F.when(X.is_real_user_text(last), X.squash(last, prompt))).alias("last_prompt"),
        of_kind("permission-mode", nonempty(X.json_string(raw, "permissionMode"))).alias("permission_mode"),
        F.when(X.is_real_user_text(at("prompt")), X.squash(at("prompt"), prompt)).alias("user_prompt"),
        F.when(~at("model").isin(*PLACEHOLDERS), nonempty(at("model"))).alias("model"),
        at("usage").alias("has_usage"),
        F.when(at("usage"), F.coalesce(X.json_string(raw, "id"), F.lit(""))).alias("usage_id"),
        *[F.when(at("usage"), X.json_number(raw, k)).alias(n) for k, n in (("input_tokens", "in_tokens"), ("output_tokens", "out_tokens"), ("cache_read_input_tokens", "cache_read"), ("cache_creation_input_tokens", "cache_write"))],
    )
