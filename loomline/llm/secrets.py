"""Secret scans through an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. The
ledger keeps (blob, findings) for each rule version in Parquet tables that are only ever
added to; a commit scans the (blob, rule version) pairs that it lacks, each distinct text
once however many paths hold it, and findings are joined back to all paths by blob, the
rows of a hot blob over several tasks.

Spans come from two built-ins that agree on leftmost, non-overlapping matches:
``split`` gives the text between matches and ``regexp_extract_all`` the matches, so the
running sum of their lengths gives code-point offsets.

Defined results: a null text is the empty blob; repeated rows and equal texts each get
their own row with the same findings; a path of null stays null; an empty table gives
no rows. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Commits, only, spread_join, stored, work_dir

BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class Rule:
    """pattern: a Java regex. least: code points that group ``group`` must have, else the match is dropped (but still consumes its text)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: hex and access: a run that is too short can't hold a longer match, so the length goes into the pattern. assign: a short match does consume text, so its length is tested after the match.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULE_VERSION = "1"
FINDING = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    r = F.lit(rule.pattern)
    parts = F.struct(
        F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, r, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, r, F.lit(rule.group)).alias("tested"),
    )
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast(FINDING).alias("spans"))

    def step(p: Column):
        def go(acc: Column, i: Column) -> Column:
            at = acc["pos"] + F.length(p["between"][i])
            end = at + F.length(p["match"][i])
            one = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
            keeps = F.length(p["tested"][i]) >= rule.least
            return F.struct(end.alias("pos"), F.when(keeps, F.concat(F.coalesce(acc["spans"], F.array().cast(FINDING)), one)).otherwise(acc["spans"]).alias("spans"))

        return go

    walk = F.transform(F.array(parts), lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p["match"]) - 1), start, step(p))["spans"])[0]
    return F.when(text.rlike(rule.pattern), F.coalesce(walk, F.array().cast(FINDING))).otherwise(F.array().cast(FINDING))


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start, then by the rules' order. end is exclusive; both are code points."""
    return F.array_sort(F.concat(*[_rule_spans(text, r, i) for i, r in enumerate(rules)]))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class BlobLedger:
    """Scanned blobs in ``path``, a shared folder; rule_version names the state of ``rules``.

    A ledger opened again on its folder knows all that was scanned there. A rule version
    that the folder knows with other rules is an error, as its findings would be mixed.
    """

    def __init__(self, spark, path: str | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> None:
        self.spark, self.rules, self.rule_version = spark, rules, rule_version
        self.log = Commits(spark, path or work_dir(spark))
        self.digest = hashlib.sha256(repr([(r.kind, r.pattern, r.group, r.least) for r in rules]).encode()).hexdigest()

    @property
    def path(self) -> str:
        return self.log.path

    def _tables(self) -> list[str]:
        mine = [c for c in self.log.all() if c["rule_version"] == self.rule_version]
        if any(c["rules"] != self.digest for c in mine):
            raise ValueError(f"rule version {self.rule_version} of {self.path} was scanned with other rules")
        return [f"{self.path}/{c['table']}" for c in mine]

    def scanned(self) -> DataFrame | None:
        """(blob, findings) of each blob that this rule version has seen; None if there is none."""
        tables = self._tables()
        return self.spark.read.schema(f"blob binary, findings {FINDING}").parquet(*tables) if tables else None

    def commit(self, history: DataFrame, text: str = "text") -> int:
        """Scans the blobs of ``history`` that this rule version hasn't seen; the number of commits in the folder."""
        blobs = history.select(F.coalesce(history[text], F.lit("")).alias("text")).select(blob_id(F.col("text")).alias("blob"), "text").distinct()
        seen, after = self.scanned(), len(self.log.all())
        if seen is not None:
            blobs = blobs.join(seen.select("blob"), "blob", "left_anti")
        table = self.log.table("findings")
        blobs.select("blob", findings(F.col("text"), self.rules).alias("findings")).write.parquet(table)
        self.log.add(after, {"rule_version": self.rule_version, "rules": self.digest, "table": table.rpartition("/")[2]})
        return after + 1

    def report(self, history: DataFrame, key: str, text: str = "text") -> DataFrame:
        """(key, blob, findings) of every row of ``history``; findings are empty where nothing was found. A blob that was never scanned stops the job."""
        paths = stored(history.select(history[key].alias("ledger_key"), blob_id(history[text]).alias("blob")))
        seen = self.scanned()
        if seen is None:
            seen = self.spark.createDataFrame([], f"blob binary, findings {FINDING}")
        joined = spread_join(paths, seen, "blob")
        return joined.select(F.col("ledger_key").alias(key), "blob", F.coalesce("findings", F.raise_error("a blob of this history was never scanned").cast(FINDING)).alias("findings"))


def scan(history: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A ledger of its own for one table: (key, blob, findings) per row."""
    ledger = BlobLedger(history.sparkSession)
    ledger.commit(only(history, text), text)
    return ledger.report(history, key, text)
