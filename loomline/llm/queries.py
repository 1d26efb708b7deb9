"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, jaccard_join, line_dedup, packing, prefix_trie, quality, secrets, set_sketch, spelling, toxicity, url_filter
from .common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages, judged by rules and templates. Null url: empty host and path; repeated rows are judged each."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and one more, formatted in windows and read back. Null text, role or turn: empty, empty, first; rows of null conv_id are one conversation."""
    import public_tokenizers

    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    return chat_format.digests(chat_format.format_chats(c.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with its words inside benchmark windows. Null text: no words; repeated items count once."""
    m = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return m.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with a toxicity score. Null or empty text: the intercept's; null id: never held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents without the lines that five or more share. Null text: one empty line; all rows of the largest id keep theirs."""
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with its component. Null or wordless text: linked with nothing."""
    d = jaccard_join.linked(table(spark, sf_dir, "documents"), k=3, percent=90)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with the row that stays for its text. Null text is empty; a null id loses to any other."""
    d = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with its spans. Null text: none."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda f: f["rank"] < len(secrets.BASE_KINDS))
    joined = lambda a: F.concat_ws(",", F.transform(a, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with a quality score. Null text is scored as an empty one."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of packed sequences. Null text: the end token alone; repeated rows are packed each."""
    import public_tokenizers

    p = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per word of seven or more code points and two or more occurrences in documents, with its form and root. Null text: no words; null id: written as empty."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of documents with its component; the smallest id of each stays. Null or wordless text: linked with nothing; a null id is its own class's component's."""
    d = set_sketch.linked(table(spark, sf_dir, "documents"), k=3, percent=85)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations. Null role or text: empty; null turn: first; rows without conv_id belong to none."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), share=True)


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_chat_formatting, op3_decontamination, op4_toxicity, op5_line_dedup, op6_ngram_jaccard_join, op7_exact_dedup, op8_secret_scans, op9_quality_classifier, op10_packing, op11_spelling_variants, op12_minhash_near_dedup, op13_prefix_trie)}

#: SQL of the queries that SQL expresses.
ORACLE: dict[str, str] = {}

_SPANS = """SELECT doc_id, rank, kind, s AS start_at, s + length(m[i]) AS end_at FROM (
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m, g, i,
    coalesce(list_sum(list_transform(list_slice(p, 1, i), lambda x: length(x))), 0) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(coalesce(text, ''), '{re}') AS p, regexp_extract_all(coalesce(text, ''), '{re}', 0) AS m, regexp_extract_all(coalesce(text, ''), '{re}', {group}) AS g FROM documents)))
  WHERE length(g[i]) >= {least}"""
_UNION = " UNION ALL ".join(_SPANS.format(rank=i, kind=r.kind, re=r.pattern.replace(r"[\"']", r"[\"'']").replace("((?i:password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))"), group=r.group, least=r.least) for i, r in enumerate(secrets.RULES))
ORACLE["op8_secret_scans"] = f"""WITH f AS ({_UNION}), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY start_at, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY start_at, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""

ORACLE["op7_exact_dedup"] = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

ORACLE["op3_decontamination"] = r"""WITH
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bx AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM bx)),
ks AS (SELECT DISTINCT k FROM wins),
dpos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hits AS (SELECT d.doc_id, d.i, d.k, n.item_id FROM (SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS win FROM dpos) d JOIN wins n ON d.k = n.k AND d.win = n.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN hi ON dw.doc_id = hi.doc_id""".replace("\\\\", "\\")

ORACLE["op5_line_dedup"] = r"""WITH
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, max(doc_id) AS largest FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, k.key IS NOT NULL AND k.largest <> l.doc_id AS gone FROM l LEFT JOIN k ON l.key = k.key) GROUP BY doc_id"""


#: SQL of crc32 over the UTF-8 bytes of {x}, beside crc_table: the table by its polynomial, and a fold.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t)"
_BYTES = "list_transform(range(length(hex(encode({x}))) // 2), lambda i: ('0x' || substr(hex(encode({x})), (2 * i + 1)::INT, 2))::BIGINT)"
_CRC = "xor(4294967295::BIGINT, list_reduce(" + _BYTES + ", lambda c, b: xor(list_extract(t, (xor(c, b) & 255) + 1), c >> 8), 4294967295::BIGINT))"

ORACLE["op11_spelling_variants"] = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 7),
keyed AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS k, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT w, n, {_CRC.format(x="k")} AS h FROM keyed, crc_table),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT word, rest AS other FROM cut WHERE rest IN (SELECT word FROM v) UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM v)
  UNION SELECT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, row(-v.n, encode(other))) AS form, max(v.n) AS form_n FROM near JOIN v ON v.word = near.other GROUP BY near.word),
told AS (SELECT v.word, CASE WHEN form_n >= 10 * v.n THEN form END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS step FROM told UNION ALL SELECT chain.word, told.form, step + 1 FROM chain JOIN told ON chain.here = told.word WHERE told.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN roots USING (word)"""

ORACLE["op13_prefix_trie"] = f"""WITH {_CRC_TABLE},
own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hs AS (SELECT c, l, {_CRC.format(x="c::VARCHAR")} % 9 AS h FROM own, crc_table),
rebuilt AS (SELECT hs.c, list_concat(coalesce(list_slice(base.l, 1, h), []), list_slice(hs.l, h + 1, len(hs.l))) AS l FROM hs LEFT JOIN own base ON base.c = hs.c - hs.c % 5),
at_depth AS (SELECT c, d, len(l) AS n, list_slice(l, 1, d) AS p, CASE WHEN d > 0 THEN strlen(l[d].text) ELSE 0 END AS bytes FROM (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM rebuilt)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM at_depth GROUP BY p, d),
up AS (SELECT x.p, x.d, x.conv_id, y.conv_id AS parent_conv_id FROM node x LEFT JOIN node y ON x.d > 0 AND y.d = x.d - 1 AND y.p = list_slice(x.p, 1, x.d - 1)),
kids AS (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
leaf AS (SELECT node.*, kids.n IS NULL AS is_leaf FROM node LEFT JOIN kids ON kids.conv_id = node.conv_id AND kids.d = node.d),
below AS (SELECT list_slice(p, 1, k) AS p, k AS d, count(*) FILTER (is_leaf) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM leaf) GROUP BY ALL)
SELECT node.conv_id, node.d AS depth, up.parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved AS saved_tokens, ends_sha256
FROM node JOIN up ON up.conv_id = node.conv_id AND up.d = node.d LEFT JOIN kids ON kids.conv_id = node.conv_id AND kids.d = node.d JOIN below ON below.d = node.d AND below.p = node.p"""

_LINKED = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id{more} FROM documents d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
ORACLE["op6_ngram_jaccard_join"] = _LINKED.format(percent=90, more="")
ORACLE["op12_minhash_near_dedup"] = _LINKED.format(percent=85, more=", d.doc_id = component_id AS kept")
