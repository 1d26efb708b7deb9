"""The compressed prefix tree against a plain trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from loomline.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, conv string, d int"


def said(rows):
    """conv -> its turns (role, text), in the operator's order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(x[2], x[4]) for x in sorted(v)] for c, v in out.items()}


def mixed(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    """The nodes of a trie that adds every conversation turn by turn."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * len(k[-1][1].encode() if k else b"") + sum(saved[x] for x in kids.get(k, []))
        leaves[k] = sum(leaves[x] for x in kids[k]) if k in kids else 1
    out = set()
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = []
    for c in range(120):
        if c % 17 == 4:
            continue  # some ids are absent, a multiple of five among them
        for t in range(r.randint(1, 9)):
            out.append((c, t, r.choice(["user", "assistant", None]), r.choice(["a", "é", "b" * 5, "", None])))
    out += [(200 + c, t, "user", f"long {t}") for c in range(3) for t in range(20 + c)]  # beginnings of each other
    out += [(300 + c, t, "user", "same") for c in range(25) for t in range(6)]
    out += [(300 + c, 6, "user", f"then {c % 3}") for c in range(25)]
    out += [(400, None, "user", "late"), (400, 0, "user", "zero"), (400, 0, "user", "zero"), (400, 0, None, None), (None, 0, "user", "lost"), (None, 1, "user", "lost")]
    out += [(-7, 0, "user", "minus"), (401, 5, "system", "x" * 100_000)]
    return out


@pytest.mark.parametrize("cut", [2, 128])
def test_trie_equals_a_plain_one(spark, rows, cut):
    t = prefix_trie.placed(table(spark, rows), "conv_id", "turn", "role", "text")
    assert got(prefix_trie.nodes(prefix_trie.as_they_are(t), t.select("conv").distinct(), cut=cut)) == plain(said(rows))


def test_rebuilt_conversations(spark, rows):
    few = [r for r in rows if r[0] is None or r[0] >= 0]
    want = mixed(said(few))
    assert any(not x for x in want.values()), "one is turnless"
    assert got(prefix_trie.conversation_trie(table(spark, few), share=True)) == plain(want)


def test_ranges_of_any_size_make_one_tree(spark, rows):
    """A range for almost each item: points that span many ranges are merged."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(prefix_trie.conversation_trie(table(spark, rows, 7))) == plain(said(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_chains_edges_and_chunks(spark, monkeypatch):
    """Conversations that each begin the next one, edges longer than a row's span, and many ids at one node."""
    monkeypatch.setattr(prefix_trie, "SPAN", 3)
    rows = [(c, t, "u", "ab"[: 1 + t % 2]) for c in range(30) for t in range(c)]
    rows += [(1000 + c, t, "u", "z") for c in range(60) for t in range(11)]
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == plain(said(rows))
    members = spark.createDataFrame([(1, c) for c in range(30_000)] + [(5, 7)], "rep long, conv long").repartition(5)
    want = {1: hashlib.sha256(",".join(map(str, range(30_000))).encode()).hexdigest(), 5: hashlib.sha256(b"7").hexdigest()}
    assert {r["end"]: r.ends_sha256 for r in prefix_trie.id_digests(members).collect()} == want


def test_small_tables(spark):
    assert got(prefix_trie.conversation_trie(table(spark, []))) == set()
    assert got(prefix_trie.conversation_trie(table(spark, [(None, 0, "user", "x")]), share=True)) == set()
    lone = [(3, 0, "user", "x")]  # its first turns come from conversation 0, which is absent
    assert got(prefix_trie.conversation_trie(table(spark, lone), share=True)) == plain(mixed(said(lone)))
    assert got(prefix_trie.conversation_trie(table(spark, lone))) == plain(said(lone))
