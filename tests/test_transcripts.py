"""Transcript files to sessions, prose and turns, at once and piece by piece."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from loomline.operators import lines as L
from loomline.functions.query import Query
from loomline.operators import growing, postings, prose, rollup, search, turns
from loomline.sources import transcripts
from loomline.streaming import refresh

T0 = "2026-01-02T03:04:0{}.000Z"


def message(role, content, n=0, **more):
    inner = {"role": role, "content": content, **{k: more.pop(k) for k in ("model", "id", "usage") if k in more}}
    return json.dumps({"parentUuid": None, "message": inner, "type": role, "cwd": "/srv/garden", "gitBranch": "spring", "version": "7.0.1", "timestamp": T0.format(n), **more}, separators=(",", ":"), ensure_ascii=False)


def meta(kind, **fields):
    return json.dumps({"type": kind, **fields}, separators=(",", ":"))


#: What a transcript may hold, by feature: its lines, and what they add to the session.
FEATURES = {
    "mode": ([meta("permission-mode", permissionMode="plan")], {"permission_mode": "plan"}),
    "later mode": ([meta("permission-mode", permissionMode="acceptEdits")], {}),
    "prompt": ([message("user", "plant\t the  beans", 2)], {"user_msgs": 1, "first_prompt": "plant the beans", "first": 2, "said": "plant the beans"}),
    "answer": ([message("assistant", [{"type": "text", "text": "which bed?"}], 6, model="gardener")], {"assistant_msgs": 1, "model": "gardener", "last": 6, "said": "which bed?"}),
    "injected": ([message("user", [{"type": "text", "text": "<note>water twice</note>"}], 7)], {"user_msgs": 1, "last": 7, "said": "<note>water twice</note>"}),
    "no field": ([meta("summary", text="not a session's field")], {}),
    "title": ([meta("ai-title", aiTitle="Beans in a bed")], {"ai_title": "Beans in a bed"}),
    "last prompt": ([meta("last-prompt", lastPrompt="the south one")], {"last_prompt": "the south one"}),
}


def transcript(*names):
    """The lines of the named features, and what a session of them holds: counts add up, the last value holds but for the mode's, the first's."""
    rows, want, said = [], {"user_msgs": 0, "assistant_msgs": 0}, []
    for name in names:
        more, adds = FEATURES[name]
        rows += more
        for k, v in adds.items():
            if k == "said":
                said.append(v)
            elif k.endswith("_msgs"):
                want[k] += v
            else:
                want[k] = v
    return rows, want | {"entries": len(rows), "said": " ".join(said)}


BASE, WANT = transcript(*FEATURES)
USAGE = {"input_tokens": 5, "output_tokens": 70, "cache_read_input_tokens": 900, "cache_creation_input_tokens": 11}


def write(root, name, rows, end="\n"):
    path = root / "-srv-garden" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(rows) + end).encode())
    return path


def scanned(spark, root):
    typed = L.classify(transcripts.read(spark, str(root)))
    return {r.id: r for r in rollup.sessions(rollup.segments(typed), transcripts.files(spark, str(root))).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_rollup_of_features(spark, tmp_path, seed):
    """Any choice of features in any order; the mode that is named first, and times, follow their own order."""
    r = random.Random(seed)
    names = [n for n in FEATURES if r.random() < 0.7 or n == "prompt"]
    if seed:
        r.shuffle(names)
    rows, want = transcript(*names)
    write(tmp_path, "s1.jsonl", rows)
    got = scanned(spark, tmp_path)["s1"]
    modes = [n for n in names if n.endswith("mode")]
    want["permission_mode"] = {"mode": "plan", "later mode": "acceptEdits"}[modes[0]] if modes else ""
    for k, v in want.items():
        if k not in ("said", "first", "last"):
            assert getattr(got, k) == v, k
    times = [t for n in names for t in [{"prompt": 2, "answer": 6, "injected": 7}.get(n)] if t]
    assert got.last_ts - got.first_ts == max(times) - times[0]
    assert (got.cwd, got.git_branch, got.version, got.scanned_len) == ("/srv/garden", "spring", "7.0.1", got.size)
    text = prose.bodies(L.classify(transcripts.read(spark, str(tmp_path)))).first().text
    assert " ".join(text.split()) == want["said"]


@pytest.mark.parametrize("block", [64 << 20, 300, 1])
def test_tokens_count_a_response_once(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(rollup, "BLOCK_BYTES", block)
    rows = [message("assistant", [], model="m", id=i, usage=USAGE) for i in ("a", "a", "b", "a", "", "", "c", "c", "c")]
    write(tmp_path, "s1.jsonl", rows)
    r = scanned(spark, tmp_path)["s1"]
    assert (r.assistant_msgs, r.in_tokens, r.out_tokens, r.cache_read, r.cache_write) == (9, 6 * 5, 6 * 70, 6 * 900, 6 * 11)
    typed = L.classify(transcripts.read(spark, str(tmp_path)))
    u = rollup.deduplicated_usage(typed, block=F.floor(F.col("offset") / F.lit(block)))
    assert [x.counted for x in u.orderBy("offset").collect()] == [True, False, True, True, True, True, True, False, False]


def test_titles(spark, tmp_path):
    write(tmp_path, "s1.jsonl", [meta("custom-title", customTitle="one"), meta("custom-title", customTitle=" "), meta("ai-title", aiTitle="a"), meta("ai-title", aiTitle="  ")])
    r = scanned(spark, tmp_path)["s1"]
    assert (r.custom_title, r.ai_title) == ("", "a")


def test_odd_lines(spark, tmp_path):
    write(tmp_path, "s1.jsonl", ["", "junk", message("user", 'say "hi" \\ ü', cwd='/a "b" c\\d') + "\r"], end="\n{\"half")
    write(tmp_path, "s2.jsonl", [message("user", "x").replace('"x"', '"cut \\ud83d here"')])
    (tmp_path / "-srv-garden" / "empty.jsonl").write_bytes(b"")
    got = scanned(spark, tmp_path)
    assert (got["s1"].entries, got["s1"].cwd, got["s1"].first_prompt) == (2, '/a "b" c\\d', 'say "hi" \\ ü')
    assert got["s1"].scanned_len < got["s1"].size
    assert got["s2"].first_prompt == "cut � here"
    assert got["empty"].entries == 0


def test_subagents_and_splits(spark, tmp_path):
    write(tmp_path, "p1/subagents/agent-1.jsonl", BASE)
    write(tmp_path, "p1.jsonl", BASE * 30)
    files = {r.id: r for r in transcripts.files(spark, str(tmp_path)).collect()}
    assert (files["agent-1"].parent, files["agent-1"].project_dir, files["p1"].is_subagent) == ("p1", "-srv-garden", False)
    whole = transcripts.read(spark, str(tmp_path)).select("path", "offset", "raw").collect()
    cut = transcripts.read(spark, str(tmp_path), splitBytes="777").select("path", "offset", "raw").collect()
    assert sorted(whole) == sorted(cut) and len(whole) == 248
    assert transcripts.read(spark, str(tmp_path), tailBytes="700", subagents="false").count() < 8
    assert sorted(x.raw for x in transcripts.read_text(spark, str(tmp_path)).select("raw").collect()) == sorted(x.raw for x in whole)


def test_prose(spark, tmp_path):
    rows = [
        message("user", [{"type": "text", "text": 'one <system-reminder>never</system-reminder>two\n"three" \\n'}]),
        message("assistant", [{"type": "thinking", "thinking": "well"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls beds", "description": "list"}}], 1),
        message("user", [{"type": "tool_result", "content": [{"type": "text", "text": "shown"}]}], 2),
        message("user", "simple text", 3),
        message("user", "put in", 4, isMeta=True),
    ]
    write(tmp_path, "s1.jsonl", rows)
    typed = L.classify(transcripts.read(spark, str(tmp_path)))
    text = prose.bodies(typed).first().text
    words = ["one", "two", '"three"', "\\n", "well", "ls", "beds", "list", "simple", "text"]
    assert text.split() == words
    for block in (1, 200):
        assert prose.bodies(typed, block_bytes=block).first().text == text
        first, second = text[: text.index("well")], text[: text.index("simple")]
        cut = {1: first, len(first): first, len(first) + 1: second, len(second): second, len(text): text}
        for cap, want in cut.items():  # lines before which there is less than the cap
            assert prose.bodies(typed, cap=cap, block_bytes=block).first().text.split() == want.split()


def test_tail_grows_over_a_line_that_says_nothing(spark, tmp_path):
    write(tmp_path, "s1.jsonl", [*BASE, message("user", "x" * 5000, isMeta=True)])
    write(tmp_path, "s2.jsonl", BASE)
    got = {(r.path.rpartition("/")[2], r.text) for r in turns.tail_turns(spark, str(tmp_path), 1, tail_bytes=1500).collect()}
    assert got == {("s1.jsonl", "which bed?"), ("s2.jsonl", "which bed?")}
    assert turns.tail_turns(spark, str(tmp_path), 1, tail_bytes=100).where("path LIKE '%s1%'").count() == 0  # eight times that is still within the line


def test_viewer_is_bounded(spark, tmp_path):
    p = str(write(tmp_path, "s1.jsonl", [message("assistant", [{"type": "text", "text": f"turn {i} of lamps"}], i % 10) for i in range(30)]))
    rows = turns.viewer(spark, str(tmp_path), p, "lamps", most=4).orderBy("offset").collect()
    assert [r.text for r in rows] == [f"turn {i} of lamps" for i in range(26, 30)] and all(r.more and r.terms == 1 for r in rows) and [r.focus for r in rows] == [True, False, False, False]
    short = turns.viewer(spark, str(tmp_path), p, most=400, max_bytes=600).collect()
    assert 0 < len(short) < 4 and all(r.more for r in short)
    assert not any(r.more for r in turns.viewer(spark, str(tmp_path), p).collect())


def test_turns(spark, tmp_path):
    write(tmp_path, "s1.jsonl", [*BASE, message("assistant", [{"type": "tool_use", "name": "Edit", "input": {}}, {"type": "text", "text": "done"}]), message("user", "no", isMeta=True)])
    t = turns.extract(transcripts.read(spark, str(tmp_path)))
    assert [(r.role, r.text) for r in t.orderBy("offset").collect()] == [("you", "plant\t the  beans"), ("assistant", "which bed?"), ("assistant", "[Edit] done")]
    last = turns.last(t, 2).orderBy("turn_no").collect()
    assert [(r.turn_no, r.text, r.more) for r in last] == [(1, "which bed?", True), (2, "[Edit] done", True)]


@pytest.mark.parametrize("cut", [1, 4, 7])
def test_merge_equals_one_scan(spark, tmp_path, cut):
    usage = [message("assistant", [{"type": "text", "text": f"t{i}"}], i, model="m", id=k, usage=USAGE) for i, k in enumerate(["a", "a", "b", "b"])]
    rows = [*BASE[:4], *usage, meta("custom-title", customTitle="named")]
    p = write(tmp_path, "s1.jsonl", rows)
    typed = L.classify(transcripts.read(spark, str(tmp_path)))
    at = len(("\n".join(rows[:cut]) + "\n").encode())
    two = rollup.merge(rollup.segments(typed.where(F.col("offset") < at)), rollup.segments(typed.where(F.col("offset") >= at)))
    files = transcripts.files(spark, str(tmp_path))
    assert rollup.sessions(two, files).collect() == rollup.sessions(rollup.segments(typed), files).collect()
    assert p.exists()


def test_refresh_reads_only_what_is_new(spark, tmp_path):
    root, at = tmp_path / "root", tmp_path / "state"
    p = write(root, "s1.jsonl", BASE[:4])
    state = refresh.refresh(spark, str(root), refresh.State(spark, str(at)))
    with p.open("a") as f:
        f.write("\n".join(BASE[4:]) + "\n" + message("user", "partial"))
    write(root, "s2.jsonl", [message("user", "other")])
    refresh.refresh(spark, str(root), state)
    files = transcripts.files(spark, str(root))
    got = {r.id: r for r in state.sessions(files).collect()}
    assert (got["s1"].entries, got["s1"].ai_title, got["s2"].first_prompt) == (8, "Beans in a bed", "other")
    assert " ".join({r.path: r.text for r in state.bodies().collect()}[str(p)].split()) == WANT["said"]
    done = len(state.log.all())
    new = transcripts.read(spark, str(root)).where("path LIKE '%s1%' AND offset > 0")
    state.apply(new)  # what the state has already
    assert len(state.log.all()) == done
    write(root, "s1.jsonl", [message("user", "rewritten")])  # shorter than before
    refresh.refresh(spark, str(root), state)
    got = {r.id: r for r in state.sessions(transcripts.files(spark, str(root))).collect()}
    assert (got["s1"].entries, got["s1"].first_prompt) == (1, "rewritten")
    (root / "-srv-garden" / "s2.jsonl").unlink()
    reader = state.sessions(transcripts.files(spark, str(root)))  # a search that began before
    state.prune(transcripts.files(spark, str(root)))
    assert state.segments().count() == 1 and state.bodies().count() == 1 and reader.count() == 1
    state.vacuum()
    assert reader.count() == 1  # tables stay for a day
    (at / ("segments-" + "0" * 32)).mkdir()  # of a writer that failed
    assert len(state.vacuum(0)) > 4
    left = [x for x in os.listdir(at) if x.startswith(("segments", "prose"))]
    assert len(left) == 2 and state.segments().count() == 1 and state.bodies().count() == 1


def test_state_opened_again_and_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "RUNS", 2)
    root, at = tmp_path / "root", str(tmp_path / "state")
    for i in range(5):
        write(root, f"s{i}.jsonl", BASE[: i + 3])
        refresh.refresh(spark, str(root), refresh.State(spark, at))
    again = refresh.State(spark, at)
    assert len(again.pointer()["segments"]) <= 3 and not again.stale
    files = transcripts.files(spark, str(root))
    whole = rollup.sessions(rollup.segments(L.classify(transcripts.read(spark, str(root)))), files)
    assert sorted(again.sessions(files).collect()) == sorted(whole.collect())


def shown(spark, root, state):
    """Sessions, prose, and the index's postings and lengths."""
    files = transcripts.files(spark, str(root))
    rows = sorted(state.sessions(files).collect())
    bodies = sorted((r.path, " ".join(r.text.split())) for r in state.bodies().collect())
    index = state.index()
    posted = {}
    for r in index.postings.collect():
        posted.setdefault((r.term, r.path, r.dl), []).extend(r.positions)
    return rows, bodies, sorted((*k, sorted(v)) for k, v in posted.items()), sorted(map(tuple, index.lengths.collect())), index.totals.first()


def afresh(spark, root, tmp_path):
    """What a fresh scan and an index built at once show."""
    typed = L.classify(transcripts.read(spark, str(root)))
    said = prose.bodies(typed)
    index = postings.build(said)
    rows = sorted(rollup.sessions(rollup.segments(typed), transcripts.files(spark, str(root))).collect())
    posted = sorted((r.term, r.path, r.dl, list(r.positions)) for r in index.postings.collect())
    return rows, sorted((r.path, " ".join(r.text.split())) for r in said.collect()), posted, sorted(map(tuple, index.lengths.collect())), index.totals.first()


def grow(r, root, many=3):
    """Appends to some transcripts, rewrites one, removes one, adds one; blank lines and carriage returns among them."""
    names = list(FEATURES)
    for i in range(many):
        p = root / "-srv-garden" / f"g{i}.jsonl"
        p.parent.mkdir(parents=True, exist_ok=True)
        rows = transcript(*r.choices(names, k=r.randint(1, 4)))[0]
        end = r.choice(["\n", "\r\n", "\n\n"])
        what = r.random()
        if what < 0.15 and p.exists():
            p.write_bytes(rows[0].encode()[:7] + b"\n")  # shorter, and no JSON
        else:
            with p.open("ab") as f:
                f.write((end.join(rows) + end).encode())
    if r.random() < 0.3 and (p := root / "-srv-garden" / "g0.jsonl").exists():
        p.unlink()


def test_refreshes_equal_a_fresh_scan(spark, tmp_path, monkeypatch):
    """Appends, rewrites, removals, merges of runs, a lost checkpoint, a batch run twice, other logic: after each the state shows what a fresh scan does."""
    monkeypatch.setattr(refresh, "RUNS", 2)
    monkeypatch.setattr(growing, "FAN", 2)
    r, root, at = random.Random(8), tmp_path / "root", str(tmp_path / "state")
    grow(r, root)
    state = refresh.refresh(spark, str(root), refresh.State(spark, at))
    for step in range(4):
        grow(r, root)
        if step == 1:  # the checkpoint is lost
            shutil.rmtree(f"{at}/checkpoint-{refresh.LOGIC_VERSION}")
        if step == 2:  # other logic: a checkpoint of its own, whose batches are numbered anew
            monkeypatch.setattr(refresh, "LOGIC_VERSION", 99)
            assert state.stale and state.segments().count() > 0  # the old rows are shown
        refresh.refresh(spark, str(root), refresh.State(spark, at))
        state = refresh.State(spark, at)
        state.prune(transcripts.files(spark, str(root)))
        assert not state.stale
        assert shown(spark, root, state) == afresh(spark, root, tmp_path), step
    state.vacuum(0)
    assert shown(spark, root, state) == afresh(spark, root, tmp_path)
    assert len(state.pointer()["index"]) <= 3
    q = Query.parse('"south one" OR beans bed')
    assert sorted(search.indexed(state.index(), q).collect()) == sorted(search.indexed(postings.build(state.bodies()), q).collect())


def test_lines_are_compared_before_they_are_appended(spark, tmp_path):
    """Twice the same lines, lines that don't meet what is stored, and two writers."""
    root, at = tmp_path / "root", str(tmp_path / "state")
    p = write(root, "s1.jsonl", BASE[:3])
    state = refresh.refresh(spark, str(root), refresh.State(spark, at))
    cut = p.stat().st_size
    write(root, "s1.jsonl", BASE)
    lines = transcripts.read(spark, str(root))
    tail = lines.where(F.col("offset") >= cut)
    other = refresh.State(spark, at)
    state.apply(tail)
    other.apply(tail)  # it read on from the same place
    want = afresh(spark, root, tmp_path)
    assert shown(spark, root, other) == shown(spark, root, state) == want
    lost = refresh.State(spark, str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="don't go on"):
        lost.apply(tail)
    asked = []
    lost.apply(tail, lambda paths: asked.extend(paths) or lines)
    assert asked == [str(p)] and shown(spark, root, lost) == want


def test_a_refresh_writes_what_was_appended(spark, tmp_path):
    root, at = tmp_path / "root", tmp_path / "state"
    for i in range(20):
        write(root, f"s{i}.jsonl", BASE * 20)
    state = refresh.refresh(spark, str(root), refresh.State(spark, str(at)))
    first = spark.read.parquet(f"{at}/{state.pointer()['index'][0]['name']}").count()
    with (root / "-srv-garden" / "s3.jsonl").open("a") as f:
        f.write(BASE[2] + "\n")
    refresh.refresh(spark, str(root), state)
    last = spark.read.parquet(f"{at}/{state.pointer()['index'][-1]['name']}")
    assert last.count() == 3 < first and spark.read.parquet(f"{at}/{state.pointer()['segments'][-1]}").count() == 1


def test_catching_up_equals_a_fresh_scan(spark, tmp_path, monkeypatch):
    """No stream and no checkpoint: the state alone says where to go on. A failure between reading and committing changes nothing."""
    monkeypatch.setattr(growing, "FAN", 2)
    r, root, at = random.Random(3), tmp_path / "root", str(tmp_path / "state")
    state = refresh.catch_up(spark, str(root), refresh.State(spark, at))  # nothing is there yet
    assert state.segments() is None
    for step in range(3):
        grow(r, root)
        if step == 1:
            with monkeypatch.context() as m:
                m.setattr(refresh.State, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError, match="lost"):
                    refresh.catch_up(spark, str(root), refresh.State(spark, at))
        if step == 2:
            monkeypatch.setattr(refresh, "LOGIC_VERSION", 77)
        state = refresh.catch_up(spark, str(root), refresh.State(spark, at), split=100)
        state.prune(transcripts.files(spark, str(root)))
        assert not state.stale and shown(spark, root, state) == afresh(spark, root, tmp_path), step
    done, opened = len(state.log.all()), []
    monkeypatch.setattr(refresh.State, "apply", lambda self, new, *a: opened.append(new.count()))
    refresh.catch_up(spark, str(root), state)
    with (root / "-srv-garden" / "g1.jsonl").open("a") as f:
        f.write(BASE[2] + "\n" + BASE[3][:9])
    refresh.catch_up(spark, str(root), state)
    assert len(state.log.all()) == done and opened == [1]  # nothing new, then one whole line


def test_conditions_choose_files_and_bytes(spark, tmp_path):
    for i in range(4):
        write(tmp_path, f"s{i}.jsonl", [f"line {i} {j:03}" for j in range(100)])
    path = str(tmp_path / "-srv-garden" / "s2.jsonl")
    conf = "spark.sql.python.filterPushdown.enabled"
    plain = transcripts.read(spark, str(tmp_path))
    spark.conf.set(conf, "true")
    try:
        pushed = lambda: transcripts.read(spark, str(tmp_path), splitBytes="300", pushdown="true")
        for where, parts in (
            (f"path = '{path}'", 4), (f"path IN ('{path}', 'x')", 4), ("path LIKE '%s2.jsonl' AND offset >= 600", 8), (f"path = '{path}' AND offset > 599 AND offset < 700", 1), (f"path = '{path}' AND offset <= 13", 1), ("epoch = 1", 1), (f"startswith(path, '{path[:-7]}') AND offset < 0", 1),
        ):
            rows = pushed().where(where)
            assert sorted(rows.select("path", "offset", "raw").collect()) == sorted(plain.where(where).select("path", "offset", "raw").collect()), where
            assert rows.rdd.getNumPartitions() == parts, where
        assert pushed().rdd.getNumPartitions() == 16
    finally:
        spark.conf.unset(conf)


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(300):
        write(tmp_path, f"s{i}.jsonl", [f"line {i} {j} é" for j in range(1 + i % 6)])
    write(tmp_path, ".hidden/none.jsonl", ["no"])
    for options in ({"splitBytes": "20"}, {"tailBytes": "30"}, {}):
        df = transcripts.read(spark, str(tmp_path), **options)
        assert 1 < df.rdd.getNumPartitions() <= 2 * transcripts.TASKS, options
        if "tailBytes" not in options:
            assert sorted(r.raw for r in df.collect()) == sorted(f"line {i} {j} é" for i in range(300) for j in range(1 + i % 6))
    last = turns.tail_turns(spark, str(tmp_path), 1, tail_bytes=30)
    assert last.count() == 0  # no JSON
    assert transcripts.files(spark, str(tmp_path)).count() == 300
    assert [len(t.spans) for t in transcripts.tasks([transcripts.Span("a", 0, 64 << 20, True, False)] * 100)] == [1] * 100  # large ranges stay apart
