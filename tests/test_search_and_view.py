"""Search against a plain restatement, and the list with its overlays."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomline.functions.query import Query
from loomline.operators import overlay as O
from loomline.operators import evaluate, postings, report, search, tags, view
from loomline.operators.rollup import TOKENS
from loomline.plans import base

#: /more says copper often and lamp never; /both says both, once each; /pair has them side by side in another order of its other words.
BODIES = {"/pair": "under a copper lamp hung the clamp", "/both": "copper pipes and then a lamp", "/more": "copper copper copper copper copper tonight", "/accent": "Über São Paulo: planting trees, plantation", "/sign": "lists in F++ and f++ too", "/none": "no match here"}
NOW = 1_700_000_000


def bodies(spark):
    return spark.createDataFrame(list(BODIES.items()), "path string, text string")


def bm25(docs, phrases, path):
    mean = sum(map(len, docs.values())) / len(docs)
    total = 0
    for tokens, prefix in phrases:
        def count(words):
            ok = lambda i: all(words[i + j].startswith(t) if prefix and j == len(tokens) - 1 else words[i + j] == t for j, t in enumerate(tokens))
            return sum(ok(i) for i in range(len(words) - len(tokens) + 1))

        n = sum(count(w) > 0 for w in docs.values())
        idf, f = math.log((len(docs) - n + 0.5) / (n + 0.5)), count(docs[path])
        total += max(idf, 0) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[path]) / mean)) + (1e-6 * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[path]) / mean)) if idf <= 0 else 0)
    return total


@pytest.mark.parametrize("typed,found", [("copper", {"/pair", "/both", "/more"}), ("copper lamp", {"/pair", "/both"}), ('"copper la"', {"/pair"}), ("sao", {"/accent"}), ("plants", {"/accent"}), ("clam", {"/pair"}), ("absent", set())])
def test_indexed(spark, typed, found):
    q = Query.parse(typed)
    index = postings.build(bodies(spark))
    got = {r.path: r.score for r in search.indexed(index, q).collect()}
    assert got.keys() == found
    words = {r.path: r.w for r in bodies(spark).select("path", F.regexp_extract_all(F.translate(F.lower("text"), "üã", "ua"), F.lit(r"(\w+)"), F.lit(1)).alias("w")).collect()}
    for path, score in got.items():
        assert math.isclose(score, bm25(words, [p for t in q.terms for p in t.phrases()], path), rel_tol=1e-9)


def test_saved_index(spark, tmp_path):
    index = postings.build(bodies(spark))
    postings.save(index, str(tmp_path))
    again = postings.load(spark, str(tmp_path))
    for typed in ("copper lamp", '"copper lamp"', "a"):
        q = Query.parse(typed)
        assert sorted(search.indexed(again, q).collect()) == sorted(search.indexed(index, q).collect())
    assert "StartsWith" in again.postings.where(F.col("term").startswith("co"))._jdf.queryExecution().toString()
    assert sorted(again.terms.collect()) == sorted(index.terms.collect()) and again.totals.collect() == index.totals.collect()


def test_postings_of_odd_documents(spark, monkeypatch):
    texts = {"a": "b a b", "empty": "", "none": None, "blank": " - ", "long": "x y " * 3000, "z": "a"}
    df = spark.createDataFrame(list(texts.items()), "path string, text string").repartition(2)
    for size in (8 << 20, 5):
        monkeypatch.setattr(postings, "BYTES", size)
        index = postings.build(df)
        got = {(r.path, r.term): (r.tf, r.positions, r.dl) for r in index.postings.collect()}
        want = {}
        for p, t in texts.items():
            ws = [w for w in (t or "").split() if w != "-"]
            for i, w in enumerate(ws):
                n, at, _ = want.get((p, w), (0, [], 0))
                want[p, w] = (n + 1, [*at, i], len(ws))
        assert got == want
        assert {r.path: r.dl for r in index.lengths.collect()} == {"a": 3, "blank": 0, "long": 6000, "z": 1}
    assert postings.build(df.limit(0)).totals.first().docs == 0


def test_a_saved_index_moves_no_posting(spark, tmp_path):
    rows = [(f"d{i}", f"lamp oil w{i % 7} x{i}") for i in range(60)]
    postings.save(postings.build(spark.createDataFrame(rows, "path string, text string").repartition(3)), str(tmp_path))
    again = postings.load(spark, str(tmp_path))
    files = again.postings.select("path", F.input_file_name().alias("at")).distinct().collect()
    assert len(files) == 60 and len({r.at for r in files}) == 3  # a document's postings stay together
    for f in again.postings.inputFiles():
        terms = [r.term for r in spark.read.parquet(f).select("term").collect()]
        assert terms == sorted(terms, key=lambda x: x or "")
    assert again.postings.count() == 240 and again.lengths.count() == 60 == again.totals.first().docs


@pytest.mark.parametrize("common,rarer,short", [(200_000, 8, 200_000), (3, 1, 200_000), (3, 1, 0), (0, 0, 2), (1000, 0, 5)])
@pytest.mark.parametrize("n", [1, 3])
def test_rarest_words_by_rare_and_by_common_ones(spark, tmp_path, monkeypatch, common, rarer, short, n):
    for name, value in (("COMMON", common), ("RARER", rarer), ("SHORT", short)):
        monkeypatch.setattr(evaluate, name, value)
    texts = {f"d{i}": " ".join(["lamp", *["copper"] * (i % 2), *[f"tin{i % 5}"] * (i % 3), *[f"iron{i}", f"lead{i}", "ox"] * (i % 4 > 1)]) for i in range(40)} | {"few": "lamp", "none": "a of", "blank": " - ", "null": None, "copy": "lamp copper"}
    postings.save(postings.build(spark.createDataFrame(list(texts.items()), "path string, text string")), str(tmp_path))
    sets = {p: set((t or "").replace("-", " ").split()) for p, t in texts.items()}
    docs = {w: sum(w in s for s in sets.values()) for s in sets.values() for w in s}
    want = sorted((p, i + 1, w, docs[w]) for p, s in sets.items() for i, w in enumerate(sorted((w for w in s if len(w) >= 3), key=lambda w: (docs[w], w))[:n]))
    assert sorted(map(tuple, evaluate.rarest_words(postings.load(spark, str(tmp_path)), n).collect())) == want


def test_files_are_read_by_small_ranges_inside(spark):
    key = "spark.sql.files.maxPartitionBytes"
    had = spark.conf.get(key)
    with base.split(spark, 1 << 20):
        assert spark.conf.get(key) == str(1 << 20)
        with base.split(spark, 2 << 20):
            assert spark.conf.get(key) == str(1 << 20)
    assert spark.conf.get(key) == had


def test_one_shuffle_ranks(spark):
    plan = search.indexed(postings.build(bodies(spark)), Query.parse("copper"))
    plan.collect()
    assert "ReusedExchange" in plan._jdf.queryExecution().executedPlan().toString()


def lines(spark, rows):
    make = lambda i, p, role, text: (p, i, json.dumps({"message": {"role": role, "content": text}, "type": role}, separators=(",", ":")))
    return spark.createDataFrame([make(i, *r) for i, r in enumerate(rows)], "path string, offset int, raw string")


def test_run(spark):
    b = bodies(spark)
    index, ls = postings.build(b), lines(spark, [(p, "user", t) for p, t in BODIES.items()] + [("/sub", "assistant", "the clamp kaleidoscope"), ("/sub", "user", "write \"good night\" to D:\\Notes")])
    s = spark.createDataFrame([(p, "lamp of old" if p == "/both" else "x") for p in [*BODIES, "/sub"]], "path string, title string")
    go = lambda typed, mode="content": search.run(index, b, ls, s, typed, mode)
    hits, how = go("copper lamp")
    assert how == "indexed" and hits.orderBy(F.desc("score")).first().path == "/both"  # its title says half of it
    hits, how = go("f++")
    assert how == "indexed" and [(r.path, "F++" in r.excerpt) for r in hits.collect()] == [("/sign", True)]
    hits, how = go("eidosco")
    assert how == "scanned" and [r.path for r in hits.collect()] == ["/sub"]
    assert [r.path for r in go('write "good')[0].collect()] == ["/sub"]
    assert [r.path for r in go("D:\\Notes", "everything")[0].collect()] == ["/sub"]
    hits, how = go("copper lamp zebra")
    assert how == "partial" and [r.path for r in hits.orderBy(F.desc("score")).collect()][2] == "/more"
    assert go("  ")[0].count() == 0
    full = search.with_excerpts(go("lamp")[0], b, "lamp").collect()
    assert all("lamp" in r.excerpt for r in full)


def test_file_and_tool(spark):
    raw = ['{"message":{"role":"assistant","content":[{"type":"tool_use","name":"Render","input":{"file_path":"/srv/Tide table.csv"}}]}}', '{"cwd":"/srv/tide","name":"Render"}']
    ls = spark.createDataFrame([(f"/{i}", i, x) for i, x in enumerate(raw)], "path string, offset int, raw string")
    assert [r.path for r in search.structured(ls, "tide TABLE.csv", "file").collect()] == ["/0"] and search.structured(ls, "table tide", "file").count() == 0
    assert [r.path for r in search.structured(ls, "render", "tool").collect()] == ["/0"]


SESSION = "path string, id string, is_subagent boolean, parent string, cwd string, mtime long, size long, entries long, first_ts long, last_ts long, custom_title string, ai_title string, first_prompt string, last_prompt string, git_branch string, model string"


def sessions(spark):
    day = 86_400
    rows = [("a", False, None, "/w/r/s/sub", 0, "Today"), ("b", False, None, "/home/u/p", 1, "Yesterday"), ("c", False, None, "/home/u/p", 5, "Week"), ("d", False, None, "", 300, ""), ("k1", True, "a", "/w/r/s", 0, "Kid one"), ("k2", True, "a", "", 2, "Kid two"), ("o", True, "gone", "", 3, "Orphan"), ("o2", True, None, "", 4, "Orphan two")]
    data = [(f"/{i}", i, sub, par, cwd, NOW - age * day, 1000 * (age + 1), 10 * (age + 1), NOW - age * day - 600, NOW - age * day, title, "", "", "do it", "main", "") for i, sub, par, cwd, age, title in rows]
    s = spark.createDataFrame(data, SESSION).withColumns({t: F.lit(5) for t in TOKENS})
    marks = spark.createDataFrame([("c", True, ["perf"], "note"), ("x", True, ["gone"], "")], "id string, favorite boolean, tags array<string>, note string")
    procs = spark.createDataFrame([(7, "/home/u/p", None, None, False), (8, "/q", "a", "m", True)], "pid int, cwd string, resume_id string, model string, under_wsx boolean")
    wsx = spark.createDataFrame([("r", "s", "b", "/w/r/s"), ("r", "other", "b", "/w/r")], "repo string, slug string, branch string, path string")
    repos = spark.createDataFrame([("r", "/src/r")], "repo string, checkout string")
    s = O.with_child_counts(O.with_marks(s, marks))
    return O.with_places(O.with_live(s, procs), wsx, repos, "/w").withColumn("title", view.title_of()), marks


def test_overlays(spark):
    s, marks = sessions(spark)
    got = {r.id: r for r in s.collect()}
    assert got["a"].subagent_count == 2 and (got["a"].live_pid, got["a"].live_exact, got["a"].model) == (8, True, "m")
    assert (got["b"].live_pid, got["b"].live_exact, got["c"].live_pid) == (7, False, None)
    assert got["a"].wsx.worktree == "/w/r/s" and (got["a"].wsx.rest, got["a"].wsx.state) == ("sub", "live") and got["b"].wsx is None
    assert got["d"].title == "(untitled session)"
    assert tuple(O.marks_summary(marks, s).first()) == (1, 1, 1)
    assert {r.id for r in O.orphans(s).collect()} == {"o", "o2"}


def test_view(spark):
    s, _ = sessions(spark)
    show = lambda **k: [(r.row_kind, r.label) for r in view.listed(s, NOW, **k).orderBy("line").collect()]
    assert show() == [("divider", "favourites"), ("item", "Week"), ("divider", "today"), ("item", "Today"), ("divider", "yesterday"), ("item", "Yesterday"), ("divider", "this week"), ("item", "Orphan"), ("item", "Orphan two"), ("divider", "this year"), ("item", "(untitled session)")]
    assert show(sort="title", dates="7")[0] == ("item", "Week")
    kids = spark.createDataFrame([("a",)], "id string")
    assert show(expanded=kids)[3:6] == [("item", "Today"), ("sub", "Kid two"), ("sub", "Kid one")]
    assert show(tag="perf") == [("divider", "favourites"), ("item", "Week")] and show(tag="wsx/r")[1] == ("item", "Today")
    assert show(typed="yester") == [("item", "Yesterday")]
    heads = [(r.label, r.n) for r in view.listed(s, NOW, grouped=True, home="/home/u").where("row_kind = 'header'").orderBy("line").collect()]
    assert heads == [("r/s/sub", 1), ("~/p", 2), ("", 3)]
    hits = spark.createDataFrame([("/k1", 5.0, "kid"), ("/b", 2.0, "own")], "path string, score double, excerpt string")
    assert show(hits=hits, expanded=kids) == [("item", "Today"), ("sub", "Kid one"), ("item", "Yesterday")]
    assert [(r.id, r.score, r.excerpt) for r in search.results(s, hits).collect()] == [("a", 5.0, "kid"), ("b", 2.0, "own")]


def test_reports(spark):
    s, _ = sessions(spark)
    stats = {r.metric: r.value for r in report.stats(s).collect()}
    assert (stats["sessions"], stats["subagents"], stats["total_tokens"]) == (4, 4, 160)
    assert report.list_lines(s.where("id = 'b'"), NOW, "/home/u").first().value == "24h\t~/p\tYesterday\tb"
    j = json.loads(report.json_lines(s.where("id = 'a'")).first().value)
    assert j["id"] == "a" and j["wsx"]["slug"] == "s" and j["live_pid"] == 8
    bad = spark.createDataFrame([("a", "x\ty"), ("b", "z")], "id string, title string")
    assert [r.value for r in report.plan_lines(bad, "id", "title").collect()] == ["b\tz"]


def test_every_session_has_its_line(spark):
    s = spark.range(300).select(F.format_string("/%03d", "id").alias("path"), (F.col("id") % 5 == 0).alias("favorite"), (F.col("id") % 7).alias("mtime"), (F.col("id") % 3).alias("size")).repartition(5)
    got = [(r.line, r.path) for r in view.numbered(s, "size").orderBy("line").collect()]
    want = sorted(range(300), key=lambda i: (i % 5 != 0, -(i % 3), -(i % 7), f"/{i:03d}"))
    assert got == [(n + 1, f"/{i:03d}") for n, i in enumerate(want)]
    assert view.numbered(s.limit(0), "size").count() == 0


def test_ties_of_a_folder_go_to_the_first_path(spark):
    rows = [(f"/{i}", i, False, None, "/q", NOW - age, "") for i, age in (("c", 0), ("b", 0), ("d", 5), ("a", 9))]
    s = spark.createDataFrame(rows, "path string, id string, is_subagent boolean, parent string, cwd string, mtime long, model string")
    p = spark.createDataFrame([(4, "/q", None, None, False)], "pid int, cwd string, resume_id string, model string, under_wsx boolean")
    assert [r.id for r in O.with_live(s, p).where("live_pid = 4").collect()] == ["b"]


def test_picks_without_a_session_go(spark):
    s, _ = sessions(spark)
    picked = spark.createDataFrame([("/a",), ("/left",)], "path string")
    assert [r.path for r in view.retained(picked, s).collect()] == ["/a"]


def test_a_tag_edit_is_of_the_chosen_and_a_rename_of_all(spark):
    marks = spark.createDataFrame([("a", True, ["x", "y"], ""), ("b", False, ["x"], ""), ("c", False, ["y"], "n")], "id string, favorite boolean, tags array<string>, note string")
    chosen = spark.createDataFrame([("b",), ("c",), ("new",), ("new",), (None,)], "id string")
    after = lambda typed: {r.id: r.tags for r in tags.applied(marks, chosen, typed).collect()}
    assert after("Z, wsx/q") == {"a": ["x", "y"], "b": ["x", "z"], "c": ["y", "z"], "new": ["z"]}
    assert after("-x") == {"a": ["x", "y"], "c": ["y"]}  # b and new have nothing left
    assert after("x>y") == {"a": ["y"], "b": ["y"], "c": ["y"]}
    assert after("x>wsx/q") == after(" ") == {"a": ["x", "y"], "b": ["x"], "c": ["y"]}
    assert tags.applied(marks.limit(0), chosen.limit(0), "z").count() == 0


def test_folders_and_their_subagents_lie_as_a_plain_sort_lays_them(spark):
    rows = [(f"{i}", f"/{i:03d}", i % 4 == 3, f"{i - 3}" if i % 4 == 3 else None, f"/w{i % 6}" if i % 10 else "", i % 3, i % 11 == 0, i % 5, f"t{i % 2}") for i in range(120)]
    plain = spark.createDataFrame(rows, "id string, path string, is_subagent boolean, parent string, cwd string, mtime long, favorite boolean, size long, title string").repartition(4)
    s = plain.withColumn("wsx", F.lit(None).cast("struct<repo:string,slug:string,rest:string,state:string,worktree:string,checkout:string>"))
    got = [(r.row_kind, r.label if r.row_kind == "header" else r.path, r.n) for r in view.listed(s, NOW, sort="size", grouped=True, expanded=s.select("id")).orderBy("line").collect()]
    tops = sorted((r for r in rows if not r[2]), key=lambda r: (not r[6], -r[7], -r[5], r[1]))
    by = {}
    for r in tops:
        by.setdefault(r[4], []).append(r)  # folders come in the order of their first sessions
    want = []
    for folder in sorted(by, key=lambda f: -max(r[5] for r in by[f])):
        want.append(("header", folder, len(by[folder])))
        for r in by[folder]:
            want.append(("item", r[1], None))
            want += [("sub", k[1], None) for k in sorted((k for k in rows if k[3] == r[0]), key=lambda k: (k[5], k[1]))]
    assert [(kind, label if kind != "header" else label.replace("~", ""), n) for kind, label, n in got] == want
