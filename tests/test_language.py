"""Query language, filter, number formats and side inputs. The vectors are made from the rules."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import fuzzy
from loomline.functions import numbers as N
from loomline.functions import spot
from loomline.functions import text as X
from loomline.functions.query import Query, root
from loomline.operators import snapshot, tags
from loomline.sources import side


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_expressions():
    """Typed parts in a row, told again plainly: a word is a term, with a star from three letters on; a quotation is one phrase with a star; what has no letter or digit vanishes unless it is a symbol, which no index knows."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("bcdfgkmpqtvwxz", k=r.randint(1, 7)))  # noqa: E731  no English ending
    for _ in range(400):
        typed, want = [], []
        for _ in range(r.randint(0, 4)):
            kind = r.choice(["word", "phrase", "mark", "symbol"])
            if kind == "word":
                w = word()
                typed.append(r.choice([w, w.upper()]))
                want.append(f'"{w}"' + "*" * (len(w) > 2))
            elif kind == "phrase":
                ws = [word() for _ in range(r.randint(1, 3))]
                left, right = r.choice(['""', "“”"])
                typed.append(left + r.choice([" ", "   "]).join(ws) + right)
                want.append(f'"{" ".join(ws)}"*')
            else:
                typed.append("".join(r.choices(".,;:!?…" if kind == "mark" else "=<>+|", k=r.randint(1, 3))))
        if r.random() < 0.2:  # a quotation that isn't closed runs to the end
            ws = [word() for _ in range(r.randint(1, 3))]
            typed.append('"' + " ".join(ws))
            want.append(f'"{" ".join(ws)}"*')
        gap = r.choice([" ", "  ", "\t", "\n"])
        text = r.choice(["", " "]) + gap.join(typed) + ("" if typed and typed[-1].startswith('"') and typed[-1].count('"') == 1 else r.choice(["", " "]))
        assert Query.parse(text).all_of() == " AND ".join(want), text
    assert Query.parse("gardening").all_of() == '("gardening"* OR "garden"*)'


def test_roots():
    """One word per ending and per exception: an ending's stem has four letters at least; doubled consonants become one, but for s, l and z."""
    want = {"carbonization": "carboniz", "plantations": "plant", "shipments": "ship", "kindness": "kind", "gardening": "garden", "snapping": "snap", "planned": "plan", "rolling": "roll", "stories": "story", "berried": "berry", "boxes": "box", "lamps": "lamp", "rapidly": "rapid", "carve": "carv", "windy": "windi"}
    want["boxes"] = None  # a stem of three letters
    want |= {"wishes": "wish", "marshes": "marsh"}
    want |= dict.fromkeys(["glass", "cactus", "basis", "mixed", "sing", "day", "lib/io.c", "wombat", "Берег"])
    assert {w: root(w) for w in want} == want


SYMBOLS, MARKS, UNSPACED_LETTERS = "+#$~_@%=<>^|/&€§°", ".,;:!?…()[]{}*«»¡¿–—·'", "กあア中漢ကខ"


@pytest.mark.parametrize("quoted", [False, True])
def test_routing(quoted):
    """Each character of each class at a word's start, at its end, inside it and alone. Only a symbol at an edge, and a letter of a script without spaces anywhere, is beyond the index."""
    put = (lambda w: f'"{w}"') if quoted else (lambda w: w)
    for c in SYMBOLS + MARKS + UNSPACED_LETTERS:
        places = {"start": f"{c}mop", "end": f"mop{c}", "inside": f"mop{c}rag", "alone": c, "among": f"rag mop{c} tin"}
        for place, w in places.items():
            want = c in UNSPACED_LETTERS or (c in SYMBOLS and place != "inside")
            assert Query.parse(put(w)).beyond_tokens() == want, (c, place)
    assert not Query.parse(put("Ñandú straße Κήπος сад")).beyond_tokens()


def test_filter_rules():
    def finds(typed, **fields):
        return fuzzy.Filter.parse(typed).score(list(fields.items())) is not None

    assert finds("orc", title="Orchard map") and not finds("omp", title="Orchard map")  # three letters stand together
    assert not finds("qqqq", title="Orchard map") and finds("mapdrw", title="Map drw") and finds("map orchard", title="Orchard map")
    assert not finds("lamp", prompt="l a m p") and finds("lamp", prompt="clamp")  # long fields are matched as written
    assert not finds("or", title="door") and finds("or", title="door or")  # two letters begin a word
    assert finds("'map", title="a map here") and finds("^orch", title="Orchard map") and not finds("^map", title="Orchard map") and finds("map$", title="Orchard map") and finds("^orchard map$", title="x") is False
    assert not finds("orchard !map", title="Orchard map") and finds("orchard !lamp", title="Orchard map")
    assert finds("beef", id="beef0123") and not finds("ef01", id="beef0123") and finds("ef012345", id="beef01234567") and not finds("zzzz", id="zzzz")
    f = fuzzy.Filter.parse("lamp")
    assert f.score([("title", "lamp")]) > f.score([("prompt", "lamp")])
    assert f.positions("title", "old lamp") == [4, 5, 6, 7]


def test_rows_that_cannot_match_never_reach_python(spark):
    """Scores are the loop's own on random fields; the native condition lies below Python and lets no match go."""
    r = random.Random(6)
    text = lambda: "".join(r.choices("abcdeAB -_/019é", weights=[9] * 14 + [1], k=r.randint(0, 14)))
    rows = [(i, *(text() if r.random() < 0.9 else None for _ in range(4))) for i in range(400)]
    names = ["title", "prompt", "id", "branch"]
    df = spark.createDataFrame(rows, "n int, title string, prompt string, id string, branch string").repartition(2)
    fields = {c: F.col(c) for c in names}
    reached = 0
    for typed in ["ab", "abc", "abce", "a b", "'bc", "^ab", "e$", "^a$", "!ab", "ca !é", "abé", "0190", "bade", "dabc ab", "019019ab", "A\\ b"]:
        f = fuzzy.Filter.parse(typed)
        want = {x[0]: s for x in rows if (s := f.score([(c, v or "") for c, v in zip(names, x[1:], strict=True)])) is not None}
        assert {x.n: x.filter_score for x in fuzzy.accepted(df, fields, typed).collect()} == want, typed
        reached += df.where(fuzzy.possible(fields, typed)).count()
    assert reached < 400 * 16 * 0.7
    plan = fuzzy.accepted(df, fields, "abce")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RLIKE")


def test_formats(spark):
    rows = {N.human_size: {0: "0B", 1023: "1023B", 1024: "1.0K", 10_200: "10K", 10_239: "10K", 1_048_575: "1.0M", 5 << 30: "5.0G", 3 << 40: "3.0T"}, N.human_dur: {0: "-", 59: "59s", 3599: "59m", 7260: "2h1m", 90_000: "1d1h"},
            N.compact_count: {999: "999", 1000: "1.0k", 9949: "9.9k", 9950: "10k", 999_499: "999k", 999_500: "1.0m", 4_000_000_000: "4.0b"}, N.human_count: {999: "999", 1500: "2k", 999_499: "999k", 999_500: "1.0m", 999_949_999: "999.9m", 999_950_000: "1.00b", 12_345_678_901_234: "12.35t"}}
    for f, cases in rows.items():
        got = {r.n: r.s for r in spark.createDataFrame([(n,) for n in cases], "n long").select("n", f(F.col("n")).alias("s")).collect()}
        assert got == cases
    assert one(spark, N.iso_to_epoch(F.lit("2026-01-02T03:04:05.678+01:00"))) == int(datetime.datetime(2026, 1, 2, 2, 4, 5, tzinfo=datetime.UTC).timestamp())
    assert [one(spark, N.iso_to_epoch(F.lit(x))) for x in ("2026-01-02", "junk", "2026-01-02T03:04:05")] == [0, 0, 0]
    now = 1_700_000_000
    ages = {0: "today", 86_400: "yesterday", 5 * 86_400: "this week", 20 * 86_400: "this month", 300 * 86_400: "this year", 900 * 86_400: "older"}
    assert {a: one(spark, N.date_band(F.lit(now - a), F.lit(now))) for a in ages} == ages
    v = spark.createDataFrame([(x,) for x in ("1.10.0", "1.9.0", "1.9.0-rc.2", "1.9.0-rc.10", "v1.9.0-beta")], "v string")
    assert [r.v for r in v.orderBy(N.semver_key(F.col("v"))).collect()] == ["v1.9.0-beta", "1.9.0-rc.2", "1.9.0-rc.10", "1.9.0", "1.10.0"]


def squashed(s, most):
    out = ""
    for word in "".join(" " if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else "" if ord(c) < 32 or 127 <= ord(c) < 160 or c in "؜‎‏‪‮⁦⁩" else c for c in s).split(" "):
        if word:
            out += (" " if out else "") + word
    return out[:most].rstrip(" ")


def test_squash(spark):
    r = random.Random(0)
    rows = ["".join(r.choices("ab \t\n\x85\xa0 \x07\x1b‮é日", k=r.randint(0, 14))) for _ in range(300)]
    got = spark.createDataFrame([(x,) for x in rows], "s string").select("s", X.squash(F.col("s"), 6).alias("q")).collect()
    assert all(x.q == squashed(x.s, 6) for x in got)


def test_scalars(spark):
    assert one(spark, X.normalize_tag(F.lit("  My Tag! ü/x "))) == "my-tag-ü/x"
    assert one(spark, X.short_cwd(F.lit("/home/u/p"), "/home/u")) == "~/p" and one(spark, X.short_cwd(F.lit("/home/us"), "/home/u")) == "/home/us"
    assert one(spark, X.tsv(F.lit("a\tb\\\n\x1b"))) == "a\\tb\\\\\\n\\x1b"
    assert one(spark, X.fold(F.lit("CAFÉ Ñandú"))) == "cafe nandu" == X.fold_text("CAFÉ Ñandú")
    assert one(spark, X.unescaped(F.lit(r"a\\nb\néc\"d"))) == 'a\\nb éc"d'
    half, whole = "\\ud83d", "\\ud83d\\ude00"
    assert one(spark, X.mend_surrogates(F.lit(f"{half} {whole} \\ude00"))) == f"\\ufffd {whole} \\ufffd"
    assert one(spark, X.looks_like_uuid(F.lit("01234567-89ab-cdef-0123-456789abcdef")))
    assert X.fit_text("日本語", 5) == "日本…" and X.pad_fit("ab", 4) == "ab  "
    assert side.parse_color("#0a0B0c") == (10, 11, 12) and side.parse_color("nope") is None


def test_best_place_by_pointers_equals_windows():
    """Every place of the rarest term is looked at alone, and each other term searched for among its places within 80 characters."""
    r = random.Random(9)
    words = ["lamp", "lamps", "copper", "éa", "oil", "by", "==>", "日本"]
    for _ in range(300):
        text = "".join(r.choice(words) + r.choice([" ", ", ", " " * r.randint(1, 60), ""]) for _ in range(r.randint(0, 60)))
        s = spot.Spotter.of(" ".join(r.sample(words, r.randint(1, 4))), r.random() < 0.3)
        per = [s.places(text, i, 1 << 30) for i in range(len(s.terms))]
        want = None
        if any(per):
            anchor = min((i for i, p in enumerate(per) if p), key=lambda i: len(per[i]))
            near = lambda a: sum(any(x >= a - spot.NEAR and y <= a + spot.NEAR for x, y in p) for i, p in enumerate(per) if i != anchor)
            want = max(per[anchor], key=lambda p: (near(p[0]), -p[0]))[0]
        assert s.best(text) == want
    many = "lamp " * 30_000 + "copper lamp"
    assert spot.Spotter.of("lamp copper").best(many) == len("lamp ") * 30_000


def test_excerpts():
    far = "lamp " + "- " * 150 + "under the copper lamp by the door " + "+ " * 150
    assert "copper" in spot.excerpt_text(far, spot.Spotter.of("copper lamp"))
    assert spot.Spotter.of("lamp").count("clamp") == 0 and spot.Spotter.of("lamp", True).count("clamp") == 1
    assert spot.Spotter.of("orchard plantation").count("Plant an orchard") == 2
    line = '{"parentUuid":"p","message":{"role":"user","content":"what role has harbor"},"gitBranch":"harbor","note":"<system-reminder>hidden"}'
    where = lambda w: spot.real_place(line, line.lower(), [w])
    assert where("role") == line.index("role has") and where("harbor") == line.index("harbor")
    assert where("hidden") is None and where("parentuuid") is None
    blob = '{"message":{"role":"user","content":"' + "Q" * 70 + "lamp" + "Z" * 70 + '"}}'
    assert spot.real_place(blob, blob.lower(), ["lamp"]) is None
    edge = lambda n: '{"message":{"role":"user","content":"x"},"' + "k" * n + 'lamp":"v"}'
    assert all(spot.real_place(edge(n), edge(n), ["lamp"]) is None for n in (1, 59, 60, 61, 100))


@pytest.mark.parametrize("query", ["copper lamp", "Über öl", '"old pier" c++', "plantation", "...", "a.b (x)"])
def test_terms_in_columns_and_in_text(spark, query):
    texts = ["Copper lamps, clamp", "ÜBER Öl über_öl", "the old pier in c++", "PLANTS plantations", "a.b (x) axb", "", None, "_copper 9lamp lamp"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spot.terms_in(F.col("t"), query).alias("n"))
    s = spot.Spotter.of(query)
    assert {r.i: r.n for r in df.collect()} == {i: s.count(t or "") for i, t in enumerate(texts)}


def test_marks_are_salvaged_field_by_field(spark, tmp_path):
    doc = {"sessions": {"a": {"favorite": True, "tags": ["B b", "a", "a"], "note": " n \n"}, "b": {"favorite": "yes", "tags": "x", "note": 3}, "c": {}}}
    p = tmp_path / "marks.json"
    p.write_text(json.dumps(doc))
    got = {r.id: (r.favorite, r.tags, r.note, r.bad) for r in side.load_marks(spark, str(p)).collect()}
    assert got == {"a": (True, ["a", "b-b"], "n", 0), "b": (False, [], "", 3), "c": (False, [], "", 0)}
    p.write_text("{broken")
    assert side.load_marks(spark, str(p)).count() == 0 and (tmp_path / "marks.json.unreadable").exists()


def test_tag_edits(spark, tmp_path):
    e = tags.parse_edit("One, two  wsx/x")
    assert (e.add, e.refused) == (["one", "two"], ["wsx/x"])
    assert tags.parse_edit("-a b").remove == ["a", "b"] and tags.parse_edit("old > new").rename == [("old", "new")] and tags.parse_edit("old>wsx/x").refused
    m = spark.createDataFrame([("a", True, ["x", "y"], ""), ("b", False, ["x"], "")], "id string, favorite boolean, tags array<string>, note string")
    patch = spark.createDataFrame([("b", None, None, [], ["x"]), ("c", None, "hi", ["z"], [])], "id string, favorite boolean, note string, added array<string>, removed array<string>")
    assert {r.id: (r.favorite, r.tags, r.note) for r in tags.merged(m, patch).collect()} == {"a": (True, ["x", "y"], ""), "c": (False, ["z"], "hi")}
    assert [(r.tag, r.n) for r in tags.tag_counts(tags.renamed(m, "y", "x")).collect()] == [("x", 2)]
    for _ in range(3):
        tags.save(m, str(tmp_path / "m.json"))
    assert side.load_marks(spark, str(tmp_path / "m.json")).count() == 2 and (tmp_path / "m.json.2").exists()


def test_side_tables(spark):
    lines = lambda *x: spark.createDataFrame([(i, s) for i, s in enumerate(x)], "line_no int, value string")
    assert [tuple(r) for r in side.workspaces(lines("r\ts\tb\t/w/r/s/", "bad", "r\tt\tb\trel")).collect()] == [("r", "s", "b", "/w/r/s")]
    repos = spark.createDataFrame([("r",)], "repo string")
    assert [tuple(r) for r in side.repo_checkouts(lines("r     /src/r", "r /other", "q /q"), repos).collect()] == [("r", "/src/r")]
    assert [tuple(r) for r in side.panes(lines("s\t12\trun\tx", "bad")).collect()] == [("s", 12, "run\tx")]
    assert [r.session for r in side.shared_sessions(lines("a\tb\t s ", "a\tb")).collect()] == ["s"]
    u = "01234567-89ab-cdef-0123-456789abcdef"
    args = spark.createDataFrame([(1, ["c", "--resume", u, "--model", "m"]), (2, ["c", f"--session-id={u}"]), (3, ["c", "-r", u, "--fork-session"]), (4, ["c", "--resume"])], "k int, args array<string>")
    assert {r.k: tuple(r.c) for r in args.select("k", side.command_line(F.col("args")).alias("c")).collect()} == {1: (u, "m"), 2: (u, None), 3: (None, None), 4: (None, None)}


def test_settings(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('sort = "size"\ngroup = "yes"\nodd = 1\n')
    got, said = side.settings(str(p))
    assert got["sort"] == "size" and got["group"] is False and said == ["wrong type: group", "unknown: odd"]
    p.write_text('sort = "size"\ngroup = = 1\n')
    assert side.settings(str(p))[0]["sort"] == "size"


def test_snapshot_rolls_over_boots(spark, tmp_path):
    entry = lambda i: {"id": i, "cwd": "/x", "model": "", "perms": "", "title": f" t \n{i}"}
    doc = json.dumps({"current": {"boot": "btime 1000", "saved_at": 1, "sessions": [entry("a"), entry("b")], "dismissed": False}})
    snap = side.snapshot(spark.createDataFrame([(doc,)], "value string"))
    seen = spark.createDataFrame([([entry("b"), entry("c")],)], f"sessions array<{side.ENTRY}>")
    same = snapshot.fold(snap, seen, "btime 1030", 5).first()
    assert [e.id for e in same.current.sessions] == ["b", "c", "a"] and same.previous is None
    rolled = snapshot.fold(snap, seen, "btime 9000", 5)
    r = rolled.first()
    assert [e.id for e in r.current.sessions] == ["b", "c"] and [e.id for e in r.previous.sessions] == ["a", "b"] and r.previous.sessions[0].title == "t a"
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [x.id for x in snapshot.pending(rolled, ids.where("id = 'b'"), ids).collect()] == ["a"]
    snapshot.save(rolled, str(tmp_path / "s.json"))
    assert "previous" in (tmp_path / "s.json").read_text()


def test_tsv_takes_the_whole_text(spark, tmp_path):
    from loomline.plans import registry

    texts = ["x" * 500 + "\t\\\n\x1b\r" + "é" * 500, "plain " * 100, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.value for r in registry.QUERIES["tsv_lines"](spark, str(tmp_path)).collect()}
    assert got == {0: "x" * 500 + "\\t\\\\\\n\\x1b\\r" + "é" * 500, 1: texts[1], 2: "", 3: None}


def test_arguments():
    from loomline.functions import options

    assert options.checked(["--list", "--restore"]) == {"--list": None, "--restore": "5"}
    assert options.checked(["--search", "--odd words", "--search-mode", "file"]) == {"--search": "--odd words", "--search-mode": "file"}
    assert options.checked(["--restore", "--json"]) == {"--restore": "5", "--json": None} and options.checked(["--restore", "12"])["--restore"] == "12"
    for bad in (["--lst"], ["--restore", "--nope"], ["--search"], ["--search", "x", "--search-mode"], ["--search", "x", "--search-mode", "--json"], ["--search-mode", "file"], ["--search", "x", "--search-mode", "web"], ["--restore", "0"], ["--restore", "two"], ["word"]):
        with pytest.raises(options.Refused):
            options.checked(bad)
