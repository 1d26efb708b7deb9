"""Display cells of columns, folders that are looked for, and the sink."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import overlay
from loomline.sources import side, sink, transcripts


def test_cells_of_columns_equal_the_plain_ones(spark):
    r = random.Random(2)
    letters = "abc é日本ｗ한́͏​‍️⚠❤1#✔😀𠀀\U000e0041\x1b‮﷽"
    rows = ["".join(r.choices(letters, k=r.randint(0, 14))) for _ in range(400)] + ["", "a" * 5000, "日" * 9, "⚠️", "x⚠️y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, None])], "n int, t string").repartition(2)
    for width in (0, 1, 2, 5, 9):
        got = {x.n: (x.fit, x.pad) for x in df.select("n", X.fitted(F.col("t"), width).alias("fit"), X.fitted(F.col("t"), width, pad=True).alias("pad")).collect()}
        for i, t in enumerate([*rows, ""]):
            assert got[i] == (X.fit_text(t, width), X.pad_fit(t, width)), (t, width)
            assert X.display_width(got[i][1]) == width
    assert X.display_width("⚠️") == 2 and X.display_width("日本") == 4 and X.display_width("é") == 1


def test_folders_are_looked_for_once(spark, tmp_path, monkeypatch):
    (tmp_path / "there").mkdir()
    (tmp_path / "file").write_text("")
    here = [str(tmp_path / x) for x in ("there", "gone", "file", "file/below", "x" * 300)]
    s = spark.createDataFrame([(str(i), c) for i, c in enumerate([*here, *here, "", None])], "id string, cwd string")
    states = side.folders(s)
    found = {r.cwd: r.state for r in states.collect()}
    assert list(found[c] for c in here) == ["present", "missing", "missing", "missing", "unknown"] and len(found) == 5
    shown = {r.id: r.cwd_missing for r in overlay.with_probed_folders(s, states).collect()}
    assert [shown[str(i)] for i in range(5)] == [False, True, True, True, None] and shown["10"] is False


def test_a_folder_that_hangs_is_unknown(monkeypatch):
    import pyarrow as pa

    kept = {}

    monkeypatch.setattr(side, "_is_folder", lambda p: time.sleep(0.6 if p == "slow" else 0) or "present")
    frame = type("Frame", (), {"select": lambda s, *_: s, "where": lambda s, *_: s, "distinct": lambda s: s, "mapInArrow": lambda s, run, schema: kept.setdefault("run", run)})()
    side.folders(frame, seconds=0.1)
    out = next(kept["run"](iter([pa.record_batch([pa.array(["a", "slow", "b"])], names=["cwd"])])))
    assert out.column(1).to_pylist() == ["present", "unknown", "present"]


def test_sink_writes_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    lines = [(f"-p{i % 2}", f"s{i}", "s0" if i == 3 else None, n, f'{{"n":{n},"é":"{"x" * n}"}}') for i in range(5) for n in range(40)]
    df = spark.createDataFrame([*lines, ("-p0", "s0", None, 99, None)], "project string, session string, parent string, offset int, raw string").repartition(4)
    sink.write(df, root)
    got = {}
    for r in transcripts.read(spark, root, splitBytes="100").collect():
        got.setdefault(r.path.removeprefix(root), []).append((r.offset, r.raw))
    assert set(got) == {"/-p0/s0.jsonl", "/-p1/s1.jsonl", "/-p0/s2.jsonl", "/-p1/s0/subagents/s3.jsonl", "/-p0/s4.jsonl"}
    assert all([raw for _, raw in sorted(v)] == [x[4] for x in lines[:40]] for v in got.values())
    before = sorted((p, os.path.getmtime(p)) for p in transcripts.listing(root))
    with pytest.raises(Exception, match="exists"):
        sink.write(df, root)  # nothing is replaced unless asked for
    boom = df.withColumn("raw", F.when((F.col("session") == "s4") & (F.col("offset") == 39), F.raise_error(F.lit("a task fails")).cast("string")).otherwise("raw"))
    with pytest.raises(Exception, match="a task fails"):
        sink.write(boom, root, overwrite=True)
    assert sorted((p, os.path.getmtime(p)) for p in transcripts.listing(root)) == before
    assert not os.listdir(f"{root}/{sink.HIDDEN}")
    sink.write(df.where("session = 's2' AND offset < 3"), root, overwrite=True)
    assert len(open(f"{root}/-p0/s2.jsonl").readlines()) == 3
