import subprocess

import pytest

from gramsieve import commands
from gramsieve.operators import index as ix
from gramsieve.operators import reports
from gramsieve.operators.search import find_matches
from gramsieve.plans.planner import Override
from gramsieve.streaming import delta, overlay

BASE = [("a/ink.txt", "blue ink and black ink"), ("a/pen.txt", "a pen for ink"), ("b/paper.txt", "white paper"), ("old.txt", "ink, dried")]
CHANGES = [("a/pen.txt", "M", "no longer", 1), ("a/pen.txt", "M", "green ink pen", 2), ("old.txt", "D", None, 1), ("new.txt", "A", "ink anew", 1), ("brief.txt", "A", "ink", 1), ("brief.txt", "D", None, 2)]


@pytest.fixture(scope="module")
def base(spark):
    return ix.number_files(spark.createDataFrame(BASE, "path string, text string")).cache()


def test_overlay_equals_merged_snapshot(spark, base):
    changes = spark.createDataFrame(CHANGES, delta.CHANGE)
    layer = overlay.Overlay(changes)
    known = ix.Index(base.select("file_id", "path"), ix.postings_of(base), sparse=True)
    snapshot = delta.merged(base, changes)
    for p in ("ink", "green|white", "longer", "in(k|n)", r"\w+"):
        want = sorted(find_matches(snapshot, p).collect())
        assert sorted(overlay.scan(base, layer, p).collect()) == want
        assert sorted(delta.search_indexed(known, base, changes, p).collect()) == want
        for override in Override:
            assert sorted(layer.search(known, base, p, override).collect()) == want
    assert {r.path: r.status for r in delta.diff(base, snapshot).collect()} == {"a/pen.txt": "Modified", "old.txt": "Deleted", "new.txt": "Added"}


def test_layer(spark):
    layer = overlay.Overlay(spark.createDataFrame(CHANGES, delta.CHANGE))
    ids = {r.path: r.file_id for r in layer.path_of(layer.all_of([])).collect()}
    assert ids == {"a/pen.txt": overlay.FIRST, "new.txt": overlay.FIRST + 1}
    assert {r.file_id for r in layer.all_of([b"ink", b"pen"]).collect()} == {overlay.FIRST}
    assert layer.lookup([b"ink"]).count() == 2 and layer.candidates("anew").count() == 1
    assert layer.is_deleted("old.txt") and layer.is_deleted("brief.txt") and not layer.is_deleted("new.txt")
    assert tuple(layer.counts().head()) == (2, 2, False)
    more = layer.put("old.txt", "back").delete("new.txt")
    assert {r.path for r in more.deleted().collect()} == {"brief.txt", "new.txt"} and not more.is_deleted("old.txt")
    assert more.lookup([b"ink"]).count() == 1 and more.lookup([b"bac"]).count() == 1
    assert tuple(overlay.Overlay.empty(spark).counts().head()) == (0, 0, True)
    assert overlay.is_internal("x/.gramsieve/files/p") and not overlay.is_internal("x/gramsieve/p")


def test_a_layer_gives_only_the_grams_looked_up(spark):
    layer = overlay.Overlay(spark.createDataFrame(CHANGES, delta.CHANGE))
    assert {(bytes(r.gram), r.file_id) for r in ix.postings_of(layer.corpus, only=[b"ink", b"QQQ", b"an"]).collect()} == {(b"ink", overlay.FIRST), (b"ink", overlay.FIRST + 1), (b"an", overlay.FIRST + 1)}
    assert "Filter" not in layer.lookup([b"ink"])._jdf.queryExecution().analyzed().toString().split("MapInArrow")[0]
    assert layer.index.frequencies([b"ink", b"QQQ"]) == {b"ink": 2} and layer.index.frequencies([]) == {}


def test_dirty_files_of_a_repository(spark, tmp_path):
    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)

    git("init", "-q")
    for path, text in BASE:
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "old.txt").unlink()
    (tmp_path / "a/pen.txt").write_text("green ink pen")
    (tmp_path / "_new.txt").write_text("ink anew")
    (tmp_path / ".gramsieve").mkdir()
    (tmp_path / ".gramsieve/own.txt").write_text("ink of the index")
    layer = overlay.Overlay.of_repository(spark, str(tmp_path))
    assert sorted((r.path, r.op) for r in layer.last.collect()) == [("_new.txt", "A"), ("a/pen.txt", "M"), ("old.txt", "D")]
    assert sorted(r.path for r in overlay.Overlay.of_repository(spark, str(tmp_path), "HEAD").last.collect()) == ["_new.txt", "a/pen.txt", "old.txt"]


def test_commands_keep_up_with_a_tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    texts = {f"d{i}/f{i}.txt": f"file number {i} with ink {'x' * i}" for i in range(8)} | {"_pkg/__init__.py": "import ink", ".dot/z": "hidden ink"}

    def put(path, text):
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)

    for path, text in texts.items():
        put(path, text)

    def agree(*patterns, n=None):
        for p in patterns:
            want = commands.search(spark, root, p, scan=True).collect()
            assert commands.search(spark, root, p).collect() == want and (n is None or len(want) == n), p

    agree("ink", n=9)  # no index yet
    assert commands.index(spark, root)["forced"]
    assert commands.index(spark, root)["up_to_date"]
    agree("ink", "number [3-5]", "hidden")
    assert len(commands.search(spark, root, "hidden", hidden=True).collect()) == 1
    put("d1/f1.txt", "changed, no longer the same")
    put("new.txt", "new ink")
    (tmp_path / "tree/d2/f2.txt").unlink()
    agree("ink", "changed", "number [1-3]")  # the index is older than the tree
    done = commands.index(spark, root)
    assert (done["changed_files"], done["rebuild"]) == (3, False)
    agree("ink", "changed", "number [1-3]")
    known = ix.Index.open(spark, commands.place(root))
    assert {r.path for r in known.files.collect()} == (set(texts) - {".dot/z", "d2/f2.txt"}) | {"new.txt"}
    plain = ix.postings_of(known.files.select("file_id", "path").join(commands._files(spark, root).select("path", "text"), "path"))
    assert sorted((r.file_id, bytes(r.gram)) for r in plain.collect()) == sorted((r.file_id, bytes(r.gram)) for r in known.postings.collect())
    for i in range(3, 8):
        put(f"d{i}/f{i}.txt", "all new")
    assert commands.index(spark, root)["rebuild"] and commands.search_files(spark, root, "all new").count() == 5
    assert commands.index(spark, root, full=True)["rebuild"]
    assert commands.stats(spark, root).head().file_count == 9
    assert commands.plan(spark, "all new").head().trigram_lookups == 5


def test_reports(spark, tmp_path):
    for name, text in {"g/b": '{"mean": {"point_estimate": 2500.0}, "std_dev": {"point_estimate": 10.0}}', "g/a": '{"mean": {"point_estimate": 7}, "std_dev": {"point_estimate": 1}}', "g/c": "no json", "report/x": '{"mean": {"point_estimate": 7}, "std_dev": {"point_estimate": 1}}'}.items():
        (tmp_path / name / "new").mkdir(parents=True)
        (tmp_path / name / "new/estimates.json").write_text(text)
    rows = reports.estimates(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("g", "a", 7.0, 1.0), ("g", "b", 2500.0, 10.0)]
    assert reports.as_text(rows) == "[g]\n  a: 7.00 ns (+/- 1.00)\n  b: 2.50 us (+/- 0.01)\n2 results"
    assert '"timestamp": "unix:5"' in reports.as_json(rows, reports.stamp(5.9))
    assert reports.estimates(spark, str(tmp_path / "none")).count() == 0
    text = "x/y\n  change: [+1% +30.0% +40%]\n"
    assert commands.check_budgets(spark, text, "[b]\nregression_pct = 10\ncritical = true\n", [("x/*", "b")]).head().status == "critical"


def test_stream_of_changes(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("a", "A", "ink one", 1), ("a", "M", "dry", 2), ("b", "A", "ink two", 1), ("c", "D", None, 1)], delta.CHANGE).write.parquet(source)
    found = []
    stream = spark.readStream.schema(delta.CHANGE).parquet(source)
    delta.follow(stream, None, "ink", lambda m, _: found.extend(m.collect()), str(tmp_path / "c")).awaitTermination()
    assert [(r.path, r.text) for r in found] == [("b", "ink")]
