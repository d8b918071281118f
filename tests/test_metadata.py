from quillpath.plans import meta_queries, metadata, search
from quillpath.sources import source_files
from quillpath.sources.modules import parse, read_modules
from quillpath.streaming import incremental


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


def test_parse_edges():
    assert parse("a/b.py", "\x00")["error"]
    assert parse("a/b.py", "def f(:")["error"]
    made = parse("a/__init__.py", "if TYPE_CHECKING:\n    from .x import Y\nif True:\n    from .z import W\n")
    assert [i["source"] for i in made["imports"]] == ["a.x"]
    assert made["module"] == "a" and made["is_package"]


def test_read_sources(spark, tmp_path):
    for p, t in {"m/a.py": "x = 1\n", "m/.git/h.py": "y = 1\n", "venv/k.py": "", "b.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    files = source_files.fingerprinted(source_files.read_sources(spark, str(tmp_path)))
    assert [r.path for r in files.collect()] == ["m/a.py"]
    assert rows(source_files.directory_fingerprints(files), "path") == [("",), ("m",)]
    (tmp_path / "m/c.py").write_text("z = 2\n")
    again = source_files.fingerprinted(source_files.read_sources(spark, str(tmp_path)))
    assert rows(source_files.changes(files.limit(0), again), "path", "change") == [("m/a.py", "added"), ("m/c.py", "added")]


def test_package_beats_file(spark):
    files = spark.createDataFrame([("k/m.py", "class A: pass"), ("k/m/__init__.py", "class B: pass")], "path string, text string")
    assert rows(read_modules(files), "path") == [("k/m/__init__.py",)]


def test_incremental_equals_full(spark, tmp_path):
    index = incremental.Index(spark, str(tmp_path / "index"))
    project = dict(meta_queries.PROJECT)
    stream = tmp_path / "changes"
    schema = incremental.CHANGE

    def send(changes, version):
        spark.createDataFrame([(p, t, t is None, version) for p, t in changes.items()], schema).coalesce(1).write.mode("append").json(str(stream))
        q = incremental.follow(spark.readStream.schema(schema).json(str(stream)), index, str(tmp_path / "state"))
        q.awaitTermination()

    send(project, 1)
    edits = {"store/models.py": project["store/models.py"].replace("size", "width"), "store/loop_a.py": None, "farm/base.py": "class broken(:"}
    send(edits, 2)
    project["store/models.py"] = edits["store/models.py"]
    del project["store/loop_a.py"]
    full = read_modules(spark.createDataFrame(list(project.items()), "path string, text string"))
    columns = ["path", "module", "symbols", "fields", "error"]
    assert rows(index.modules(), *columns) == rows(full, *columns)
    index.apply(spark.createDataFrame([("x.py", "a = 1", False, 9)], schema), 0)  # a batch from before is passed over
    assert index.modules().where("path = 'x.py'").isEmpty()
    was, now = incremental.model_part(index.modules()), incremental.model_part(full)
    assert source_files.changes(was, now).isEmpty()


def test_affected(spark):
    bases = spark.createDataFrame([("b", "a"), ("c", "b")], "model string, base string")
    edges = spark.createDataFrame([("x", "c"), ("c", "y"), ("p", "q")], "source string, target string")
    got = incremental.affected(spark.createDataFrame([("a",)], "label string"), bases, edges)
    assert sorted(r[0] for r in got.collect()) == ["a", "b", "c", "x", "y"]


def test_empty_project(spark):
    made = metadata.build(read_modules(spark.createDataFrame([], "path string, text string")))
    assert made.fields.isEmpty() and made.models.isEmpty()
    assert search.validated(spark.createDataFrame([], "id int, model string, method string, path string"), made.fields).isEmpty()


def test_long_fixpoints(spark):
    links = spark.range(60).selectExpr("concat('n', id) source", "concat('n', id + 1) target", "'forward' direction")
    assert metadata.reachable(links, "n0").count() == 61
    loop = links.unionByName(spark.createDataFrame([("n60", "n0", "forward")], links.schema))
    assert metadata.reachable(loop, "n30").count() == 61


def test_roots_with_equal_paths(spark, tmp_path):
    for root in ("x", "y"):
        (tmp_path / root / "a").mkdir(parents=True)
        (tmp_path / root / "a/models.py").write_text(f"# {root}")
    both = [str(tmp_path / "x"), str(tmp_path / "y")]
    assert rows(source_files.read_sources(spark, *both), "root", "path") == [(r, "a/models.py") for r in both]
    assert rows(source_files.read_sources(spark, both[1], str(tmp_path)), "root", "path") == sorted([(both[1], "a/models.py"), (str(tmp_path), "x/a/models.py")])


def test_index_goes_on_after_restart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "WHOLE_EVERY", 2)
    folder = str(tmp_path / "index")
    change = lambda n, text="x = 1": spark.createDataFrame([(f"m{n}.py", text, text is None, n)], incremental.CHANGE)
    for n in range(4):
        incremental.Index(spark, folder).apply(change(n), n)  # a new one for every batch
    index = incremental.Index(spark, folder)
    assert index.batch == 3 and rows(index.modules(), "path") == [(f"m{n}.py",) for n in range(4)]
    index.apply(change(0), 3)  # applied before
    index.apply(change(1, None), 4)
    assert rows(incremental.Index(spark, folder).modules(), "path") == [("m0.py",), ("m2.py",), ("m3.py",)]


def test_updated_equals_rebuilt(spark, tmp_path):
    project = dict(meta_queries.PROJECT)
    index = incremental.Index(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([(p, t, False, 1) for p, t in project.items()], incremental.CHANGE), 0)
    old, before = index.build(), metadata.stored(index.modules())
    index.apply(spark.createDataFrame([("farm/base.py", project["farm/base.py"].replace("rank =", "level ="), False, 2)], incremental.CHANGE), 1)
    got, want = index.updated(old, before), index.build()
    columns = ["model", "name", "kind", "target", "provenance"]
    assert rows(got.fields, *columns) == rows(want.fields, *columns)
    assert rows(got.models, "label", "module") == rows(want.models, "label", "module")


def test_usages_become_diagnostics(spark):
    from quillpath.plans import search

    used = meta_queries._used(spark).where("context = 'lookup' and model is not null").select("id", "model", "method", meta_queries.F.col("value").alias("path"))
    bad = search.validated(used, meta_queries.project(spark).fields)
    assert {r.path for r in bad.where("reason <> ''").collect()} == {"weigth", "on__rank__gt", "foals__weight__lt"}


def test_latency_of_many_values(spark):
    import random

    from quillpath.plans import telemetry

    r = random.Random(4)
    data = [("a", r.random()) for _ in range(500)] + [("b", float(r.randint(0, 5))) for _ in range(77)] + [("c", None), (None, 2.0)]
    got = {x.g: x for x in telemetry.latency(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in data if k == g and x is not None)
        assert got[g]["count"] == len(v) and got[g].p50 == v[int(len(v) * 0.5)] and got[g].p95 == v[int(len(v) * 0.95)] and got[g].low == v[0] and got[g].high == v[-1]
    assert "c" not in got
