import pytest
from pyspark.sql import functions as F

from edgeweave.operators import changes, resolve
from edgeweave.plans import verbs
from edgeweave.sources import extract, store

FILES = {
    "app/util.py": "def core_fn(x):\n    return x\n\n\nclass Box:\n    size: int\n\n    def grow(self):\n        return self.shrink()\n\n    def shrink(self):\n        return core_fn(1)\n",
    "app/main.py": "from app.util import core_fn, Box\n\n\ndef entry():\n    b = Box()\n    b.grow()\n    return core_fn(2) + missing(3)\n\n\ndef shadow(core_fn):\n    return core_fn(1)\n",
    "tests/test_main.py": "from app.main import entry\n\n\ndef test_entry():\n    entry()\n",
    "docs/guide.md": "# Guide\nSee [main](../app/main.py).\n",
    "empty.py": "",
    ".hidden/x.py": "x = 1\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    path = f"{tmp_path_factory.mktemp('db')}/graph"
    return root, path, verbs.build(spark, str(root), path)


def test_build_resolves_with_evidence_or_nothing(spark, built):
    g = verbs.Graph.open(spark, built[1])
    short = lambda i: i.split("#")[-1].split("@")[0]
    got = {(short(r["src"]), r["relation"], short(r["dst"]), r["evidence"]) for r in g.edges.filter("relation != 'contains'").collect()}
    assert ("entry", "calls", "core_fn", "import") in got and ("Box::grow", "calls", "Box::shrink", "scope") in got
    assert ("Box::shrink", "calls", "core_fn", "scope") in got and ("test_entry", "calls", "entry", "import") in got
    assert not any(s == "shadow" for s, *_ in got)
    lost = {(r["name"], r["reason"]) for r in g.unresolved.collect()}
    assert ("missing", "syntax_only") in lost and ("core_fn", "syntax_only") in lost
    assert store.check_graph(g.nodes, g.edges).count() == 0


def test_verbs(spark, built):
    g = verbs.Graph.open(spark, built[1])
    assert {r["name"] for r in g.affected("core_fn").tables["rows"].collect()} >= {"entry", "test_entry", "shrink", "grow"}
    assert g.path("test_entry", "core_fn").status == "complete" and g.path("core_fn", "test_entry").exit == 1
    assert g.ask("where is the entry").tables["hits"].first()["name"] == "entry"
    assert g.map().tables["modules"].count() > 0 and g.show("entry").tables["card"].count() > 0
    assert g.deps("entry").tables["unresolved"].filter("name = 'missing'").count() == 1
    hunks = spark.createDataFrame([("app/util.py", 0, 5, False)], "file string, start long, end long, whole boolean")
    assert {r["name"] for r in g.impact(hunks).tables["tests"].collect()} >= {"test_entry"}
    assert g.unresolved_list().tables["by_category"].count() > 0


def test_rebuild_is_incremental(spark, built):
    root, path, _ = built
    before = store.Store(spark, path).current()
    assert verbs.build(spark, str(root), path).tables["diff"].filter("change != 'same'").isEmpty()
    assert store.Store(spark, path).current() == before
    (root / "app/util.py").write_text(FILES["app/util.py"].replace("core_fn", "kernel"))
    diff = verbs.build(spark, str(root), path).tables["diff"].filter("change != 'same'").collect()
    assert [(r["file"], r["change"]) for r in diff] == [("app/util.py", "changed")]
    g = verbs.Graph.open(spark, path)
    assert g.nodes.filter("name = 'core_fn'").isEmpty() and g.nodes.filter("name = 'kernel'").count() == 1
    assert g.edges.filter(F.col("dst").contains("core_fn")).isEmpty()


def test_tokens_do_not_depend_on_order(spark):
    a = spark.createDataFrame([("f", "1"), ("g", "2")], "file string, hash string")
    b = spark.createDataFrame([("g", "2"), ("f", "1")], "file string, hash string").repartition(3)
    token = changes.ensure_snapshot(None, {"files": a})
    assert changes.ensure_snapshot(token, {"files": b}) == token
    with pytest.raises(changes.StaleSnapshot):
        changes.ensure_snapshot("x", {"files": a})


def test_freshness():
    f, runs = changes.Freshness(), []
    assert f.sync(lambda: runs.append(1)) and not f.sync(lambda: runs.append(1))
    f.mark()
    with pytest.raises(ZeroDivisionError):
        f.sync(lambda: 1 / 0)
    assert f.dirty and runs == [1]


@pytest.mark.parametrize(("language", "text", "want"), [
    ("rust", "struct S {}\nfn a() { b(); x::c() }", {("struct", "S"), ("function", "a")}),
    ("go", "package p\ntype I interface { M() }\nfunc (s S) M() { f() }", {("interface", "I"), ("method", "M")}),
    ("typescript", "export class A extends B {}\nfunction f() {}\nconst X = 1;", {("class", "A"), ("function", "f"), ("constant", "X")}),
    ("java", "class A {\n  public int f(int x) { return g(x); }\n}", {("class", "A"), ("method", "f")}),
    ("cpp", "class A { int x; };\nint main(int c) {\n return f(c);\n}", {("class", "A"), ("function", "main")}),
    ("bash", "greet() {\n echo hi\n}\ngreet\n", {("function", "greet")}),
    ("proto", "message M { int32 a = 1; }\nservice S { rpc Get (M) returns (M); }", {("struct", "M"), ("interface", "S"), ("method", "Get")}),
    ("sql", "CREATE TABLE t (a int);\nCREATE VIEW v AS SELECT a FROM t;", {("struct", "t"), ("typealias", "v")}),
    ("markdown", "# A\n## B\n[x](c.md)\n", {("section", "A"), ("section", "B")}),
])
def test_languages(language, text, want):
    nodes, *_ = extract.facts("f", language, text)
    assert {(n[1], n[2]) for n in nodes[1:]} == want


def test_broken_python_is_reported():
    assert extract.facts("f.py", "python", "def (")[-1]


def test_scip_index_is_read(spark, tmp_path):
    def msg(n, body):
        return bytes([n << 3 | 2, len(body)]) + body

    occ = msg(1, bytes([3, 4, 9])) + msg(2, b"scheme pip pkg 1.0 m/f().") + bytes([3 << 3, 1])
    (tmp_path / "index.scip").write_bytes(msg(2, msg(1, b"a.py") + msg(2, occ)))
    rows = store.scip_occurrences(spark, str(tmp_path / "index.scip"))
    assert tuple(rows.first()) == ("a.py", "scheme pip pkg 1.0 m/f().", 3, 4, True)
    node = rows.select(resolve.dependency_node(F.col("moniker")).alias("n")).first()["n"]
    assert (node["id"], node["kind"], node["name"]) == ("dep:pkg@1.0#m::f@0", "method", "f")
    assert store.scip_rebase(rows, "sub").first()["file"] == "sub/a.py"


def test_document_links(spark):
    refs = spark.createDataFrame([(1, "docs/a.md", "../b.md"), (2, "docs/a.md", "c#two-words"), (3, "docs/a.md", "#here"), (4, "docs/a.md", "gone.md")], "ref_id long, file string, link string")
    files = spark.createDataFrame([("b.md",), ("docs/c.md",), ("docs/a.md",)], "file string")
    sections = spark.createDataFrame([("docs/c.md", "c2", "## Two words"), ("docs/a.md", "h1", "Here"), ("docs/a.md", "h2", "Here")], "file string, id string, name string")
    got = {r["ref_id"]: r["target"] for r in resolve.file_references(refs, files, sections).collect()}
    assert got == {1: "b.md", 2: "c2", 3: None}


def test_reexports_are_followed(spark):
    defs = spark.createDataFrame([(["core", "deep"], "thing", "T")], "module array<string>, name string, id string")
    via = spark.createDataFrame([(["api"], "thing", ["mid", "thing"]), (["mid"], None, ["core", "deep"])], "module array<string>, binding string, path array<string>")
    paths = spark.createDataFrame([(1, ["pkg", "api", "thing"]), (2, ["api", "other"])], "ref_id long, path array<string>")
    assert [(r["ref_id"], r["target"]) for r in resolve.resolve_paths(paths, defs, via).filter("target is not null").collect()] == [(1, "T")]


def test_written_types(spark):
    got = lambda t: spark.range(1).select(resolve.written_types(F.lit(t)).alias("x")).first()["x"]
    assert got("Arc<Box<dyn Store>>") == ["Store"] and got("Option<Store>") == ["Option"] and got("&'a mut Foo") == ["Foo"]


def test_manifests_and_workspace(spark):
    files = spark.createDataFrame([("a/Cargo.toml", bytearray(b'[package]\nname = "my-crate"\n')), ("go.mod", bytearray(b"module example.org/x\n"))], "file string, content binary")
    assert {tuple(r) for r in store.manifest_roots(files).collect()} == {("my_crate", "a", "rust"), ("example.org/x", "", "go")}
    members, links = store.load_workspace(spark, '[members]\none = "./one"\n[[links]]\nfrom = "one:a"\nto = "two:b"\n')
    assert tuple(members.first()) == ("one", "./one") and links.first()["relation"] == "uses"
    assert store.envelope("complete", {"coverage": 1}) == '{"coverage":1,"status":"partial"}'
