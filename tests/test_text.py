import pytest
from pyspark.sql import functions as F

from edgeweave.functions import question, scopes, text
from edgeweave.operators import rank, search
from edgeweave.schema import KINDS


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "scope"), [
    ("src/lib.rs", "production"), ("src/contest.rs", "production"), ("tests/a.rs", "test"), ("pkg/a_test.go", "test"), ("vendor/x/y.go", "vendor"), ("dep:serde@1", "vendor"),
    ("a/fixtures/b.py", "fixture"), ("Examples/a.py", "example"), ("api/x.pb.go", "generated"), ("docs/a.txt", "docs"), ("README.md", "docs"), ("a\\Third_Party\\b.c", "vendor"),
])
def test_scopes(spark, path, scope):
    assert one(spark, scopes.scope_of(F.lit(path))) == scope


def test_scope_rules_and_selection(spark):
    rules = [("*.gen.py", "generated"), ("src/keep.gen.py", "production")]
    assert one(spark, scopes.scope_with_rules(F.lit("src/keep.gen.py"), rules)) == "production"
    assert one(spark, scopes.scope_with_rules(F.lit("a/b.gen.py"), rules)) == "generated"
    assert scopes.parse_scopes(None) == {"production", "docs"} and len(scopes.parse_scopes("all")) == 7 and scopes.parse_scopes("tests,prod") == {"test", "production"}
    for bad in ("all,test", "nonsense", ""):
        with pytest.raises(ValueError):
            scopes.parse_scopes(bad)
    with pytest.raises(ValueError):
        scopes.glob_regex("!x")


def test_words(spark):
    assert one(spark, text.camel_words(F.lit("HTTPServer"))) == ["http", "server"]
    assert one(spark, text.camel_words(F.lit("aB2B"))) == ["a", "b2", "b"]
    assert one(spark, text.identifier_words(F.lit("PlayerV2B HTTPException"))) == ["player", "v2b", "http", "exception"]
    assert one(spark, text.trigrams(F.lit("AB"))) == ["ab"] and one(spark, text.trigrams(F.lit("Aaaa"))) == ["aaa"]
    assert one(spark, text.name_tail(F.lit("a::b/c.d"))) == "d"
    assert one(spark, text.line_of(F.lit("é\nx\ny"), F.lit(4))) == 2
    assert one(spark, text.slug(F.lit("Hello, World_1 & more"))) == "hello-world_1--more"
    assert set(one(spark, text.node_tokens(F.lit("getURL"), F.lit("fn a"), F.lit("src/x.rs"), F.lit(None).cast("string")))) == {"get", "url", "geturl", "fn", "src", "rs"}


def test_question():
    q = question.parse("How are command line arguments parsed by the code?")
    assert [t.surface for t in q.terms] == ["command", "line", "arguments", "parsed"] and q.phrases == ((0, 1), (1, 2), (2, 3)) and q.action
    assert {"argument", "arg", "args"} <= set(q.terms[2].variants) and "parse" in q.terms[3].core
    assert question.term("running").core == ("run", "running") and question.term("tried").core[:1] == ("tried",)[:1]
    assert [t.surface for t in question.parse("the code").terms] == ["code"]
    assert [x.label for x in question.topics("open file, read or open file; the")] == ["open file", "read"]


def test_confidence(spark):
    def of(first, second, matched, terms):
        return spark.range(1).select(*rank.assessment(F.lit(first).cast("long"), F.lit(second).cast("long"), F.lit(matched), terms)).first()

    high = of(400, 300, 2, 2)
    assert (high["level"], high["permille"], high["decision"]) == ("high", 250, "verify")
    assert of(500, None, 1, 1)["reason"] == "no_runner_up" and of(500, None, 1, 1)["abstain"]
    assert of(500, 300, 1, 4)["reason"] == "weak_term_coverage"
    low = of(1000, 980, 1, 1)
    assert (low["level"], low["abstain"]) == ("low", True)
    assert rank.budget(7, 3) == [3, 2, 2] and rank.is_weak(1, 4) and not rank.is_weak(2, 4)
    assert len(KINDS) == 17


def test_lookup(spark):
    rows = [(f"{f}#{q}@{s}", "method", q.split("::")[-1], f, s, s + 9, f"fn {q}", None) for f, q, s in (("a.rs", "Reader::peek", 0), ("b.rs", "peek", 10), ("b.rs", "Writer::flush", 30), ("c.rs", "Log::flush", 5))]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, file string, start long, end long, signature string, doc string")
    ids = lambda t: sorted(r["id"] for r in search.find_symbol(nodes, t).collect())
    assert ids("peek") == ["b.rs#peek@10"]  # a whole name shadows endings
    assert ids("flush@b.rs") == ["b.rs#Writer::flush@30"] and ids("Reader::peek") == ["a.rs#Reader::peek@0"]
    assert ids("symbol:method:4:a.rs#Reader::peek") == ["a.rs#Reader::peek@0"]
    assert search.find_symbol(nodes, "a.rs#Reader::peek@99").first()["resolution"] == "relocated"
    assert search.find_symbol(nodes, "flusch").first()["resolution"] == "suggestions"
    for name, why in (("flush", "ambiguous"), ("zzz", "no_match"), ("a.rs#Reader::peek@99", "relocated")):
        with pytest.raises(search.SymbolError, match=why):
            search.unique_symbol(nodes, name)
