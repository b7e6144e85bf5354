"""Declarations, descriptions, objects, corpus indexing and crawling."""

import json

import pytest
from pyspark.sql import functions as F

from quadrille.functions import text as X
from quadrille.operators import corpus, crawl, graph
from quadrille.operators.vkg import VirtualGraph
from quadrille.sources import bindings, files
from quadrille.sources.mapping import keyed, parse_mappings
from quadrille.sources.objects import ObjectStore

DDL = """
-- two tables
CREATE TABLE IF NOT EXISTS s.county (
    geo_id VARCHAR(30) PRIMARY KEY, pop FLOAT, jobs INT, amount NUMERIC(15,2) NOT NULL,
    CONSTRAINT positive CHECK (pop > 0)
);
create table plain (day TIMESTAMP WITH TIME ZONE, ok BOOLEAN, PRIMARY KEY (day));
"""
DESCRIBED = {
    "project": "open-data",
    "tables": [
        {"id": "county", "dataset": "census", "table": "county_1yr", "description": " Estimates by county. ", "keyColumns": [{"name": "geo_id", "type": "STRING", "description": "place"}], "queryExamples": [{"sql": "SELECT 1\n"}, {"sql": "SELECT 2"}]},
        {"id": "bare", "dataset": "x", "table": "y", "description": "nothing more"},
    ],
}


def test_declared_tables_without_rows(spark):
    views = bindings.empty_views(spark, DDL)
    assert {n: [t for _, t in df.dtypes] for n, df in views.items()} == {"county": ["string", "double", "int", "decimal(15,2)"], "plain": ["timestamp", "boolean"]}
    assert spark.sql("SELECT sum(amount) AS s FROM county WHERE geo_id LIKE 'a%'").first().s is None
    with pytest.raises(ValueError, match="no type"):
        bindings.declared("CREATE TABLE t (a GEOMETRY);")


def test_keys_of_declarations_make_mappings_unique():
    assert bindings.declared_keys(DDL) == {"county": ("geo_id",), "plain": ("day",)}
    text = "[PrefixDeclaration]\n: http://t/\nex: http://t/o#\n\n[MappingDeclaration] @collection [[\n" + "\n".join(
        f"\nmappingId {n}\ntarget :{n}/{{id}} ex:p {{v}} .\nsource {q}\n"
        for n, q in {
            "a": "SELECT geo_id AS id, pop AS v FROM s.county", "b": "SELECT pop AS id, geo_id AS v FROM county", "c": "SELECT c.geo_id AS id, p.ok AS v FROM county c JOIN plain p ON p.day = c.day",
            "d": "SELECT day AS id, ok AS v FROM other_name WHERE ok", "e": "SELECT max(geo_id) AS id, pop AS v FROM county GROUP BY pop", "f": "SELECT geo_id AS id, ok AS v FROM county, plain",
        }.items()
    ) + "\n]]\n"
    found = keyed(parse_mappings(text)[1], bindings.declared_keys(DDL), {"other_name": "s.plain"})
    assert [m.id for m in found if m.unique] == ["a", "d"]


def test_tables_of_a_database(spark):
    """The database that comes with Spark."""
    jvm, url = spark.sparkContext._jvm, "jdbc:derby:memory:things;create=true"
    jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    con = jvm.java.sql.DriverManager.getConnection(url)
    run = con.createStatement().execute
    run("CREATE TABLE thing (id INT PRIMARY KEY, name VARCHAR(20))")
    for i in range(20):
        run(f"INSERT INTO thing VALUES ({i}, 'n{i}')")
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    views = bindings.jdbc_views(spark, url, {"thing_v": "THING", "thing_p": "THING"}, {"thing_p": ("ID", 0, 20, 4)}, **driver)
    assert views["thing_p"].rdd.getNumPartitions() == 4 and spark.sql("SELECT count(*) AS n FROM thing_p WHERE id >= 5").first().n == 15
    plan = spark.sql("SELECT name FROM thing_v WHERE id = 7")
    assert plan.first().name == "n7" and "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,7)]" in plan._jdf.queryExecution().executedPlan().toString()
    prefixes, mappings = parse_mappings("[PrefixDeclaration]\n: http://t/\nex: http://t/o#\n\n[MappingDeclaration] @collection [[\n\nmappingId T\ntarget :T/{id} ex:name {name} .\nsource SELECT id, name FROM thing_v\n\n]]\n")
    got = VirtualGraph(spark, prefixes, keyed(mappings, {"thing_v": ("id",)})).query("SELECT ?n { <http://t/T/3> ex:name ?n }")
    assert [r.n for r in got.collect()] == ["n3"]
    con.close()


def test_table_context(tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(DESCRIBED))
    text = bindings.table_context(bindings.load_bindings(f"{tmp_path}/t.json"))
    assert "## county: Estimates by county.\nTable: `open-data.census.county_1yr`\nColumns:\n  - geo_id (STRING): place\nExample query:\n```sql\nSELECT 1\n```" in text
    assert "SELECT 2" not in text and text.count("Example") == 1 and bindings.table_context(None) == ""
    pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text("project: p\ntables:\n  - id: a\n    dataset: d\n    table: t\n    description: >\n      two\n      lines\n")
    assert "## a: two lines" in bindings.table_context(bindings.load_bindings(f"{tmp_path}/t.yaml"))


def test_map_context(spark):
    rows = [("m2", "Second", None, None, None, None, None), ("m1", "First", " about ", "src", "k", "how many", "SELECT * FROM {schema}.t"), ("m1", "First", " about ", "src", "k", "how many", "SELECT 2 FROM {schema}.t"), ("m1", "First", " about ", "src", "k", "all", "SELECT\n1")]
    df = spark.createDataFrame(rows, "map string, label string, description string, source string, join_key string, ex_label string, ex_sql string")
    text = bindings.map_context(df, "schema: s", {"schema": "s"})
    assert text == "Available tables (schema: s):\n\n## First\nabout\nJoin key: k\nExample queries:\n  # all\n  ```sql\n  SELECT\n  1\n  ```\n  # how many\n  ```sql\n  SELECT * FROM s.t\n  ```\n\n## Second\n"
    assert bindings.map_context(df.where("false"), "x") == ""


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "o"))
    a = store.put(store.key("docs", "d", "one", b"text", "A.TXT"), b"text")
    b = store.put(store.key("docs", "d", "one", b"%PDF", "x/b.pdf"), b"%PDF")
    assert a.endswith(".txt") and store.put(a, b"other") == a and store.get(a) == b"text" and store.stat(b) == {"size": 4, "type": "application/pdf"}
    assert store.list("docs") == sorted([a, b]) and store.resolve("docs/d/one") == (b, "application/pdf") and store.list("none") == []
    assert store.delete(b) == 1 and store.resolve("docs/d/one")[0] == a and store.delete("docs") == 1 and store.delete("docs/d") == 0
    for bad in (lambda: store.stat(b), lambda: store.resolve("docs/d/one"), lambda: store.get("x")):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        store.put("../x", b"")
    store.save_snapshot("p", "d", "http://t/doc", {"chunks": [1]})
    store.save_snapshot("p", "d", "http://t/doc", {"chunks": [1, 2]})
    assert store.load_snapshot("p", "d", "http://t/doc") == {"iri": "http://t/doc", "chunks": [1, 2]} and store.load_snapshot("p", "d", "other") is None


def test_csv_keeps_the_first_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("K,V\n" + "".join(f"{i % 50},v{i}\n" for i in range(1000)))
    got = files.load_csv(spark, f"{tmp_path}/a.csv", "K int, V string", {"k": "K", "v": "V"}, ["k"])
    assert {(r.k, r.v) for r in got.collect()} == {(i, f"v{i}") for i in range(50)}
    again = files.load_csv(spark, f"{tmp_path}/a.csv", "K int, V string", {"k": "K", "v": "V"}, ["k"], spark.createDataFrame([(3, "old")], "k int, v string"))
    assert again.count() == 50 and again.where("k = 3").first().v == "old"


def test_text_by_type_and_report(spark, tmp_path):
    rows = [("/a.txt", bytearray(b"  plain \n")), ("/b.pdf", bytearray(b"%PDF x")), ("/c.bin", bytearray(b"z"))]
    got = files.text_of(spark.createDataFrame(rows, "path string, content binary"), lambda b: b.decode().upper()).collect()
    assert [r.text for r in got] == ["plain", "%PDF X", None]
    files.write_report(spark.createDataFrame([("a,b", 'say "x"\nno')], "x string, y string"), f"{tmp_path}/r")
    assert tuple(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/r").first()) == ("a,b", 'say "x"\nno')
    for name in ("d1/a.pdf", "d1/b.txt", "d2/sub/c.pdf"):
        (tmp_path / "f" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / name).write_bytes(b"x")
    found = files.discover(spark, str(tmp_path / "f"))
    assert [(r.path.rsplit("/", 1)[1], r.dataset) for r in found.collect()] == [("a.pdf", "d1"), ("c.pdf", "d2")]
    assert [r.dataset for r in files.discover(spark, str(tmp_path / "f"), offset=1, limit=1).collect()] == ["d2"]


def _encoder(log):
    def encode(texts):
        with open(log, "a") as f:
            f.write("x")
        with open(log) as f:
            calls = len(f.read())
        if calls == 1:
            raise corpus.Busy("later")
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), float("nan") if "nan" in t else 1.0] for t in texts]

    return encode


def test_corpus_is_indexed_in_one_job(spark, tmp_path):
    docs = [("a", "x" * 250), ("b", "bad"), ("c", "nan"), ("d", "fine"), ("d", "fine"), ("old", "seen"), ("e", "")]
    known = spark.createDataFrame([("old",)], "key string")
    df = spark.createDataFrame(docs, "key string, text string").coalesce(1)
    made, failed = corpus.index(df, known, _encoder(tmp_path / "log"), batch=1, size=2, wait=0.01)
    assert sorted((r.key, r.chunk_no, r.vector) for r in made.collect()) == [("a", 0, [250.0, 1.0]), ("d", 0, [4.0, 1.0])]
    assert {r.key: r.error for r in failed.collect()} == {"b": "RuntimeError: refused", "c": "a number is not finite"}
    with pytest.raises(RuntimeError, match="b: "):
        corpus.index(df, known, _encoder(tmp_path / "log"), strict=True, batch=1, size=2, wait=0.01)
    tired = corpus.embed(X.chunks(df.where("key = 'd'")), lambda t: (_ for _ in ()).throw(corpus.Busy("no")), tries=2, wait=0.01)
    assert {r.error for r in tired.collect()} == {"busy: no"}
    old = spark.createDataFrame([("a", 0, "stale"), ("z", 0, "kept")], "key string, chunk_no int, chunk string")
    d, c = corpus.upsert(spark.createDataFrame([("a", "t"), ("z", "t")], "key string, text string"), old, df.where("key = 'a'"), made)
    assert sorted(r.key for r in d.collect()) == ["a", "z"] and sorted((r.key, len(r.chunk)) for r in c.collect()) == [("a", 250), ("d", 4), ("z", 4)]


def test_extraction_asks_once_more(spark):
    def extractor(text, reason):
        good = {"entities": [{"label": "A"}, {"label": "B"}], "relationships": [{"subjectId": 0, "objectId": 1}]}
        if text == "good" or text == "mended" and reason:
            return good
        if text == "never":
            raise RuntimeError("down")
        if text == "nonsense":
            return ["x"]
        return {"entities": [{"label": "A"}], "relationships": [{"subjectId": 0, "objectId": 7}, {"subjectId": 0, "objectIsLiteral": True}]}

    texts = spark.createDataFrame([(t,) for t in ("good", "mended", "wrong", "never", "nonsense")], "chunk string")
    got = {r.chunk: r for r in corpus.extract(texts, extractor, "entities array<struct<label:string>>, relationships array<struct<subjectId:int,objectId:int,objectIsLiteral:boolean>>").collect()}
    assert len(got["good"].payload.entities) == len(got["mended"].payload.entities) == 2 and got["mended"].error is None
    assert [r.objectIsLiteral for r in got["wrong"].payload.relationships] == [True]
    assert got["never"].payload is None and got["never"].error == "RuntimeError: down" and got["nonsense"].payload is None


def test_crawl_goes_on_from_its_state(spark):
    page = lambda *hrefs: " ".join(f'<a href="{h}">x</a>' for h in hrefs)
    pages = [("http://h/a", page("/p/b", "/2001/old", "http://other/x")), ("http://H/p/b#top", page("/p/c.pdf?x=1", "/a")), ("http://h/p/c", page("/p/d")), (None, page("/lost")), ("http://h/2020/n", None)]
    table, seeds = spark.createDataFrame(pages, "url string, html string"), spark.createDataFrame([("http://h/a",), (None,)], "url string")
    got = lambda df: {(r.url, r.depth, r.is_pdf) for r in df.collect()}
    one = crawl.frontier(table, seeds, crawl.Bounds(depth=1, min_year=2010))
    assert got(one) == {("http://h/a", 0, False), ("http://h/p/b", 1, False)}
    two = crawl.frontier(table, seeds, crawl.Bounds(depth=2, min_year=2010), one.drop("is_pdf"))
    assert got(two) == got(crawl.frontier(table, seeds, crawl.Bounds(depth=2, min_year=2010))) == {("http://h/a", 0, False), ("http://h/p/b", 1, False), ("http://h/p/c.pdf?x=1", 2, True)}
    assert ("http://other/x", 1, False) in got(crawl.frontier(table, seeds, crawl.Bounds(depth=1, same_host=False)))
    assert got(crawl.frontier(table, seeds, crawl.Bounds(depth=1, prefix="/2"))) == {("http://h/a", 0, False), ("http://h/2001/old", 1, False)}


def test_values_and_methods(spark):
    cases = {"1.500": "1.5", "2.0": "2", "100": "100", "1e3": "1000", "-0.10": "-0.1", "2020-01-02 03:04:05.678": "2020-01-02T03:04:05", "abc": "abc", None: "<NULL>"}
    got = spark.createDataFrame([(k,) for k in cases], "v string").select(X.canonical_value(F.col("v")).alias("c")).collect()
    assert [r.c for r in got] == list(cases.values())
    items, methods = spark.createDataFrame([(1,), (2,), (3,), (3,)], "k int"), spark.createDataFrame([(1, "exact"), (2, "exact|judge "), (2, "judge"), (9, "other")], "k int, method string")
    assert {(r.method, r.n) for r in graph.method_counts(items, methods, ["k"]).collect()} == {("exact", 2), ("judge", 1), ("unknown", 1)}
