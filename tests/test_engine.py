"""The engine on hand-made graphs and tables."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quadrille.api import RDFS, Service, to_sparql_json, within
from quadrille.catalog import Manifest
from quadrille.functions import text as X
from quadrille.operators import entities, goals, graph, ingest, rules, search
from quadrille.operators.quads import QuadStore
from quadrille.operators.vkg import VirtualGraph
from quadrille.plans.compile import encode
from quadrille.plans.components import connected_components, merged, parted
from quadrille.plans.sparql import XSD, Iri, SparqlError, Triple, Var, parse
from quadrille.sources import files
from quadrille.sources.mapping import from_r2rml, parse_mappings
from quadrille.sources.objects import ObjectStore
from quadrille.sources.turtle import encoded, read_turtle, to_turtle

NS = "http://t/o#"
ONTOLOGY = """@prefix ex: <http://t/o#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex:City a owl:Class ; rdfs:label "City"@en ; rdfs:subClassOf ex:Place .
ex:Place a owl:Class . # a comment
ex:near a owl:ObjectProperty ; rdfs:domain ex:Place ; rdfs:range ex:Place , ex:City .
"""
RULES = """@prefix ex: <http://t/o#> .
ex:r1 a ex:ForwardRule ; ex:ruleOrder 10 ; ex:ruleBody "[sym: (?a owl:sameAs ?b) -> (?b owl:sameAs ?a)]" .
ex:r2 a ex:ForwardRule ; ex:ruleOrder 99 ; ex:ruleBody "[late: (?a owl:sameAs ?b) -> (?a ex:late ?b)]" .
ex:r3 a ex:ForwardRule ; ex:ruleBody "[broken" .
"""


@pytest.fixture()
def service(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(ONTOLOGY)
    (tmp_path / "r.ttl").write_text(RULES)
    (tmp_path / "m.json").write_text(json.dumps({"base": "${NO_SUCH_NAME:http://t}/", "namespace": NS, "datasets": [{"id": "d", "ontology": ["o.ttl"], "forward": ["r.ttl"]}]}))
    s = Service(spark, Manifest.load(str(tmp_path / "m.json")), str(tmp_path))
    s.reload("d")
    s.reload("d")
    return s


def payload(spark, document, run, entities_, links):
    return spark.createDataFrame([(document, run, "2020-01-01T00:00:00", "test", "2020-01-02T00:00:00", entities_, links)], f"document string, run string, extracted_at string, method string, now string, entities {ingest.ENTITIES}, relationships {ingest.LINKS}")


def test_load_and_ontology(service):
    tbox = service.manifest.graph("d", "tbox")
    assert {r.graph: r.n for r in service.metrics().collect()}[tbox] == 8
    assert service.tbox("d", "SELECT ?x { ?x rdfs:subClassOf ex:Place }").collect()[0].x == NS + "City"
    found = {r.term: r for r in service.ontology("d").collect()}
    assert found[NS + "near"].ranges == f"{NS}City {NS}Place" and found[NS + "City"].label == "City"
    assert service.query("SELECT ?x { ?x ?p ?o }").count() == 0  # no default graph
    assert [r.n for r in service.query("SELECT (COUNT(?e) AS ?n) { GRAPH ?g { ?e a ex:OntologyLoadEvent } }").collect()] == [2]


def test_ingest_provenance_delete_rollback(service, spark):
    one = [("Big \"Town\"\n", "City", "a place", [("size", "3")]), ("River", "Water Body!", None, None)]
    links = [(0, "near", 1, None, False, 0.9), (0, "crosses", None, "a bridge", True, 0.5), (0, "near", 9, None, False, 0.9), (7, "near", 1, None, False, 0.9)]
    assert service.assert_entities("d", payload(spark, "http://t/doc1", "run1", one, links)) == 2
    assert service.assert_entities("d", payload(spark, "http://t/doc2", "run2", one[:1] + one[1:], links[:1])) == 1
    town = service.find_entity("d", service.store.quads.where(F.col("s").contains("big-town")).first().s[-9:-1]).first().e
    page = service.entity("d", town)
    assert {(r.p.split("#")[-1], r.o) for r in page["outgoing"].collect()} >= {("size", "3"), ("slug", "big-town"), ("crosses", "a bridge"), ("type", NS + "City")}
    assert sorted((r.doc, r.n) for r in page["documents"].collect()) == [("http://t/doc1", 3), ("http://t/doc2", 2)]
    assert any(r.o == NS + "Water-Body" for r in service.query("SELECT ?o { GRAPH ?g { ?s a ?o } }").collect())
    service.rollback("run1")  # the shared statements stay
    assert service.query(f"SELECT ?o {{ GRAPH ?g {{ <{town}> ex:near ?o }} }}").count() == 1
    assert service.query(f"SELECT ?o {{ GRAPH ?g {{ <{town}> ex:crosses ?o }} }}").count() == 0
    service.retract_document("http://t/doc2")
    assert service.query(f"SELECT ?o {{ GRAPH ?g {{ <{town}> ex:near ?o }} }}").count() == 0
    assert service.query(f"SELECT ?o {{ GRAPH ?g {{ <{town}> rdfs:label ?o }} }}").count() == 1  # labels carry no provenance
    with pytest.raises(ZeroDivisionError):
        service.saga([lambda s: s.update("CLEAR GRAPH <http://t/graph/d/abox/asserted>"), lambda s: 1 / 0])
    assert service.query(f"SELECT ?o {{ GRAPH ?g {{ <{town}> rdfs:label ?o }} }}").count() == 1


def test_normalize_elect_materialize(service, spark):
    g = service.manifest.graph("d", "asserted")
    names = {"a": "Saint Mary River", "b": "saint-mary river", "c": "Saint Mary Rivers", "d": "Oak Hill", "e": "Oak Hilltop"}
    service.store = service.store.but(service.store.quads.union(spark.createDataFrame([(f"<{g}>", f"<http://t/{k}>", f"<{RDFS}label>", f'"{v}"') for k, v in names.items()] + [(f"<{g}>", "<http://t/a>", "<http://t/p>", '"x"')], "g string, s string, p string, o string")))
    new = spark.createDataFrame([("http://t/a", names["a"]), ("http://t/b", names["b"]), ("http://t/d", names["d"])], "iri string, label string")
    told = service.normalize("d", "run1", new, judge=lambda pairs: [(True, 0.9)] * len(pairs)).first()
    assert (told.total, told.exact, told.high, told.judge) == (3, 1, 3, 0)
    clusters = service.clusters("d").collect()
    assert [(r.size, r.status) for r in clusters] == [(3, "graph"), (2, "graph")] and service.normalization_page("d", 2, 1).count() == 1
    assert service.materialize("d") == service.store.quads.where(F.col("g").contains("inferred")).count() > 0
    assert {r.o for r in service.query(f"SELECT ?o {{ GRAPH <{service.manifest.graph('d', 'inferred')}> {{ <http://t/c> <http://t/p> ?o }} }}").collect()} == {"x"}
    assert service.reasoned("d", "SELECT ?b { <http://t/c> owl:sameAs ?b }").count() >= 1
    assert service.reasoned("d", "SELECT ?b { ?a ex:late ?b }").count() == 0
    service.forget_run("d", "run1")
    assert service.same_as("d").count() == 0 and service.clusters("d").count() == 0
    assert service.text("d", "oak hill").first().entity == "http://t/d"
    nodes, cut = service.neighbourhood("d", "http://t/a")
    assert nodes.count() == 1 and cut == [False]


def test_same_as_equals_naive_rules(spark):
    r = random.Random(2)
    for _ in range(3):
        base = {(f"n{r.randrange(6)}", "same", f"n{r.randrange(6)}") for _ in range(4)} | {(f"n{r.randrange(6)}", f"p{r.randrange(2)}", f"v{r.randrange(3)}") for _ in range(4)}
        want = set(base)
        while True:
            same = {(a, b) for a, p, b in want if p == "same"}
            new = {(b, "same", a) for a, b in same} | {(a, "same", d) for a, b in same for c, d in same if b == c} | {(b, p, o) for a, b in same for s, p, o in want if s == a}
            if new <= want:
                break
            want |= new
        df = spark.createDataFrame(sorted(base), "s string, p string, o string")
        edges = df.where("p = 'same'").select(F.col("s").alias("a"), F.col("o").alias("b"))
        got = graph.same_as(df, connected_components(edges).select("root", "node"), "same")
        assert {tuple(x) for x in got.collect()} == want - base


def test_rules_against_naive_closure(spark):
    r = random.Random(7)
    edges = {(f"<n{r.randrange(12)}>", "<http://t/o#p>", f"<n{r.randrange(12)}>") for _ in range(20)}
    df = spark.createDataFrame(sorted(edges), "s string, p string, o string")
    want = {(a, c) for a, _, c in edges}
    while True:
        new = {(a, d) for a, b in want for c, d in want if b == c} - want
        if not new:
            break
        want |= new
    found = rules.derive(df, rules.parse_rules("[t: (?a ex:p ?b), (?b ex:p ?c) -> (?a ex:p ?c)]", {"ex": NS}).rules)
    assert {(x.s, x.o) for x in found.collect()} == want - {(a, c) for a, _, c in edges}
    pairs = graph.reachable(df.select(F.col("s").alias("a"), F.col("o").alias("b")))
    assert {(x.a, x.b) for x in pairs.collect()} == want
    seed = graph.reachable(df.select(F.col("s").alias("a"), F.col("o").alias("b")), ["<n1>"])
    assert {x.b for x in seed.collect()} == {b for a, b in want if a == "<n1>"}


@pytest.mark.parametrize(
    ("text", "query", "good"),
    [
        ("[a: (?x ex:p ?y) -> (?y ex:q ?x)]", "SELECT * { ?s ?p ?o }", "FORWARD"),
        ("[a: (?x ex:p ?y) -> (?y ex:p ?x)]", "SELECT * { ?s ?p ?o }", None),
        ("[a: (?y ex:q ?x) <- (?x ex:p ?y)]", "SELECT * { ?s ?p ?o }", "BACKWARD"),
        ("[a: (?y ex:p ?x) <- (?x ex:p ?y)]", "SELECT * { ?s ex:p ?o }", None),
        ("-> table(ex:p). [a: (?y ex:p ?x) <- (?x ex:p ?y)]", "SELECT * { ?s ex:p ?o }", "BACKWARD"),
        ("-> tableAll(). [a: (?y ex:p ?x) <- (?x ex:p ?y)]", "SELECT * { ?s ?p ?o }", None),
        ("-> tableAll(). [a: (?y ex:p ?x) <- (?x ex:p ?y)]", "SELECT * { ?s ex:p+ ?o }", None),
        ("[a: (?y ex:q ?x), (?x ex:r ?y) <- (?x ex:p ?y)]", "SELECT * { ?s ex:p ?o }", None),
        ("[a: (?x ex:p ?y) -> (?y ex:q ?x)] [b: (?y ex:r ?x) <- (?x ex:p ?y)]", "SELECT * { ?s ex:p ?o }", None),
        ("[a: (?x ex:p ?y), (?y rdf:type ex:T), notEqual(?x, ?y) -> (?x rdf:type ex:U)]", "SELECT * { ?s ex:p ?o }", None),
    ],
)
def test_rule_acceptance(text, query, good):
    parsed = rules.parse_rules("@prefix ex: <http://t/o#> . # note\n" + text)
    if good:
        assert rules.check(parsed, parse(query, {"ex": NS})) == good
    else:
        with pytest.raises(rules.RuleError):
            rules.check(parsed, parse(query, {"ex": NS}))


def test_unreadable_rules_and_queries():
    for bad in ("[a: (?x ex:p ?y)", "[a: (?x un:known ?y) -> (?x ex:p ?y)]", "[a: (?x ex:p ?y), odd(?x) -> (?x ex:q ?y)]"):
        with pytest.raises(rules.RuleError):
            rules.parse_rules(bad, {"ex": NS})
    for bad in ("SELECT ?x { ?x ?y }", "SELECT ?x WHERE ?x", "SELECT ?x { ?x un:p ?y }"):
        with pytest.raises(SparqlError):
            parse(bad)


def test_playground_preset_shapes(spark):
    def store(*facts):
        return QuadStore.of(spark, [("<g>", f"<{NS}{s}>", f"<{'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' if p == 'a' else NS + p}>", f"<{NS}{o}>") for s, p, o in facts], prefixes={"ex": NS})

    work = store(("w", "by", "x"), ("w", "by", "y"), ("x", "a", "Person"), ("y", "a", "Person"))
    out = rules.playground(work, "g", "[c: (?a ex:with ?b) <- (?w ex:by ?a), (?w ex:by ?b), (?a rdf:type ex:Person), (?b rdf:type ex:Person), notEqual(?a, ?b)]", "SELECT ?a ?b { ?a ex:with ?b }")
    assert sorted(tuple(r) for r in out["added"].collect()) == [(NS + "x", NS + "y"), (NS + "y", NS + "x")] and out["base"].count() == 0
    chain = store(("a", "from", "b"), ("b", "from", "c"), ("c", "from", "a"), ("c", "a", "Org"))
    out = rules.playground(chain, "g", "-> table(ex:from). [d: (?a ex:from ?c) <- (?a ex:from ?b), (?b ex:from ?c), (?c rdf:type ex:Org), notEqual(?a, ?c)]", "SELECT ?a ?c { ?a ex:from ?c }")
    assert [tuple(r) for r in out["added"].collect()] == [(NS + "a", NS + "c")]
    typed = store(("o", "a", "Obs"), ("o", "change", "up"))
    out = rules.playground(typed, "g", "-> tableAll(). [t: (?x rdf:type ex:Trend) <- (?x rdf:type ex:Obs), (?x ex:change ?d)]", "SELECT ?x { ?x a ex:Trend }")
    assert out["inferred"].count() == 1


def test_terms_and_expressions(spark):
    s = QuadStore.of(spark, [("<g>", "<a>", "<http://t/o#v>", '"5"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("<g>", "<b>", "<http://t/o#v>", '"x"@en'), ("<g>", "_:n", "<http://t/o#v>", '"2019-12-31T12:00:00"^^<http://www.w3.org/2001/XMLSchema#dateTime>')], prefixes={"ex": NS})

    def q(body):
        return [tuple(r) for r in s.query(f"SELECT {body}").collect()]

    assert q("?x { GRAPH <g:> { ?x ex:v 5 } }".replace("<g:>", "?g")) == [("a",)]
    assert q("?x { GRAPH ?g { ?x ex:v ?v } FILTER(LANG(?v) = 'en') }") == [("b",)]
    assert q("?x { GRAPH ?g { ?x ex:v ?v } FILTER(isBlank(?x) && ?v > '2019-12-31') }") == [("_:n",)]
    assert q("?x { GRAPH ?g { ?x ex:v ?v } FILTER(?v <= '2019-12-31') }") == []
    assert q("?x { GRAPH ?g { ?x ex:v ?v } FILTER(?v * 2 = 10) }") == [("a",)]
    assert q("(SUM(?v) AS ?s) (AVG(?v) AS ?m) (COUNT(DISTINCT ?v) AS ?n) { GRAPH ?g { ?x ex:v ?v } }") == [(5.0, 5.0, 3)]
    assert q("(SUM(?v) AS ?s) { GRAPH ?g { ?x ex:none ?v } }") == [(0.0,)]
    assert q("?x ?w { GRAPH ?g { ?x ex:v 5 } OPTIONAL { GRAPH ?g { ?x ex:w ?w } } FILTER(!BOUND(?w)) }") == [("a", None)]
    assert q("(IF(?v = 5, 'five', 'other') AS ?t) { GRAPH ?g { <a:> ex:v ?v } }".replace("<a:>", "?x")) .count(("five",)) == 1
    assert to_sparql_json(s.terms("SELECT ?x (COUNT(*) AS ?n) { GRAPH ?g { ?x ex:v 5 } } GROUP BY ?x"))["results"]["bindings"][0]["n"]["value"] == "1"
    assert s.query("CONSTRUCT { ?x ex:w ?v } WHERE { GRAPH ?g { ?x ex:v ?v } }").count() == 3
    assert s.ask("ASK { GRAPH ?g { ?x ex:v 5 } }") and within(spark, 60, lambda: 3) == 3


def test_store_versions(spark, tmp_path):
    s = QuadStore.of(spark, [("<g>", "<a>", "<p>", "<b>")], [("<g>", "<a>", "<p>", "<b>", "<q>", '"1"')])
    first = s.save(str(tmp_path))
    s.update("CLEAR SILENT GRAPH <g:>".replace("<g:>", "<http://none>")).but(s.quads.where("false")).save(str(tmp_path))
    assert QuadStore.open(spark, str(tmp_path)).quads.count() == 0
    assert QuadStore.open(spark, str(tmp_path), first).quads.count() == 1


def test_turtle_and_r2rml(spark):
    text = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://t/o#> . @base <http://t/m/> .
    <#A> rr:logicalTable [ rr:sqlQuery "SELECT 1 AS id, 'x' AS name UNION ALL SELECT 2, NULL" ] ; rr:subjectMap [ rr:template "http://t/{schema}/A/{id}" ; rr:class ex:A ] ;
      rr:predicateObjectMap [ rr:predicate ex:name ; rr:objectMap [ rr:column "name" ] ] .
    <#B> rr:logicalTable [ rr:sqlQuery "SELECT 7 AS k, 1 AS a" ] ; rr:subjectMap [ rr:template "http://t/B/{k}" ] ;
      rr:predicateObjectMap [ rr:predicate ex:of ; rr:objectMap [ rr:parentTriplesMap <#A> ; rr:joinCondition [ rr:child "a" ; rr:parent "id" ] ] ] ."""
    g = VirtualGraph(spark, {"ex": NS}, from_r2rml(read_turtle(text), {"schema": "s"}))
    assert [tuple(r) for r in g.query("SELECT ?b ?n { ?b ex:of ?a . ?a ex:name ?n }").collect()] == [("http://t/B/7", "x")]
    assert g.query("SELECT ?a { ?a a ex:A }").count() == 2 and g.query("SELECT ?a { ?a ex:missing ?x }").count() == 0
    assert "Project" in g.translate("SELECT ?a { ?a a ex:A }")
    rows = encoded(read_turtle('<http://a> <http://p> "q\\"uote\\nline"@en , 5 , ( 1 2 ) .'), "http://g")
    assert len(rows) == 7
    out = [r.value for r in to_turtle(spark.createDataFrame(rows[:1] if '"q' in rows[0][3] else [r for r in rows if '"q' in r[3]], "g string, s string, p string, o string")).collect()]
    assert out == ['<http://a> <http://p> "q\\"uote\\nline"@en .']


def test_mapping_semantics(spark):
    spark.createDataFrame([(1, 10, "A"), (2, 10, "A"), (3, None, "B")], "policy int, agent int, role string").createOrReplaceTempView("roles_t")
    text = """[PrefixDeclaration]
: http://t/d/
ex: http://t/o#
[MappingDeclaration] @collection [[
mappingId Agent
target :Agent/{agent} a ex:Agent ; ex:agentId {agent}^^xsd:integer .
source SELECT agent FROM roles_t WHERE agent IS NOT NULL

mappingId Sold
target :Policy/{policy} ex:soldBy :Agent/{agent} ; ex:kind "policy" .
source SELECT policy, agent FROM roles_t
]]"""
    prefixes, mappings = parse_mappings(text)
    g = VirtualGraph(spark, prefixes, mappings)
    assert [tuple(r) for r in g.query("SELECT ?id (COUNT(?p) AS ?n) { ?p ex:soldBy [ ex:agentId ?id ] } GROUP BY ?id").collect()] == [(10, 2)]
    assert g.query("SELECT ?a { ?a a ex:Agent }").count() == 1 and g.query("SELECT ?p { ?p ex:kind 'policy' }").count() == 3
    assert g.query("SELECT ?p { ?p ex:soldBy <http://t/d/Agent/10> }").count() == 2
    assert g.query("SELECT ?x ?y { ?x ?y <http://t/d/Agent/10> }").count() == 2


def test_text_functions(spark):
    row = spark.createDataFrame([("Apple Inc. & Söhne!",)], "x string").select(X.slug(F.col("x")).alias("s"), X.label_key(F.col("x")).alias("k"), X.safe_name(F.lit(" a b/c ")).alias("n"), X.local_name(F.lit("http://a/b#c")).alias("l"), X.canonical_url(F.lit("HTTP://Ex.COM//a//b?q=1#f")).alias("u"), X.url_year(F.lit("http://a/x/2015/b")).alias("y"), X.vector_text(F.array(F.lit(1.0), F.lit(float("nan")))).alias("v")).first()
    assert tuple(row) == ("apple-inc-s-hne", "apple inc s hne", "a-b-c", "c", "http://ex.com/a/b?q=1", 2015, None)
    sizes = spark.createDataFrame([(n, "x" * n) for n in (0, 1, 15900, 15901, 16000, 31900)], "n int, text string")
    assert {r.n: r["count"] for r in X.chunks(sizes).groupBy("n").count().collect()} == {1: 1, 15900: 1, 15901: 2, 16000: 2, 31900: 3}
    pages = spark.createDataFrame([("http://h.org/a/b.html", """<a href="c.html">x</a> <a class='q' href='/d#top'>y</a> "https://o.org//e.pdf" <a href="#z">""")], "url string, html string")
    assert {r.link for r in X.links(pages).collect()} == {"http://h.org/a/c.html", "http://h.org/d", "https://o.org/e.pdf"}
    with pytest.raises(X.SqlRefused):
        X.guarded(spark, "WITH a AS (SELECT 1) SELECT * FROM a")
    assert X.guarded(spark, "select @x AS v, '@y' AS w", args={"x": 3}).collect() == [(3, "@y")]


@pytest.mark.parametrize("least", [entities.HIGH, entities.LOW])
def test_alike_finds_all_pairs(spark, least):
    rng = random.Random(5)
    labels = ["microsoft", "nicrosoft", "a", "ab", "ba", "", "...", "1 a", "a 1", "aaaa", "aaab", "baaa"]
    for _ in range(60):
        word = [rng.choice("abcde ") for _ in range(rng.randint(1, 14))]
        labels.append("".join(word))
        for _ in range(rng.randint(1, 2)):
            at = rng.choice([0, 0, rng.randrange(len(word))])
            word[at] = rng.choice("abcdexyz")
        labels.append("".join(word))
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    keys = {r[0] for r in df.select(X.label_key(F.col("label"))).collect()}
    want = {(a, b) for a in keys for b in keys if a != b and entities.jaro_winkler(a, b) >= least}
    assert ("microsoft", "nicrosoft") in want
    for few in (0, 1_000_000):
        assert sorted((r.key_a, r.key_b) for r in entities.alike(df, df, least, few=few).collect()) == sorted(want)


def test_alike_finds_all_pairs_of_many_labels(spark):
    """Hundreds of words of a small alphabet and their misspellings, against all pairs; candidates are few, also where all labels have one head or one length."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("etaoinshrdlu") for _ in range(n))
    plain = [" ".join(word(rng.randint(3, 8)) for _ in range(2)) for _ in range(450)]
    odd = [x[:i] + rng.choice("xyz ") + x[i + 1 :] for x in plain[:150] for i in (rng.randrange(len(x)), rng.randrange(len(x)))]
    for labels in (plain + odd + [x[1:] for x in plain[:100]], ["item " + word(9) for _ in range(250)] + [f"item {i:06}" for i in range(150)]):
        keys = sorted({" ".join(re.findall("[a-z0-9]+", x)) for x in labels})
        pairs = [(a, b) for a in keys for b in keys if a < b]
        scores = entities.jaro_winkler_pairs(*map(list, zip(*pairs, strict=True)))
        want = {p for p, s in zip(pairs, scores, strict=True) if s >= entities.HIGH}
        table = spark.createDataFrame([(x, True, True) for x in keys], "key string, in_a boolean, in_b boolean")
        met = [(r.key_a, r.key_b) for r in entities.alike_candidates(table, entities.HIGH, few=0).where("key_a < key_b").collect()]
        assert want <= set(met) and len(met) == len(set(met)) <= 3 * len(want) + 0.01 * len(pairs)
        df = spark.createDataFrame([(x,) for x in labels], "label string")
        assert {(r.key_a, r.key_b) for r in entities.alike(df, df, entities.HIGH).where("key_a < key_b").collect()} == want


def test_alike_of_two_tables(spark):
    left, right = (spark.createDataFrame([(x,) for x in rows], "label string") for rows in (["abcdefgh", "zzz", "same one"], ["abcdefgi", "same one", "zzy", "abcdefgh"]))
    got = {(r.key_a, r.key_b) for r in entities.alike(left, right, 0.85).collect()}
    assert got == {("abcdefgh", "abcdefgi")} and entities.alike(left.limit(0), right, 0.85).count() == 0


def test_similarity_of_many_pairs():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcé 😀") for _ in range(rng.randrange(12))) for _ in range(400)] + ["", "a", "x" * 700, "x" * 699 + "y"]
    a, b = ([rng.choice(words) for _ in range(6000)] for _ in range(2))
    got = entities.jaro_winkler_pairs(a, b)
    assert all(abs(g - entities.jaro_winkler(x, y)) < 1e-12 for g, x, y in zip(got, a, b, strict=True))


def test_similarity():
    jw = entities.jaro_winkler
    assert jw("", "") == 1.0 and jw("a", "") == 0.0 and jw("abc", "xyz") == 0.0
    assert abs(jw("martha", "marhta") - 0.9611111) < 1e-6 and abs(jw("dixon", "dicksonx") - 0.8133333) < 1e-6 and abs(jw("dwayne", "duane") - 0.84) < 1e-6


def _roots(edges):
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components_after_random_changes(spark):
    """Edges come and go; labels equal components of all edges each time."""
    r = random.Random(17)
    frame = lambda rows: spark.createDataFrame(sorted(rows), "a long, b long")
    edges = {(r.randrange(60), r.randrange(60)) for _ in range(35)}
    labels = connected_components(frame(edges))
    for turn in range(4):
        if turn % 2:
            gone = set(r.sample(sorted(edges), 6))
            edges -= gone
            labels = parted(labels, frame(edges), frame(gone))
        else:
            new = {(r.randrange(70), r.randrange(70)) for _ in range(9)} | {(5, 5)}
            edges |= new
            labels = merged(labels, frame(new))
        got = labels.collect()
        assert {x.node: x.root for x in got} == _roots(edges) and len(got) == len(_roots(edges))
    none = frame(set()).limit(0)
    assert sorted(map(tuple, merged(labels, none).collect())) == sorted(map(tuple, labels.collect())) == sorted(map(tuple, parted(labels, frame(edges), none).collect()))
    assert merged(none.toDF("node", "root"), frame({(1, 2)})).count() == 2


def test_untouched_clusters_stay_out_of_the_rounds(spark, monkeypatch):
    from quadrille.plans import components

    seen, plain = [], components.connected_components
    monkeypatch.setattr(components, "connected_components", lambda edges, *more: seen.append(edges.count()) or plain(edges, *more))
    rows = [(10 * c, 10 * c + i) for c in range(50) for i in range(1, 6)]
    edges = spark.createDataFrame(rows, "a long, b long")
    labels = plain(edges)
    components.merged(labels, spark.createDataFrame([(3, 14), (999, 1000)], "a long, b long"))
    components.parted(labels, edges.where("b <> 21"), edges.where("b = 21"))
    assert seen == [2, 4]


def test_graph_helpers(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("z", "z")], "a string, b string")
    members = connected_components(edges).select("node", "root")
    assert {r.node: r.root for r in members.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    assert {r.root: r.node for r in graph.elect(edges, members).collect()} == {"a": "a", "x": "y", "z": "z"}
    marked = spark.createDataFrame([("a",), ("b",), ("y",), ("lone",)], "node string")
    got = {r.root: (r.canonical, r.status) for r in graph.status(members, graph.elect(edges, members), marked).collect()}
    assert got == {"a": ("a", "conflict"), "x": ("y", "graph"), "z": ("z", "derived"), "lone": ("lone", "graph")}
    nodes, truncated = graph.hops(edges, spark.createDataFrame([("a",)], "node string"), 2, cap=1)
    assert truncated == [True, True] and nodes.count() == 2
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in connected_components(path).collect()} == {0}


def test_files_search_bitemporal_stream(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,Name,x\n1,"a ""q""",z\n1,dup,z\n2,b,z\n')
    one = files.load_csv(spark, str(tmp_path / "t.csv"), "id int, Name string, x string", {"id": "id", "name": "Name"}, ["id"])
    assert one.count() == 2 and files.load_csv(spark, str(tmp_path / "t.csv"), "id int, Name string, x string", {"id": "id", "name": "Name"}, ["id"], one).count() == 2
    objects = spark.createDataFrame([("d", "p/a.txt"), ("d", "p/z.PDF"), ("e", "p/b.txt")], "document string, path string")
    assert {r.document: r.path for r in files.resolve_object(objects).collect()} == {"d": "p/z.PDF", "e": "p/b.txt"}
    facts = spark.sql("SELECT 1 AS k, timestamp_ntz'2020-01-01' AS valid_from, CAST(NULL AS timestamp_ntz) AS valid_to")
    closed = ingest.retract(facts, facts, ["k"], "2021-01-01")
    assert ingest.valid_at(closed, "2020-06-01").count() == 1 and ingest.valid_at(closed, "2021-01-01").count() == 0
    with pytest.raises(ValueError):
        search.bm25(facts, "  ")
    from quadrille.streaming.ingest import into, once

    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").withColumn("at", F.current_timestamp()).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v string, at timestamp").parquet(str(tmp_path / "in"))
    into(once(stream, "id", "at"), lambda b: b.select("id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_top_candidates_are_exact_however_common_words_are(spark):
    r = random.Random(7)
    pool = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["of"] * 15
    docs = [(f"d{i}", " ".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(300)]
    asked = [(f"q{i}", " ".join(r.choice(pool) for _ in range(r.randrange(1, 6)))) for i in range(30)] + [("none", "zzz"), ("empty", "")]
    n, words = len(docs), {i: set(t.split()) for i, t in docs}
    weight = {w: math.log(1 + n / sum(w in x for x in words.values())) for w in {w for x in words.values() for w in x}}
    want = set()
    for q, t in asked:
        scores = sorted(((-round(sum(weight.get(w, 0) for w in set(t.split()) & x), 6), i) for i, x in words.items() if set(t.split()) & x))
        want |= {(q, i, -s, k) for k, (s, i) in enumerate(scores[:10], 1)}
    for common in (0.0, 0.05, 1.0):
        got = entities.top_candidates(spark.createDataFrame(asked, "query_id string, label string"), spark.createDataFrame(docs, "id string, label string"), 10, common)
        assert {(x.query_id, x.id, round(x.score, 6), x["rank"]) for x in got.collect()} == {(q, i, round(s, 6), k) for q, i, s, k in want}


def test_resolve_against_brute_force(spark):
    """Bands by plain Jaro-Winkler over the batch and over the candidates that share a word; empty labels pair with nothing."""
    names = ["Microsoft Corp", "Imcrosoft Corp", "microsoft  corp", "Apple Inc", "Aple Inc", "--", "!!", "Banana Republic", "Banana Republik"]
    new = [(f"n{i}", x) for i, x in enumerate(names)]
    known = [(f"k{i}", x) for i, x in enumerate(["Microsoft Corp.", "Apple Incorporated", "Banana", "Nothing", "??"])]
    got = {(x.iri, x.other): x.band for x in entities.resolve(spark.createDataFrame(new, "iri string, label string"), spark.createDataFrame(known, "iri string, label string")).collect()}
    key = lambda t: " ".join(re.findall("[a-z0-9]+", t.lower()))
    want = {}
    for i, (a, x) in enumerate(new):
        for b, y in new[i + 1 :] + known:
            u, v = key(x), key(y)
            if u and v and (b[0] == "n" or set(u.split()) & set(v.split())):
                s = entities.jaro_winkler(u, v)
                if s >= (entities.HIGH if b[0] == "n" else entities.LOW):
                    want[a, b] = "exact" if u == v else "high" if s >= entities.HIGH else "judge"
    assert got == want


def test_typed_order_escapes_and_compatible_joins(spark):
    rows = [("<g>", f"<x{i}>", "<v>", t) for i, t in enumerate(['"2"^^<%sinteger>' % XSD, '"9"^^<%sinteger>' % XSD, '"10"^^<%sdouble>' % XSD, '"b"', "<iri>", "_:n"])]
    store = QuadStore.of(spark, rows, union_default=True)
    assert [r.o for r in store.query("SELECT ?o { ?s <v> ?o } ORDER BY ?o").collect()] == ["_:n", "iri", "2", "9", "10", "b"]
    assert [r.o for r in store.query("SELECT ?o { ?s <v> ?o } ORDER BY DESC(?o)").collect()] == ["b", "10", "9", "2", "iri", "_:n"]
    one = store.query("SELECT (MIN(?o) AS ?a) (MAX(?o) AS ?b) { ?s <v> ?o FILTER(isLiteral(?o) && ?o < 100) }").first()
    assert tuple(one) == ("2", "10")
    odd = ['a"@en', 'b"^^<t>', "c\\", 'say "x"', "plain"]
    texts = QuadStore.of(spark, [], union_default=True).update("".join("INSERT DATA { GRAPH <g> { <s%d> <t> %s } } ; " % (i, json.dumps(t)) for i, t in enumerate(odd)).rstrip("; "))
    assert sorted(r.o for r in texts.query("SELECT ?o { ?s <t> ?o }").collect()) == sorted(odd)
    assert texts.query("SELECT ?s { ?s <t> ?o FILTER(?o = %s) }" % json.dumps(odd[0])).collect()[0].s == "s0"
    json_ = to_sparql_json(store.terms("SELECT ?o (STRLEN(STR(?s)) AS ?n) { ?s <v> ?o } ORDER BY ?o"))["results"]["bindings"]
    assert json_[0]["o"] == {"type": "bnode", "value": "n"} and json_[2]["o"] == {"type": "literal", "value": "2", "datatype": XSD + "integer"} and json_[0]["n"]["datatype"] == XSD + "integer"
    # An unbound variable is compatible with any value, on either side, in joins, OPTIONAL, MINUS and EXISTS.
    data = [("<g>", s, p, o) for s, p, o in (("<a>", "<name>", '"A"'), ("<b>", "<name>", '"B"'), ("<c>", "<name>", '"C"'), ("<a>", "<k>", "<b>"))]
    g = QuadStore.of(spark, data, union_default=True)
    q = lambda t: sorted(tuple(r) for r in g.query("SELECT " + t).collect())
    assert q("?a ?b { ?a <name> ?m OPTIONAL { ?a <k> ?b } ?b <name> ?n }") == [("a", "b"), *((x, y) for x in "bc" for y in "abc")]
    assert q("?a ?n { ?a <name> ?m OPTIONAL { ?a <k> ?b } OPTIONAL { ?b <name> ?n FILTER(?n = 'B') } }") == [("a", "B"), ("b", "B"), ("c", "B")]
    assert q("?x ?y { VALUES (?x ?y) { (<a> UNDEF) (UNDEF <b>) } ?x <k> ?y }") == [("a", "b"), ("a", "b")]
    assert q("?a { ?a <name> ?m OPTIONAL { ?a <k> ?b } MINUS { ?b <name> 'B' } }") == [("b",), ("c",)]
    assert q("?a { ?a <name> ?m OPTIONAL { ?a <k> ?b } FILTER EXISTS { ?b <name> 'B' } }") == [("a",), ("b",), ("c",)]
    assert q("?a { ?a <name> ?m FILTER(?m = 'C' || EXISTS { ?a <k> ?z }) }") == [("a",), ("c",)]
    assert q("?a { ?a <name> ?m FILTER(?m != 'C' && !EXISTS { ?a <k> ?z }) }") == [("b",)]
    plan = g.query("SELECT ?a ?c { ?a <name> ?m BIND(STR(?m) AS ?b) ?c <name> ?b }")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_service_describes_translates_and_reports(spark, tmp_path):
    (tmp_path / "o.ttl").write_text(ONTOLOGY)
    (tmp_path / "b.ttl").write_text(
        '@prefix ex: <http://t/o#> . @prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n'
        'ex:m a rr:TriplesMap ; rdfs:label "City table" ; ex:joinKey "id" ; ex:queryExample [ rdfs:label "all" ; ex:sql "SELECT * FROM {schema}.city" ] , [ rdfs:label "one" ; ex:sql "SELECT 1" ] .\n'
    )
    (tmp_path / "m.obda").write_text("[PrefixDeclaration]\n:\thttp://t/\nex:\thttp://t/o#\n\n[MappingDeclaration] @collection [[\n\nmappingId City\ntarget :City/{id} a ex:City ; ex:name {name} .\nsource SELECT id, name FROM city_rows\n\n]]\n")
    sets = [{"id": "d", "ontology": ["o.ttl"], "bindings": ["b.ttl"], "mappings": "m.obda", "unique": ["City"], "dialect": "bigquery", "tables": {"city_rows": "project.set.cities", "schema": "s"}}, {"id": "e"}]
    (tmp_path / "m.json").write_text(json.dumps({"base": "http://t", "namespace": NS, "datasets": sets}))
    spark.createDataFrame([(1, "A"), (2, 'B "x"')], "id int, name string").createOrReplaceTempView("city_rows")
    s = Service(spark, Manifest.load(str(tmp_path / "m.json")), str(tmp_path))
    s.reload("d")
    assert s.available("d") and not s.available("e") and not s.available("no")
    made = s.translate("d", "SELECT ?n { ?c a ex:City ; ex:name ?n }")
    assert made["projectedRequested"] and made["projectedApplied"] and "`project`.`set`.`cities`" in made["sql"] and made["sql"].startswith("SELECT") and "Project" in made["plan"]
    with pytest.raises(KeyError):
        s.translate("e", "SELECT ?n { ?c ex:name ?n }")
    assert sorted(r.n for r in s.virtual("d").query("SELECT ?n { ?c a ex:Place ; ex:name ?n }").collect()) == ["A", 'B "x"']
    assert "## City table\nJoin key: id\nExample queries:\n  # all\n  ```sql\n  SELECT * FROM s.city\n" in s.tables("d")
    assert s.ontology_context("d") == "Classes:\n- City: City\n- Place\nProperties:\n- near (Place -> City, Place)"
    h = s.health()
    assert h["live"] and not h["ready"] and h["waiting"] == ["e"] and h["statements"] > 8
    s.reload("e")
    assert s.health()["ready"]
    new = spark.createDataFrame([("http://t/1", "Town Hall"), ("http://t/2", "town hall"), ("http://t/3", "Town Halls")], "iri string, label string")
    s.normalize("d", "run", new)
    assert {(r.method, r.n) for r in s.methods("d").collect()} == {("exact-label", 1), ("jaro-winkler", 2)}
    spark.catalog.dropTempView("city_rows")


def test_domains_ranges_and_superproperties(spark):
    spark.createDataFrame([(1, 2, "A"), (2, None, "B"), (3, 1, None)], "id int, of int, name string").createOrReplaceTempView("things_t")
    text = "[PrefixDeclaration]\n: http://t/\nex: http://t/o#\n\n[MappingDeclaration] @collection [[\n\nmappingId T\ntarget :T/{id} ex:name {name} ; ex:owns :U/{of} .\nsource SELECT id, of, name FROM things_t\n\n]]\n"
    prefixes, mappings = parse_mappings(text, ("T",))
    g = VirtualGraph(spark, prefixes, mappings, {NS + "Owner": [NS + "Agent"]}, properties={NS + "owns": [NS + "has"], NS + "has": [NS + "touches"]}, domains={NS + "has": [NS + "Owner"], NS + "name": [NS + "Named"]}, ranges={NS + "owns": [NS + "Owned"]})
    q = lambda t: sorted(r.x.removeprefix("http://t/") for r in g.query("SELECT DISTINCT ?x { " + t + " }").collect())
    assert q("?y ex:touches ?x") == ["U/1", "U/2"] and q("?x a ex:Owner") == q("?x a ex:Agent") == ["T/1", "T/3"]
    assert q("?x a ex:Owned") == ["U/1", "U/2"] and q("?x a ex:Named") == ["T/1", "T/2"] and q("?x a ex:Named ; ex:has ?y") == ["T/1"]
    spark.catalog.dropTempView("things_t")


#: Every rule shape that the playground offers or a dataset stores, over one vocabulary.
SHAPES = [
    "[a: (?x ex:r ?z) <- (?w ex:p ?x), (?w ex:p ?z), (?x rdf:type ex:A), (?z rdf:type ex:A), notEqual(?x, ?z)]",
    "-> table(rdf:type). [b: (?x rdf:type ex:C) <- (?x rdf:type ex:A), (?x ex:p ?d)]",
    "[c: (?g ex:r ?m) <- (?o ex:p ?g), (?o ex:q ?m), (?m rdf:type ex:B)]",
    "-> table(ex:p). [d: (?x ex:p ?z) <- (?x ex:p ?y), (?y ex:p ?z), (?z rdf:type ex:A), notEqual(?x, ?z)]",
    "-> table(ex:p). [e: (?x ex:p ?z) <- (?x ex:p ?y), (?y ex:p ?z), (?y rdf:type ex:A), (?z rdf:type ex:B), notEqual(?x, ?z)]",
    "[f: (?s ex:r ?o) <- (?o ex:p ?s), (?o rdf:type ex:A), (?s rdf:type ex:B)]",
    "[g: (?x ex:r ?z) <- (?x ex:p ?s), (?z ex:p ?s), (?x rdf:type ex:A), (?z rdf:type ex:B), (?s rdf:type ex:A), notEqual(?x, ?z)]",
    "-> table(ex:q). [h: (?o ex:q ?g) <- (?o ex:p ?s), (?s ex:q ?g), (?o rdf:type ex:A)]",
    "[i: (?x ex:p ?y), (?y ex:p ?z) -> (?x ex:p ?z)]",
    "[j: (?x ex:s ?y) -> (?y ex:s ?x)] [k: (?x ex:s ?y), (?y ex:s ?z) -> (?x ex:s ?z)]",
    "[l: (?x ex:s ?y), (?x ?p ?o) -> (?y ?p ?o)] [m: (?x ex:s ?y), (?y ?p ?o) -> (?x ?p ?o)]",
    "[n: (?x ex:sub ?y), (?y ex:sub ?z) -> (?x ex:sub ?z)] [o: (?x rdf:type ?c), (?c ex:sub ?d) -> (?x rdf:type ?d)]",
    "[p: (?c ex:q ?v) <- (?x ex:s ?c), (?x ex:q ?v)]",
    "[q: (?i ex:q ?r) <- (?i rdf:type ex:A), (?i ex:p ?d), (?d ex:q ?r)]",
]


def _facts(seed):
    """A small random graph for the shapes."""
    r = random.Random(seed)
    names = [f"<{NS}n{i}>" for i in range(7)]
    kinds = {p: f"<{NS}{p}>" for p in ("p", "q", "s", "sub")}
    base = {(r.choice(names), kinds[r.choice("pppqqs")], r.choice(names)) for _ in range(16)}
    base |= {(n, f"<{RDF_TYPE}>", f"<{NS}{r.choice('AB')}>") for n in names}
    return base | {(f"<{NS}A>", kinds["sub"], f"<{NS}B>"), (f"<{NS}B>", kinds["sub"], f"<{NS}Z>")}


RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _solved(body, builtins, known):
    found = [{}]
    for t in body:
        hidden = lambda fact, t=t: hasattr(t.p, "name") and fact[1].startswith("<" + rules.MAGIC)
        found = [n for row in found for fact in known if not hidden(fact) and (n := _match(row, (t.s, t.p, t.o), fact)) is not None]
    value = lambda row, x: row[x.name] if hasattr(x, "name") else f"<{x.value}>"
    return [row for row in found if all(value(row, a) != value(row, b) for _, a, b in builtins)]


def _naive(base, parsed):
    known = set(base)
    while True:
        new = {tuple(row[x.name] if hasattr(x, "name") else f"<{x.value}>" for x in (h.s, h.p, h.o)) for rule in parsed for row in _solved(rule.body, rule.builtins, known) for h in rule.head}
        if new <= known:
            return known
        known |= new


@pytest.mark.parametrize("text", SHAPES)
def test_rule_shapes_against_a_naive_fixpoint(spark, text):
    base, parsed = _facts(text), rules.parse_rules(text, {"ex": NS}).rules
    got = rules.derive(spark.createDataFrame(sorted(base), "s string, p string, o string"), parsed)
    assert {tuple(x) for x in got.collect()} - base == _naive(base, parsed) - base


def _asked(text):
    """Conjunctions for a shape: ends bound and free, constants, joins, variable predicates."""
    head = rules.parse_rules(text, {"ex": NS}).rules[0].head[0]
    p = head.p if isinstance(head.p, Iri) else Iri(NS + "q")
    n, v = [Iri(f"{NS}n{i}") for i in range(7)], {x: Var(x) for x in "abcp"}
    own = head.o if isinstance(head.o, Iri) else None
    out = [[Triple(n[1], p, v["a"])], [Triple(v["a"], p, own or n[2])], [Triple(v["a"], p, v["b"])], [Triple(n[3], p, own or n[2])], [Triple(n[4], v["p"], v["a"])]]
    return out + [[Triple(n[1], Iri(NS + "p"), v["a"]), Triple(v["a"], p, v["b"])], [Triple(v["a"], p, v["b"]), Triple(v["b"], Iri(RDF_TYPE), Iri(NS + "A"))], [Triple(v["a"], p, v["a"])]]


@pytest.mark.parametrize("text", SHAPES)
def test_goals_of_every_shape(spark, text):
    """The transformed rules give a conjunction the solutions that all deductions give; a few by Spark, the others by the naive evaluator."""
    base, parsed = _facts(text + "goals"), rules.parse_rules(text, {"ex": NS}).rules
    whole = _naive(base, parsed)
    frame = spark.createDataFrame(sorted(base), "s string, p string, o string")
    for i, asked in enumerate(_asked(text)):
        program, seeds = goals.transformed(parsed, [asked])
        known = _naive(base | {tuple(encode(x) for x in (t.s, t.p, t.o)) for t in seeds}, program)
        plain = {x for x in known if not x[1].startswith("<" + rules.MAGIC)}
        solutions = lambda facts, asked=asked: {tuple(sorted(row.items())) for row in _solved(asked, [], facts)}
        assert plain <= whole and solutions(plain) == solutions(whole), asked
        if i == 0 and SHAPES.index(text) % 3 == 0:
            found, demands = goals.demanded(frame, parsed, [asked])
            assert {tuple(x) for x in found.collect()} - base == plain - base
            assert all(x.p.startswith("<" + rules.MAGIC) for x in demands.collect())


def test_goals_leave_the_rest_of_the_graph_alone(spark):
    """A chain from one node: what is derived does not grow with other chains."""
    text = "-> table(ex:p). [t: (?x ex:p ?z) <- (?x ex:p ?y), (?y ex:p ?z)]"
    parsed = rules.parse_rules(text, {"ex": NS}).rules
    chain = lambda c, n: [(f"<{NS}{c}{i}>", f"<{NS}p>", f"<{NS}{c}{i + 1}>") for i in range(n)]
    asked = [[Triple(Iri(NS + "a0"), Iri(NS + "p"), Var("x"))]]
    counts = []
    for others in (0, 6):
        rows = chain("a", 6) + [x for k in range(others) for x in chain("bcdefg"[k], 30)]
        found, demands = goals.demanded(spark.createDataFrame(rows, "s string, p string, o string"), parsed, asked)
        found, demands = found.collect(), demands.collect()
        assert {x.o for x in found if x.s == f"<{NS}a0>"} == {f"<{NS}a{i}>" for i in range(2, 7)}
        counts.append((len(found), len(demands)))
    assert counts[0] == counts[1]


def test_goals_of_queries():
    """Every place of a query in which patterns may stand."""
    q = parse("SELECT ?x { ?x <a> ?y . ?y <b>+/<c> ?z OPTIONAL { ?z <d> ?w } FILTER(NOT EXISTS { ?x <e> ?v }) { SELECT ?x { ?x <f> ?u } } MINUS { ?x <g> ?t } << ?x <a> ?y >> <h> ?i }", {})
    named = {t.p.value for c in goals.conjunctions(q) for t in c if isinstance(t.p, Iri)}
    assert named == set("abcdefg")
    assert goals.conjunctions(parse("SELECT ?x { ?x !(<a>|<b>) ?y }", {})) == [[Triple(Var(".s"), Var(".any"), Var(".o"))]]


def _match(row, pattern, fact):
    row = dict(row)
    for x, value in zip(pattern, fact, strict=True):
        if hasattr(x, "name"):
            if row.setdefault(x.name, value) != value:
                return None
        elif f"<{x.value}>" != value:
            return None
    return row


def test_saga_takes_outer_effects_back_and_pages_are_kept(service, spark):
    log, before = [], service.store

    def fail(s):
        raise RuntimeError("no")

    def late(s):
        raise ValueError("late")

    with pytest.raises(RuntimeError) as e:
        service.saga([(lambda s: s.update("INSERT DATA { GRAPH <g> { <a> <b> <c> } }"), lambda s: log.append("first")), (lambda s: log.append("did"), late), (lambda s: None, lambda s: log.append("third")), fail])
    assert log == ["did", "third", "first"] and service.store is before and e.value.__notes__ == ["not taken back: late"]
    service.normalize("d", "run", spark.createDataFrame([("http://t/1", "Town Hall"), ("http://t/2", "town hall")], "iri string, label string"))
    one = service.normalization_page("d")
    assert one.count() == 1 and service._pages["d"][2] is service._pages["d"][2]
    kept = service._pages["d"]
    service.normalization_page("d", 2)
    assert service._pages["d"] is kept
    service.normalization_page("d", refresh=True)
    assert service._pages["d"] is not kept


def test_service_text_documents_and_timeouts(service, spark, tmp_path):
    g = service.manifest.graph("d", "asserted")
    rows = [("river", "Größe des Flusses", "a long river"), ("town", "Town hall", None), ("both", "river town", "river river")]
    quads = [(f"<{g}>", f"<{NS}{s}>", f"<{RDFS}{p}>", f'"{v}"') for s, label, comment in rows for p, v in (("label", label), ("comment", comment)) if v]
    service.store = service.store.but(service.store.quads.union(spark.createDataFrame(quads, "g string, s string, p string, o string")))
    found = service.text("d", "River").collect()
    assert {r.entity for r in found} == {NS + "both", NS + "river"} and found[0].score >= found[1].score > 0
    assert [r.entity for r in service.text("d", "größe").collect()] == [NS + "river"] and service.text("d", "nothing").count() == 0
    with pytest.raises(ValueError):
        service.text("d", " ! ")
    assert service.query("SELECT ?s { GRAPH ?g { ?s rdfs:label 'Town hall' } }", seconds=60).first().s == NS + "town"
    store = ObjectStore(spark, str(tmp_path / "objects"))
    key = store.put("docs/d/x/a.pdf", b"%PDF")
    assert service.document(store, "docs/d/x") == (key, "application/pdf", b"%PDF")
