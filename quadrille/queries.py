"""Registered queries over the driver's tables, with the SQL that must agree."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions import text as X
from quadrille.operators import crawl, entities, graph, ingest, rules, search
from quadrille.operators.incremental import Materialized
from quadrille.operators.quads import QuadStore
from quadrille.operators.stored import StoredGraph
from quadrille.operators.vkg import VirtualGraph
from quadrille.plans.compile import quoted
from quadrille.plans.components import connected_components, merged, parted
from quadrille.plans.lineage import scratch_path
from quadrille.plans.sparql import parse
from quadrille.plans.sqltext import SqlWriter
from quadrille.sources.mapping import from_r2rml, parse_mappings
from quadrille.sources.turtle import encoded, read_turtle, to_turtle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MAPPINGS = """
[PrefixDeclaration]
:     http://example.org/data/
ex:   http://example.org/ontology#

[MappingDeclaration] @collection [[
mappingId   Region
target      :Region/{r_regionkey} a ex:Region ; ex:regionName {r_name}^^xsd:string .
source      SELECT r_regionkey, r_name FROM region

mappingId   Nation
target      :Nation/{n_nationkey} a ex:Nation ; ex:nationName {n_name}^^xsd:string ; ex:partOf :Region/{n_regionkey} .
source      SELECT n_nationkey, n_name, n_regionkey FROM nation

mappingId   Customer
target      :Customer/{c_custkey} a ex:Customer ; ex:customerName {c_name}^^xsd:string ; ex:segment {c_mktsegment}^^xsd:string ; ex:balance {c_acctbal}^^xsd:double ; ex:inNation :Nation/{c_nationkey} .
source      SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer

mappingId   Supplier
target      :Supplier/{s_suppkey} a ex:Supplier ; ex:supplierName {s_name}^^xsd:string ; ex:balance {s_acctbal}^^xsd:double ; ex:inNation :Nation/{s_nationkey} .
source      SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier

mappingId   Part
target      :Part/{p_partkey} a ex:Part ; ex:partName {p_name}^^xsd:string ; ex:brand {p_brand}^^xsd:string ; ex:size {p_size}^^xsd:integer ; ex:price {p_retailprice}^^xsd:double .
source      SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part

mappingId   Order
target      :Order/{o_orderkey} a ex:Order ; ex:status {o_orderstatus}^^xsd:string ; ex:total {o_totalprice}^^xsd:double ; ex:orderDate {o_orderdate}^^xsd:dateTime ; ex:priority {o_orderpriority}^^xsd:string ; ex:placedBy :Customer/{o_custkey} .
source      SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders

mappingId   Line
target      :Line/{l_orderkey}/{l_linenumber}/{l_partkey}/{l_suppkey} a ex:Line ; ex:ofOrder :Order/{l_orderkey} ; ex:ofPart :Part/{l_partkey} ; ex:ofSupplier :Supplier/{l_suppkey} .
source      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem

mappingId   LineAmounts
target      :Amount/{l_orderkey}/{l_linenumber}/{l_partkey}/{l_suppkey}/{l_extendedprice}/{l_shipdate} ex:amountOf :Order/{l_orderkey} ; ex:extended {l_extendedprice}^^xsd:double ; ex:quantity {l_quantity}^^xsd:double ; ex:discount {l_discount}^^xsd:double ; ex:tax {l_tax}^^xsd:double ; ex:shipDate {l_shipdate}^^xsd:dateTime ; ex:suppliedBy :Supplier/{l_suppkey} ; ex:returnFlag {l_returnflag}^^xsd:string .
source      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag FROM lineitem

mappingId   Builder
target      :Customer/{c_custkey} a ex:Builder .
source      SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'

mappingId   BigSpender
target      :Customer/{o_custkey} ex:largestOrder {largest}^^xsd:double .
source      SELECT o_custkey, max(o_totalprice) AS largest FROM orders GROUP BY o_custkey

mappingId   Event
target      :Event/{event_id} a ex:Event ; ex:at {ts}^^xsd:dateTime ; ex:kind {event_type}^^xsd:string ; ex:amount {value}^^xsd:double ; ex:byUser :User/{user_id} .
source      SELECT event_id, ts, event_type, value, user_id FROM events
]]
"""
UNIQUE = ("Region", "Nation", "Customer", "Supplier", "Part", "Order", "Builder", "BigSpender", "Event", "LineAmounts")
EX, DATA = "http://example.org/ontology#", "http://example.org/data/"
SUBCLASSES = {EX + "Customer": [EX + "Party"], EX + "Supplier": [EX + "Party"], EX + "Builder": [EX + "Customer"]}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temp views of the tables that a statement names."""
    for name in set(re.findall(r"\w+", sql)) & set(TABLES):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def virtual(spark: SparkSession, sf_dir: str, rule_text: str = "") -> VirtualGraph:
    prefixes, mappings = parse_mappings(MAPPINGS, UNIQUE)
    found = rules.parse_rules(rule_text, prefixes).rules if rule_text else ()
    return VirtualGraph(spark, prefixes, mappings, SUBCLASSES, found, lambda sql: views(spark, sf_dir, sql))


def query(oracle: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def vkg(name: str, sparql: str, oracle: str, rule_text: str = "", then=None) -> None:
    """A query over the virtual graph of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = virtual(spark, sf_dir, rule_text).query(sparql)
        return then(out) if then else out

    run.__name__ = name
    query(oracle)(run)


def rounded(*cols: str):
    return lambda df: df.select(*(F.round(F.col(c).cast("double"), 4).alias(c) if c in cols else F.col(c) for c in df.columns))


vkg("vkg_count_class", "SELECT (COUNT(?o) AS ?n) { ?o a ex:Order }", "SELECT count(*) AS n FROM orders")
vkg("vkg_star_scan", "SELECT ?status ?total ?priority { ?o a ex:Order ; ex:status ?status ; ex:total ?total ; ex:priority ?priority }", "SELECT o_orderstatus AS status, o_totalprice AS total, o_orderpriority AS priority FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
vkg(
    "vkg_chain_join",
    "SELECT ?nation ?name ?total { ?o ex:total ?total ; ex:placedBy ?c . ?c ex:customerName ?name ; ex:inNation [ ex:nationName ?nation ] . FILTER(?total > 300000) }",
    "SELECT n_name AS nation, c_name AS name, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 300000",
)
vkg(
    "vkg_hidden_node",
    "SELECT ?o ?seg { ?o ex:placedBy [ ex:segment ?seg ; ex:inNation [ ex:partOf [ ex:regionName 'ASIA' ] ] ] }",
    "SELECT 'http://example.org/data/Order/' || o_orderkey AS o, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
vkg(
    "vkg_optional",
    "SELECT ?name ?total { ?c ex:customerName ?name OPTIONAL { ?o ex:placedBy ?c ; ex:total ?total FILTER(?total > 400000) } }",
    "SELECT c_name AS name, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000",
)
vkg("vkg_multi_mapping_class", "SELECT ?x ?b { ?x ex:balance ?b . FILTER(?b < 0) }", "SELECT 'http://example.org/data/Customer/' || c_custkey AS x, c_acctbal AS b FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'http://example.org/data/Supplier/' || s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
vkg("vkg_cross_mapping_merge", "SELECT ?name ?largest { ?c ex:customerName ?name ; ex:largestOrder ?largest }", "SELECT c_name AS name, m AS largest FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
vkg("vkg_role_filtered_class", "SELECT ?name { ?c a ex:Builder ; ex:customerName ?name }", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'")
vkg("vkg_date_range", "SELECT (COUNT(?o) AS ?n) { SERVICE ex:mapped { ?o ex:orderDate ?d } FILTER(?d >= '1995-01-01' && ?d <= '1995-12-31') }", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-12-31'")
vkg(
    "vkg_bind_sum_ratio",
    "SELECT ?o (SUM(?net) / ?total AS ?ratio) { ?a ex:amountOf ?o ; ex:extended ?e ; ex:discount ?d ; ex:tax ?t . ?o ex:total ?total . BIND(?e * (1 - ?d) * (1 + ?t) AS ?net) } GROUP BY ?o ?total",
    "SELECT 'http://example.org/data/Order/' || o_orderkey AS o, round(s / o_totalprice, 4) AS ratio FROM (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey",
    then=rounded("ratio"),
)
vkg("vkg_count_distinct_ratio", "SELECT (SUM(?q) / COUNT(DISTINCT ?o) AS ?r) { ?a ex:amountOf ?o ; ex:quantity ?q }", "SELECT round(sum(l_quantity) / count(DISTINCT l_orderkey), 4) AS r FROM lineitem", then=rounded("r"))
vkg(
    "vkg_avg_datediff",
    "SELECT ?p (AVG(?days) AS ?r) { ?a ex:amountOf ?o ; ex:shipDate ?s . ?o ex:orderDate ?d ; ex:priority ?p . BIND(date_diff(?d, ?s, 'day') AS ?days) } GROUP BY ?p",
    "SELECT o_orderpriority AS p, round(avg(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)), 4) AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    then=rounded("r"),
)
vkg("vkg_group_two_keys", "SELECT ?s ?p (COUNT(?o) AS ?n) { ?o ex:status ?s ; ex:priority ?p } GROUP BY ?s ?p", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2")
vkg("vkg_avg_expr", "SELECT ?f (AVG(?v) AS ?r) { ?a ex:extended ?e ; ex:discount ?d ; ex:returnFlag ?f . BIND(?e * (1 - ?d) AS ?v) } GROUP BY ?f", "SELECT l_returnflag AS f, round(avg(l_extendedprice * (1 - l_discount)), 4) AS r FROM lineitem GROUP BY 1", then=rounded("r"))
vkg("vkg_group_count", "SELECT ?name (COUNT(?o) AS ?n) { ?o a ex:Order ; ex:placedBy [ ex:customerName ?name ] } GROUP BY ?name", "SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
vkg("vkg_having_order_limit", "SELECT ?name (COUNT(?o) AS ?n) { ?o ex:placedBy [ ex:customerName ?name ] } GROUP BY ?name HAVING (COUNT(?o) > 10) ORDER BY DESC(?n) ?name LIMIT 25", "SELECT c_name AS name, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 10 ORDER BY n DESC, name LIMIT 25")
vkg("vkg_subclass_entailment", "SELECT DISTINCT ?x { ?x a ex:Party }", "SELECT 'http://example.org/data/Customer/' || c_custkey AS x FROM customer UNION SELECT 'http://example.org/data/Supplier/' || s_suppkey FROM supplier")
vkg(
    "vkg_rule_unfolding",
    "SELECT ?name ?region { ?c ex:inRegion ?r ; ex:customerName ?name . ?r ex:regionName ?region }",
    "SELECT c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    rule_text="[inRegion: (?x ex:inRegion ?r) <- (?x ex:inNation ?n), (?n ex:partOf ?r)]",
)
vkg("vkg_constant_subject", "SELECT ?name ?n { <http://example.org/data/Customer/7> ex:customerName ?name ; ex:inNation [ ex:nationName ?n ] }", "SELECT c_name AS name, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
vkg("vkg_set_of_triples", "SELECT ?o ?p { ?l ex:ofOrder ?o ; ex:ofPart ?p }", "SELECT o, p FROM (SELECT DISTINCT 'http://example.org/data/Order/' || l_orderkey AS o, 'http://example.org/data/Part/' || l_partkey AS p, l_linenumber, l_suppkey FROM lineitem)")
vkg("vkg_projection_order", "SELECT ?size ?brand ?name { ?p ex:partName ?name ; ex:brand ?brand ; ex:size ?size FILTER(?size IN (1, 2, 3) && ?brand != 'Brand#11') }", "SELECT p_size AS size, p_brand AS brand, p_name AS name FROM part WHERE p_size IN (1, 2, 3) AND p_brand <> 'Brand#11'")
vkg("vkg_union_minus", "SELECT ?name { { ?x ex:customerName ?name } UNION { ?x ex:supplierName ?name } MINUS { ?x a ex:Builder } }", "SELECT c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT s_name FROM supplier")
vkg("vkg_not_exists", "SELECT ?name { ?c ex:customerName ?name FILTER NOT EXISTS { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 100000) } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
vkg("vkg_optional_chain", "SELECT ?o ?x { ?o ex:placedBy ?c OPTIONAL { ?c ex:inNation ?n } OPTIONAL { ?n ex:nationName ?x } }", "SELECT 'http://example.org/data/Order/' || o_orderkey AS o, n_name AS x FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
vkg("vkg_subselect", "SELECT ?name ?n { ?c ex:customerName ?name { SELECT ?c (COUNT(?o) AS ?n) { ?o ex:placedBy ?c } GROUP BY ?c } FILTER(?n >= 15) }", "SELECT c_name AS name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE n >= 15")


vkg("vkg_year_month", "SELECT ?y ?m (COUNT(?o) AS ?n) { ?o ex:orderDate ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
vkg("vkg_concat_if", "SELECT ?t (COUNT(*) AS ?n) { ?p ex:brand ?b ; ex:size ?z BIND(CONCAT(LCASE(STR(?b)), IF(?z > 25, '-large', '-small')) AS ?t) } GROUP BY ?t", "SELECT lower(p_brand) || CASE WHEN p_size > 25 THEN '-large' ELSE '-small' END AS t, count(*) AS n FROM part GROUP BY 1")

R2RML = """@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://example.org/ontology#> .
ex:A rr:logicalTable [ rr:tableName "nation" ] ; rr:subjectMap [ rr:template "http://example.org/data/Nation/{n_nationkey}" ; rr:class ex:Nation ] ;
    rr:predicateObjectMap [ rr:predicate ex:nationName ; rr:objectMap [ rr:column "n_name" ] ] ;
    rr:predicateObjectMap [ rr:predicate ex:partOf ; rr:objectMap [ rr:parentTriplesMap ex:B ; rr:joinCondition [ rr:child "n_regionkey" ; rr:parent "r_regionkey" ] ] ] .
ex:B rr:logicalTable [ rr:sqlQuery "SELECT r_regionkey, r_name FROM region" ] ; rr:subjectMap [ rr:template "http://example.org/data/Region/{r_regionkey}" ] ;
    rr:predicateObjectMap [ rr:predicate ex:regionName ; rr:objectMap [ rr:column "r_name" ] ] .
ex:C rr:logicalTable [ rr:tableName "customer" ] ; rr:subjectMap [ rr:template "http://example.org/data/Customer/{c_custkey}" ] ;
    rr:predicateObjectMap [ rr:predicate ex:inNation ; rr:objectMap [ rr:template "http://example.org/data/Nation/{c_nationkey}" ] ] ."""


@query("SELECT r_name AS region, n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def vkg_r2rml(spark, sf_dir):
    views(spark, sf_dir, "nation region customer")
    graph_ = VirtualGraph(spark, {"ex": EX}, from_r2rml(read_turtle(R2RML)))
    return graph_.query("SELECT ?region ?nation (COUNT(?c) AS ?n) { ?c ex:inNation ?x . ?x a ex:Nation ; ex:nationName ?nation ; ex:partOf [ ex:regionName ?region ] } GROUP BY ?region ?nation")


@query("SELECT DISTINCT 'http://example.org/data/Customer/' || o_custkey AS x, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey")
def vkg_domain_range(spark, sf_dir):
    """Classes that the range of a property entails, and a property by way of its superproperty."""
    prefixes, mappings = parse_mappings(MAPPINGS, UNIQUE)
    graph_ = VirtualGraph(spark, prefixes, mappings, prepare=lambda sql: views(spark, sf_dir, sql), properties={EX + "customerName": [EX + "label"]}, ranges={EX + "placedBy": [EX + "Buyer"]})
    return graph_.query("SELECT DISTINCT ?x ?name { ?x a ex:Buyer ; ex:label ?name }")


def sqltext(name: str, sparql: str, oracle: str) -> None:
    """A query over the virtual graph by way of its SQL text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, MAPPINGS)
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # paths have as many rows as the tables give, not a million
        return spark.sql(SqlWriter(virtual(spark, sf_dir)).translate(sparql)["sql"])

    run.__name__ = name
    query(oracle)(run)


sqltext("sqltext_chain", "SELECT ?nation ?name ?total { ?o ex:total ?total ; ex:placedBy ?c . ?c ex:customerName ?name ; ex:inNation [ ex:nationName ?nation ] . FILTER(?total > 300000) }", "SELECT n_name AS nation, c_name AS name, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 300000")
sqltext("sqltext_group", "SELECT ?name (COUNT(?o) AS ?n) (MAX(?t) AS ?most) { ?o ex:total ?t ; ex:placedBy [ ex:customerName ?name ] } GROUP BY ?name HAVING (COUNT(?o) > 10)", "SELECT c_name AS name, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING count(*) > 10")
sqltext("sqltext_entailed_union", "SELECT DISTINCT ?x { ?x a ex:Party }", "SELECT 'http://example.org/data/Customer/' || c_custkey AS x FROM customer UNION SELECT 'http://example.org/data/Supplier/' || s_suppkey FROM supplier")
sqltext("sqltext_optional", "SELECT ?n ?big { ?c ex:customerName ?n OPTIONAL { ?c ex:largestOrder ?big } }", "SELECT c_name AS n, max(o_totalprice) AS big FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")


sqltext("sqltext_minus", "SELECT ?name { ?c ex:customerName ?name MINUS { ?c a ex:Builder } }", "SELECT c_name AS name FROM customer WHERE c_mktsegment <> 'BUILDING'")
sqltext("sqltext_not_exists", "SELECT ?name { ?c ex:customerName ?name FILTER NOT EXISTS { ?o ex:placedBy ?c ; ex:total ?t FILTER(?t > 100000) } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sqltext("sqltext_path", f"SELECT ?x {{ ?x (ex:inNation|ex:partOf)+ <{DATA}Region/2> }}", f"SELECT '{DATA}Nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2 UNION ALL SELECT '{DATA}Customer/' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 UNION ALL SELECT '{DATA}Supplier/' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2")
sqltext("sqltext_variable_predicate", "SELECT ?p (COUNT(*) AS ?n) { ?c a ex:Customer ; ?p ?o } GROUP BY ?p", f"SELECT '{EX}' || unnest(['customerName', 'segment', 'balance', 'inNation']) AS p, count(*) AS n FROM customer UNION ALL SELECT '{EX}largestOrder', count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', (SELECT count(*) FROM customer) + (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING')")


# -- stored graphs
def stored(spark: SparkSession, sf_dir: str) -> QuadStore:
    """Nations and regions in one graph, customers of positive balance in another, with annotations on the latter."""

    def iri(kind: str, c: str):
        return F.concat(F.lit(f"<{DATA}{kind}/"), F.col(c).cast("string"), F.lit(">"))

    def quad(df, g, s, p, o):
        return df.select(F.lit(f"<{EX}{g}>").alias("g"), s.alias("s"), F.lit(f"<{EX}{p}>").alias("p"), o.alias("o"))

    def lit(c, kind=""):
        return quoted(F.col(c).cast("string"), f"http://www.w3.org/2001/XMLSchema#{kind or 'string'}")

    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    quads = (
        quad(nation, "geo", iri("Nation", "n_nationkey"), "name", lit("n_name"))
        .union(quad(nation, "geo", iri("Nation", "n_nationkey"), "partOf", iri("Region", "n_regionkey")))
        .union(quad(region, "geo", iri("Region", "r_regionkey"), "name", lit("r_name")))
        .union(quad(customer, "people", iri("Customer", "c_custkey"), "name", lit("c_name")))
        .union(quad(customer, "people", iri("Customer", "c_custkey"), "inNation", iri("Nation", "c_nationkey")))
        .union(quad(customer, "people", iri("Customer", "c_custkey"), "balance", lit("c_acctbal", "double")))
    )
    placed = quad(customer, "people", iri("Customer", "c_custkey"), "inNation", iri("Nation", "c_nationkey"))
    run = F.concat(F.lit('"run'), (F.col("c_custkey") % 3).cast("string"), F.lit('"'))
    doc = F.concat(F.lit(f"<{DATA}Doc/"), (F.col("c_custkey") % 10).cast("string"), F.lit(">"))
    keyed = customer.withColumn("s", iri("Customer", "c_custkey")).select("s", run.alias("run"), doc.alias("doc"), "c_custkey")
    notes = placed.join(keyed, "s").select("g", "s", "p", "o", F.explode(F.array(F.struct(F.lit(f"<{EX}indexingRun>").alias("ap"), F.col("run").alias("ao")), F.struct(F.lit(f"<{EX}sourceDocument>").alias("ap"), F.col("doc").alias("ao")), F.struct(F.lit(f"<{EX}indexingRun>").alias("ap"), F.when(F.col("c_custkey") % 2 == 0, F.lit('"extra"')).alias("ao")))).alias("n"))
    return QuadStore(quads, notes.select("g", "s", "p", "o", "n.ap", "n.ao").where("ao is not null"), {"ex": EX, "d": DATA})


def kg(name: str, sparql: str, oracle: str, **more) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stored(spark, sf_dir).query(sparql, **more)

    run.__name__ = name
    query(oracle)(run)


kg("kg_graph_counts", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", f"SELECT '{EX}geo' AS g, (SELECT 2 * count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT '{EX}people', 3 * count(*) FROM customer")
kg("kg_from_default_graph", "SELECT ?name FROM ex:geo { ?x ex:partOf ?r . ?r ex:name ?name }", "SELECT r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
kg("kg_union_distinct", "SELECT DISTINCT ?name { { GRAPH ex:geo { ?x ex:partOf ?r . ?r ex:name ?name } } UNION { GRAPH ex:geo { ?x ex:partOf ?r . ?x ex:name ?name } } }", "SELECT r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION SELECT n_name FROM nation")
kg("kg_values_in_notin", "SELECT ?name { VALUES ?r { d:Region1 <http://example.org/data/Region/2> <http://example.org/data/Region/3> } GRAPH ex:geo { ?n ex:partOf ?r ; ex:name ?name } FILTER(?n NOT IN (<http://example.org/data/Nation/8>)) }", "SELECT n_name AS name FROM nation WHERE n_regionkey IN (2, 3) AND n_nationkey <> 8")
kg(
    "kg_group_concat_sample_max",
    "SELECT ?region (GROUP_CONCAT(DISTINCT ?name; SEPARATOR='|') AS ?names) (SAMPLE(?name) AS ?one) (MAX(?name) AS ?last) { GRAPH ex:geo { ?n ex:partOf ?r ; ex:name ?name . ?r ex:name ?region } } GROUP BY ?region",
    "SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS names, min(n_name) AS one, max(n_name) AS last FROM (SELECT DISTINCT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1",
)
kg("kg_star_provenance_count", "SELECT ?doc (COUNT(*) AS ?n) { GRAPH ex:people { ?c ex:inNation ?n . << ?c ex:inNation ?n >> ex:sourceDocument ?doc } } GROUP BY ?doc ORDER BY DESC(?n) ?doc", f"SELECT '{DATA}Doc/' || (c_custkey % 10) AS doc, count(*) AS n FROM customer GROUP BY 1")
kg(
    "kg_not_exists_rollback",
    "SELECT ?c { GRAPH ex:people { << ?c ex:inNation ?n >> ex:indexingRun 'run1' FILTER NOT EXISTS { << ?c ex:inNation ?n >> ex:indexingRun ?other FILTER(?other != 'run1') } } }",
    f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer WHERE c_custkey % 3 = 1 AND c_custkey % 2 <> 0",
)
kg("kg_label_search", "SELECT ?c ?name { GRAPH ex:people { ?c ex:name ?name FILTER(CONTAINS(LCASE(STR(?name)), LCASE('R#00000001'))) } } ORDER BY ?name ?c OFFSET 2 LIMIT 5", f"SELECT '{DATA}Customer/' || c_custkey AS c, c_name AS name FROM customer WHERE contains(lower(c_name), 'r#00000001') ORDER BY 2, 1 LIMIT 5 OFFSET 2")
kg("kg_property_path", "SELECT ?n { GRAPH ex:geo { <http://example.org/data/Region/1> (ex:partOf|^ex:partOf)+ ?n } }", f"SELECT '{DATA}Nation/' || n_nationkey AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT '{DATA}Region/1'")
kg("kg_path_optional", "SELECT ?x ?y { GRAPH ex:geo { ?x ex:name ?m . ?x ex:partOf? ?y } }", f"SELECT '{DATA}Nation/' || n_nationkey AS x, '{DATA}Region/' || n_regionkey AS y FROM nation UNION ALL SELECT '{DATA}Nation/' || n_nationkey, '{DATA}Nation/' || n_nationkey FROM nation UNION ALL SELECT '{DATA}Region/' || r_regionkey, '{DATA}Region/' || r_regionkey FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
kg("kg_path_not", "SELECT ?c ?o { GRAPH ex:people { ?c !(ex:name|ex:balance) ?o } }", f"SELECT '{DATA}Customer/' || c_custkey AS c, '{DATA}Nation/' || c_nationkey AS o FROM customer")
kg("kg_path_sequence", "SELECT ?c ?name { GRAPH ex:people { ?c ex:inNation ?n } GRAPH ex:geo { ?n ex:partOf/ex:name ?name } }", f"SELECT '{DATA}Customer/' || c_custkey AS c, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
kg("kg_numeric_filter_bind", "SELECT ?c ?twice { GRAPH ex:people { ?c ex:balance ?b } FILTER(?b > 9000) BIND(?b * 2 AS ?twice) }", f"SELECT '{DATA}Customer/' || c_custkey AS c, c_acctbal * 2 AS twice FROM customer WHERE c_acctbal > 9000")
kg("kg_ask", "ASK { GRAPH ex:geo { ?n ex:name 'NATION_3' } }", "SELECT EXISTS (SELECT 1 FROM nation WHERE n_name = 'NATION_3') AS ask")
kg("kg_type_tests", "SELECT ?o (isIRI(?o) AS ?i) (STRENDS(STR(?o), '3') AS ?e) { GRAPH ex:geo { <http://example.org/data/Nation/6> ?p ?o } }", f"SELECT '{DATA}Region/' || n_regionkey AS o, true AS i, n_regionkey % 10 = 3 AS e FROM nation WHERE n_nationkey = 6 UNION ALL SELECT n_name, false, n_name LIKE '%3' FROM nation WHERE n_nationkey = 6")

kg(
    "kg_optional_then_join",
    "SELECT ?c ?n ?r { GRAPH ex:people { ?c ex:name ?m } OPTIONAL { GRAPH ex:people { ?c ex:inNation ?n ; ex:balance ?b FILTER(?b > -900) } } GRAPH ex:geo { ?n ex:partOf ?r } }",
    f"SELECT '{DATA}Customer/' || c_custkey AS c, '{DATA}Nation/' || n_nationkey AS n, '{DATA}Region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey OR c_acctbal <= -900",
)
kg("kg_bind_join", "SELECT ?c ?d { GRAPH ex:people { ?c ex:name ?m } BIND(STR(?m) AS ?t) GRAPH ex:people { ?d ex:name ?t } }", f"SELECT '{DATA}Customer/' || x.c_custkey AS c, '{DATA}Customer/' || y.c_custkey AS d FROM customer x JOIN customer y USING (c_name)")
kg("kg_order_numeric", "SELECT ?c (xsd:double(?b) AS ?v) { GRAPH ex:people { ?c ex:balance ?b } } ORDER BY ?b ?c LIMIT 20", f"SELECT '{DATA}Customer/' || c_custkey AS c, c_acctbal AS v FROM customer ORDER BY 2, 1 LIMIT 20")
kg("kg_min_max_numeric", "SELECT ?n (xsd:double(MIN(?b)) AS ?lo) (xsd:double(MAX(?b)) AS ?hi) { GRAPH ex:people { ?c ex:inNation ?n ; ex:balance ?b } } GROUP BY ?n", f"SELECT '{DATA}Nation/' || c_nationkey AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
kg("kg_exists_or", "SELECT ?c { GRAPH ex:people { ?c ex:balance ?b } FILTER(?b > 9000 || EXISTS { GRAPH ex:people { ?c ex:inNation <http://example.org/data/Nation/3> } }) }", f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 9000 OR c_nationkey = 3")
kg("kg_bound_strafter", "SELECT ?c (STRAFTER(STR(?m), '#') AS ?t) { GRAPH ex:people { ?c ex:name ?m } OPTIONAL { GRAPH ex:people { ?c ex:balance ?b FILTER(?b > 5000) } } FILTER(!BOUND(?b)) }", f"SELECT '{DATA}Customer/' || c_custkey AS c, CASE WHEN contains(c_name, '#') THEN substr(c_name, instr(c_name, '#') + 1) ELSE '' END AS t FROM customer WHERE NOT c_acctbal > 5000")
kg("kg_str_less", "SELECT ?a ?b { GRAPH ex:geo { ?a ex:partOf ?r . ?b ex:partOf ?r } FILTER(STR(?a) < STR(?b)) }", f"SELECT '{DATA}Nation/' || x.n_nationkey AS a, '{DATA}Nation/' || y.n_nationkey AS b FROM nation x JOIN nation y USING (n_regionkey) WHERE '{DATA}Nation/' || x.n_nationkey < '{DATA}Nation/' || y.n_nationkey")


@query(f"SELECT '<{DATA}Nation/' || n_nationkey || '>' AS s, '<{EX}in>' AS p, '\"' || r_name || '\"' AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
def kg_construct(spark, sf_dir):
    return stored(spark, sf_dir).query("CONSTRUCT { ?n ex:in ?name } WHERE { GRAPH ex:geo { ?n ex:partOf ?r . ?r ex:name ?name } }")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def kg_turtle_roundtrip(spark, sf_dir):
    """The geography written as Turtle, read again (nations and regions are a few lines) and queried."""
    geo = stored(spark, sf_dir).quads.where(F.col("g") == f"<{EX}geo>")
    text = "\n".join(r.value for r in to_turtle(geo.select("s", "p", "o")).collect())
    back = QuadStore.of(spark, encoded(read_turtle(text), EX + "geo"), prefixes={"ex": EX})
    return back.query("SELECT ?nation ?region { GRAPH ex:geo { ?n ex:partOf ?r ; ex:name ?nation . ?r ex:name ?region } }")


@query(f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer WHERE NOT (c_custkey % 3 = 1 AND c_custkey % 2 <> 0)")
def kg_forget_run(spark, sf_dir):
    """What is left when a run's statements go, but for those that another run asserts too."""
    p = f"<{EX}indexingRun>"
    return stored(spark, sf_dir).without_document('"run1"', p, also=p).query("SELECT ?c { GRAPH ex:people { ?c ex:inNation ?n } }")


@query(f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def kg_reasoned(spark, sf_dir):
    """A query over statements and what rules derive from them."""
    base = _triples(spark, sf_dir)
    derived = rules.derive(base, rules.parse_rules("[h: (?c ex:inNation ?n), (?n ex:partOf ?r) -> (?c ex:inRegion ?r)]", {"ex": EX}).rules)
    store = QuadStore(base.union(derived).select(F.lit("<g>").alias("g"), "s", "p", "o"), prefixes={"ex": EX}, union_default=True)
    return store.query("SELECT ?c { ?c ex:inRegion <http://example.org/data/Region/2> }")


@query("SELECT p_partkey, json_object('name', p_name, 'size', p_size, 'tags', string_split(p_type, ' ')) AS j, string_split(p_type, ' ')[1] AS first FROM part")
def json_values(spark, sf_dir):
    """Rows as JSON text, and one value read back from it."""
    tags = F.split("p_type", " ")
    j = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), tags.alias("tags")))
    return table(spark, sf_dir, "part").select("p_partkey", j.alias("j"), F.get_json_object(j, "$.tags[0]").alias("first"))


@query("SELECT p_partkey, '[' || p_size || '.0,' || p_size || '.5]' AS v FROM part WHERE p_size <> 7")
def vector_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    half = F.when(F.col("p_size") == 7, F.lit(float("nan"))).otherwise(F.col("p_size") + 0.5)
    return p.select("p_partkey", X.vector_text(F.array(F.col("p_size").cast("double"), half)).alias("v")).where("v is not null")


@query(f"SELECT '{DATA}Customer/' || c_custkey AS s FROM customer WHERE c_custkey % 10 <> 3")
def kg_delete_document(spark, sf_dir):
    left = stored(spark, sf_dir).without_document(f"<{DATA}Doc/3>", f"<{EX}sourceDocument>")
    return left.query("SELECT ?s { GRAPH ex:people { ?s ex:inNation ?n } }")


@query("SELECT count(*) AS n, 2 * count(*) + count_if(c_custkey % 2 = 0) AS notes FROM customer")
def kg_snapshot_roundtrip(spark, sf_dir):
    store = stored(spark, sf_dir)
    snap = store.snapshot().where("notes is not null")
    back = store.update("CLEAR SILENT GRAPH ex:people").restore(snap)
    notes = back.notes.agg(F.count("*").alias("notes"))
    return back.quads.where(F.col("g") == f"<{EX}people>").agg(F.count("*").alias("n")).crossJoin(notes)


@query(f"SELECT '{DATA}Customer/' || c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT '{DATA}new', 'EUROPE'")
def kg_update(spark, sf_dir):
    store = stored(spark, sf_dir).update(
        """INSERT { GRAPH ex:derived { ?c ex:inRegion ?r } } WHERE { GRAPH ex:people { ?c ex:inNation ?n } GRAPH ex:geo { ?n ex:partOf ?x . ?x ex:name ?r } } ;
           DELETE WHERE { GRAPH ex:derived { ?c ex:inRegion 'ASIA' } } ; INSERT DATA { GRAPH ex:derived { d:new ex:inRegion 'EUROPE' } }"""
    )
    return store.query("SELECT ?c ?region { GRAPH ex:derived { ?c ex:inRegion ?region } }")


# -- graphs that stay on disk
_files: dict[tuple[str, str], str] = {}


def on_disk(spark: SparkSession, sf_dir: str, own: bool = False) -> StoredGraph:
    """The graphs of stored(), written as files once a session; own: a copy that may be changed."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if own or key not in _files:
        path, source = scratch_path(spark, "graphs"), stored(spark, sf_dir)
        store = StoredGraph.create(spark, path, source.quads, source.notes, prefixes=source.prefixes)
        if own:
            return store
        _files[key] = path
    return StoredGraph.open(spark, _files[key], prefixes={"ex": EX, "d": DATA})


def files(name: str, sparql: str, oracle: str, update: str = "") -> None:
    """A query over files, after an update."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = on_disk(spark, sf_dir, own=bool(update))
        return (store.update(update) if update else store).query(sparql)

    run.__name__ = name
    query(oracle)(run)


files("files_star", "SELECT ?c ?name ?v { GRAPH ex:people { ?c ex:name ?name ; ex:balance ?b ; ex:inNation ?n } FILTER(?b > 5000) BIND(xsd:double(?b) AS ?v) }", f"SELECT '{DATA}Customer/' || c_custkey AS c, c_name AS name, c_acctbal AS v FROM customer WHERE c_acctbal > 5000")
files("files_across_graphs", "SELECT ?name (COUNT(?c) AS ?n) { GRAPH ex:people { ?c ex:inNation ?x } GRAPH ex:geo { ?x ex:partOf ?r . ?r ex:name ?name } } GROUP BY ?name", "SELECT r_name AS name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
files("files_any_graph", "SELECT ?g ?p (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g ?p", f"SELECT '{EX}geo' AS g, '{EX}name' AS p, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n UNION ALL SELECT '{EX}geo', '{EX}partOf', count(*) FROM nation UNION ALL SELECT '{EX}people', '{EX}' || unnest(['name', 'inNation', 'balance']), count(*) FROM customer")
files("files_provenance", "SELECT ?doc (COUNT(*) AS ?n) { GRAPH ex:people { ?c ex:inNation ?n . << ?c ex:inNation ?n >> ex:sourceDocument ?doc } } GROUP BY ?doc", f"SELECT '{DATA}Doc/' || (c_custkey % 10) AS doc, count(*) AS n FROM customer GROUP BY 1")
files(
    "files_update",
    "SELECT ?g ?p (COUNT(*) AS ?n) { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g ?p",
    f"""SELECT '{EX}people' AS g, '{EX}' || unnest(['name', 'balance']) AS p, count(*) AS n FROM customer UNION ALL SELECT '{EX}people', '{EX}inNation', count(*) FROM customer WHERE c_nationkey <> 3
    UNION ALL SELECT '{EX}derived', '{EX}inRegion', count(*) + 1 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 AND c_nationkey <> 3""",
    """DELETE WHERE { GRAPH ex:people { ?c ex:inNation <http://example.org/data/Nation/3> } } ;
       INSERT { GRAPH ex:derived { ?c ex:inRegion ?r } } WHERE { GRAPH ex:people { ?c ex:inNation ?n } GRAPH ex:geo { ?n ex:partOf ?r FILTER(?r != <http://example.org/data/Region/2>) } } ;
       INSERT DATA { GRAPH ex:derived { d:new ex:inRegion <http://example.org/data/Region/1> } } ; CLEAR GRAPH ex:geo""",
)


@query(f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer WHERE NOT (c_custkey % 3 = 1 AND c_custkey % 2 <> 0)")
def files_forget_run(spark, sf_dir):
    """Statements of one run alone go from their part; the version before still has them."""
    p = f"<{EX}indexingRun>"
    return on_disk(spark, sf_dir, own=True).without_document('"run1"', p, also=p).query("SELECT ?c { GRAPH ex:people { ?c ex:inNation ?n } }")


@query("SELECT count(*) AS before, count_if(c_nationkey <> 3) AS after FROM customer")
def files_versions(spark, sf_dir):
    """How many customers have a nation in the last version and in the one before."""
    store = on_disk(spark, sf_dir, own=True)
    store.update("DELETE WHERE { GRAPH ex:people { ?c ex:inNation <http://example.org/data/Nation/3> } }")
    counts = [StoredGraph.open(spark, store.path, v, prefixes=store.prefixes).query("SELECT (COUNT(?c) AS ?n) { GRAPH ex:people { ?c ex:inNation ?x } }").withColumnRenamed("n", n) for v, n in ((1, "before"), (2, "after"))]
    return counts[0].crossJoin(counts[1])  # one row each


# -- traversals
def _edges(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    a = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b"))
    return a.union(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))


@query(
    """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS a, 'c' || o_custkey AS b FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), x AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    h(node, hop) AS (SELECT 'c7', 0 UNION SELECT b, hop + 1 FROM h JOIN x ON a = node WHERE hop < 2) SELECT node, min(hop) AS hop FROM h GROUP BY 1"""
)
def kg_bfs_hops(spark, sf_dir):
    return graph.hops(_edges(spark, sf_dir), spark.createDataFrame([("c7",)], "node string"), 2)[0]


@query("WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), p(a, b) AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT a, b FROM p")
def kg_closure(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")

    def node(p, x):
        return F.concat(F.lit(p), F.col(x).cast("string"))

    return graph.reachable(n.select(node("n", "n_nationkey").alias("a"), node("r", "n_regionkey").alias("b")).union(c.select(node("c", "c_custkey"), node("n", "c_nationkey"))))


# -- rules
def _triples(spark, sf_dir):
    return stored(spark, sf_dir).quads.select("s", "p", "o")


def rule(name: str, text: str, predicate: str, oracle: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rules.derive(_triples(spark, sf_dir), rules.parse_rules(text, {"ex": EX, "d": DATA}).rules)
        return found.where(F.col("p") == f"<{EX}{predicate}>").select("s", "o")

    run.__name__ = name
    query(oracle)(run)


def _node(kind: str, col: str) -> str:
    return f"'<{DATA}{kind}/' || {col} || '>'"


rule("rules_transitive", "[t: (?a ex:partOf ?b), (?b ex:partOf ?c) -> (?a ex:partOf ?c)] [i: (?a ex:inNation ?n) -> (?a ex:partOf ?n)]", "partOf", f"SELECT {_node('Customer', 'c_custkey')} AS s, {_node('Nation', 'c_nationkey')} AS o FROM customer UNION ALL SELECT {_node('Customer', 'c_custkey')}, {_node('Region', 'n_regionkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey")
rule("rules_bridge", "[b: (?a ex:partOf ?r), (?b ex:partOf ?r), notEqual(?a, ?b) -> (?a ex:sibling ?b)]", "sibling", f"SELECT {_node('Nation', 'a.n_nationkey')} AS s, {_node('Nation', 'b.n_nationkey')} AS o FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey")
rule("rules_inverse", "[v: (?r ex:has ?n) <- (?n ex:partOf ?r)]", "has", f"SELECT {_node('Region', 'n_regionkey')} AS s, {_node('Nation', 'n_nationkey')} AS o FROM nation")
rule("rules_type", "[y: (?c ex:balance ?b), greaterThan(?b, 5000) -> (?c ex:kind d:Rich)]", "kind", f"SELECT {_node('Customer', 'c_custkey')} AS s, '<{DATA}Rich>' AS o FROM customer WHERE c_acctbal > 5000")
rule("rules_inherit", "[h: (?c ex:inNation ?n), (?n ex:partOf ?r) -> (?c ex:inRegion ?r)]", "inRegion", f"SELECT {_node('Customer', 'c_custkey')} AS s, {_node('Region', 'n_regionkey')} AS o FROM customer JOIN nation ON n_nationkey = c_nationkey")
rule("rules_variable_predicate", "[v: (?a ex:partOf ?r), (?r ?p ?o) -> (?a ?p ?o)]", "name", f"SELECT {_node('Nation', 'n_nationkey')} AS s, '\"' || r_name || '\"' AS o FROM nation JOIN region ON n_regionkey = r_regionkey")
rule("rules_two_joined", "[a: (?c ex:inNation ?n), (?d ex:inNation ?n), notEqual(?c, ?d), (?n ex:partOf ?r), (?c ex:balance ?x), lessThan(?x, -900), (?d ex:balance ?y), greaterThan(?y, 9800) -> (?c ex:owedBy ?d)]", "owedBy", f"SELECT {_node('Customer', 'c.c_custkey')} AS s, {_node('Customer', 'd.c_custkey')} AS o FROM customer c JOIN customer d USING (c_nationkey) WHERE c.c_custkey <> d.c_custkey AND c.c_acctbal < -900 AND d.c_acctbal > 9800")
rule("rules_symmetric", "[s: (?a ex:partOf ?b) -> (?a ex:near ?b)] [m: (?a ex:near ?b) -> (?b ex:near ?a)]", "near", f"SELECT {_node('Nation', 'n_nationkey')} AS s, {_node('Region', 'n_regionkey')} AS o FROM nation UNION ALL SELECT {_node('Region', 'n_regionkey')}, {_node('Nation', 'n_nationkey')} FROM nation")


_KEPT_RULES = """[t: (?a ex:within ?b), (?b ex:within ?c) -> (?a ex:within ?c)] [i: (?a ex:inNation ?n) -> (?a ex:within ?n)] [o: (?a ex:partOf ?n) -> (?a ex:within ?n)]
    [c: (?c ex:inNation ?n), (?n ex:partOf ?r), (?c ex:balance ?b), lessThan(?b, 0) -> (?r ex:owed d:Money)]"""


def _kept_up(spark: SparkSession, sf_dir: str) -> Materialized:
    """Deductions from all statements but a tenth of the customers, and then without the nations of one region and with these customers."""
    triples = _triples(spark, sf_dir)
    late = triples.where(F.col("s").rlike("Customer/[0-9]*7>$"))
    state = Materialized.of(triples.join(late, ["s", "p", "o"], "left_anti"), rules.parse_rules(_KEPT_RULES, {"ex": EX, "d": DATA}).rules)
    return state.changed(insert=late, delete=triples.where((F.col("p") == f"<{EX}partOf>") & (F.col("o") == f"<{DATA}Region/1>")))


@query(f"SELECT {_node('Customer', 'c_custkey')} AS s, {_node('Nation', 'c_nationkey')} AS o FROM customer UNION ALL SELECT {_node('Customer', 'c_custkey')}, {_node('Region', 'n_regionkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 UNION ALL SELECT {_node('Nation', 'n_nationkey')}, {_node('Region', 'n_regionkey')} FROM nation WHERE n_regionkey <> 1")
def incremental_closure(spark, sf_dir):
    """A recursive predicate after statements have come and gone."""
    return _kept_up(spark, sf_dir).derived.where(F.col("p") == f"<{EX}within>").select("s", "o")


@query(f"SELECT {_node('Region', 'n_regionkey')} AS s, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 1 AND c_acctbal < 0 GROUP BY 1")
def incremental_counts(spark, sf_dir):
    """How many solutions give a statement after the change."""
    layer = next(x for x in _kept_up(spark, sf_dir).layers if not x.recursive)
    return layer.known.select("s", "n")


def goal(name: str, text: str, sparql: str, oracle: str) -> None:
    """A query over statements and what rules derive for it alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _triples(spark, sf_dir)
        found = rules.inferred_for(base, rules.parse_rules(text, {"ex": EX, "d": DATA}).rules, parse(sparql, {"ex": EX, "d": DATA}))
        return QuadStore(base.union(found).select(F.lit("<g>").alias("g"), "s", "p", "o"), prefixes={"ex": EX, "d": DATA}, union_default=True).query(sparql)

    run.__name__ = name
    query(oracle)(run)


_PART_OF = "-> table(ex:partOf). [t: (?a ex:partOf ?b) <- (?a ex:partOf ?c), (?c ex:partOf ?b)] [i: (?a ex:partOf ?n) <- (?a ex:inNation ?n)]"
goal("goal_bound_subject", _PART_OF, f"SELECT ?x {{ <{DATA}Customer/7> ex:partOf ?x }}", f"SELECT '{DATA}Nation/' || c_nationkey AS x FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{DATA}Region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
goal("goal_bound_object", _PART_OF, f"SELECT ?x {{ ?x ex:partOf <{DATA}Region/2> }}", f"SELECT '{DATA}Customer/' || c_custkey AS x FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 UNION ALL SELECT '{DATA}Nation/' || n_nationkey FROM nation WHERE n_regionkey = 2")
goal("goal_bound_by_join", "[h: (?c ex:inRegion ?r) <- (?c ex:inNation ?n), (?n ex:partOf ?r)]", "SELECT ?c { ?r ex:name 'ASIA' . ?c ex:inRegion ?r }", f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")
goal("goal_sibling", "[b: (?a ex:sibling ?b) <- (?a ex:partOf ?r), (?b ex:partOf ?r), notEqual(?a, ?b)]", f"SELECT ?name {{ <{DATA}Nation/3> ex:sibling ?b . ?b ex:name ?name }}", "SELECT n_name AS name FROM nation WHERE n_nationkey <> 3 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)")
goal("goal_type", "-> table(ex:kind). [y: (?c ex:kind d:Rich) <- (?c ex:balance ?b), greaterThan(?b, 5000)] [z: (?c ex:kind d:Noted) <- (?c ex:kind d:Rich), (?c ex:inNation d:Three)] [w: (?c ex:kind d:Poor) <- (?c ex:balance ?b), lessThan(?b, 0)]", "SELECT ?c { ?c ex:kind d:Rich FILTER NOT EXISTS { ?c ex:kind d:Noted } }", f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer WHERE c_acctbal > 5000")
goal("goal_any_predicate", "[v: (?a ?p ?o) <- (?a ex:inNation ?r), (?r ?p ?o)]", f"SELECT ?p ?o {{ <{DATA}Customer/7> ?p ?o }}", f"SELECT '{EX}name' AS p, c_name AS o FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{EX}balance', c_acctbal::VARCHAR FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{EX}inNation', '{DATA}Nation/' || c_nationkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT '{EX}name', n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7 UNION ALL SELECT '{EX}partOf', '{DATA}Region/' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")


@query(f"SELECT '{DATA}Region/' || n_regionkey AS r, '{DATA}Nation/' || n_nationkey AS n FROM nation")
def rules_playground_diff(spark, sf_dir):
    found = rules.playground(stored(spark, sf_dir), EX + "geo", "[v: (?r ex:has ?n) <- (?n ex:partOf ?r)]", "SELECT ?r ?n { GRAPH ?g { ?r ex:has ?n } }")
    return found["added"]


# -- identity and entity resolution
def _same_names(spark, sf_dir):
    """Edges from each part to the least part of equal name, and their components."""
    p = table(spark, sf_dir, "part").select("p_partkey", X.label_key(F.col("p_name")).alias("k"))
    least = p.groupBy("k").agg(F.min("p_partkey").alias("b"))
    edges = p.join(least, "k").where("p_partkey <> b").select(F.col("p_partkey").alias("a"), "b")
    return edges, connected_components(edges).select("root", "node")


_NAMES = "k AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part), m AS (SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY k) AS root, count(*) OVER (PARTITION BY k) AS n FROM k)"


@query(f"WITH {_NAMES} SELECT node, root FROM m WHERE n > 1")
def same_as_components(spark, sf_dir):
    return _same_names(spark, sf_dir)[1]


@query(f"WITH {_NAMES} SELECT node, root FROM m WHERE n > 1")
def same_as_added(spark, sf_dir):
    """Components of half the edges, and then of all by what the other half joins."""
    edges, _ = _same_names(spark, sf_dir)
    first, rest = edges.where("a % 2 = 0"), edges.where("a % 2 <> 0")
    return merged(connected_components(first), rest).select("node", "root")


@query("WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part), e AS (SELECT p_partkey AS a, min(p_partkey) OVER (PARTITION BY k) AS b FROM k), l AS (SELECT a, b FROM e WHERE a <> b AND a % 5 <> 0), g AS (SELECT b, a FROM l UNION SELECT b, b FROM l) SELECT a AS node, b AS root FROM g")
def same_as_removed(spark, sf_dir):
    """Components once a fifth of the edges are gone, of the clusters that had them alone."""
    edges, members = _same_names(spark, sf_dir)
    return parted(members, edges.where("a % 5 <> 0"), edges.where("a % 5 = 0")).select("node", "root")


@query(f"WITH {_NAMES}, b AS (SELECT DISTINCT root, p_brand FROM m JOIN part ON p_partkey = node WHERE n > 1) SELECT node AS s, p_brand AS o FROM m JOIN b USING (root) EXCEPT SELECT p_partkey, p_brand FROM part")
def same_as_closure(spark, sf_dir):
    """(s, o): the brands that parts get from parts of equal name."""
    _, members = _same_names(spark, sf_dir)
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("s"), F.lit("brand").alias("p"), F.col("p_brand").alias("o"))
    text = members.select(F.col("root").cast("string").alias("root"), F.col("node").cast("string").alias("node"))
    return graph.same_as(brands, text, "sameAs").where("p = 'brand'").select(F.col("s").cast("long").alias("s"), "o")


@query(f"WITH {_NAMES} SELECT root, root AS node, n - 1 AS indegree FROM m WHERE n > 1 GROUP BY root, n")
def canonical_election(spark, sf_dir):
    edges, members = _same_names(spark, sf_dir)
    return graph.elect(edges, members)


@query(f"WITH {_NAMES}, c AS (SELECT root, n, count_if(node % 7 = 0) AS marks, min(CASE WHEN node % 7 = 0 THEN node END) AS e FROM m WHERE n > 1 GROUP BY root, n) SELECT root, CASE WHEN marks = 1 THEN e ELSE root END AS canonical, CASE WHEN marks = 1 THEN 'graph' WHEN marks > 1 THEN 'conflict' ELSE 'derived' END AS status, n AS size FROM c")
def canonical_status(spark, sf_dir):
    edges, members = _same_names(spark, sf_dir)
    marked = members.where("node % 7 = 0").select("node")
    return graph.status(members, graph.elect(edges, members), marked)


@query("WITH k AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part) SELECT a.k AS key_a, b.k AS key_b FROM k a JOIN k b ON a.k < b.k WHERE jaro_winkler_similarity(a.k, b.k) >= 0.92")
def er_exact_and_high(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("label"))
    return entities.alike(p, p, entities.HIGH).where("key_a < key_b").select("key_a", "key_b")


def _scored_sql(pairs: str) -> str:
    """CTEs that end in `scored` (a, b, score): Jaro-Winkler of the pairs (a, b) character by character, as the built-in one rounds half transpositions down and counts a common head from 0.7 on only."""
    head = " ".join(f"WHEN left(a, {k}) = left(b, {k}) THEN {k}" for k in (4, 3, 2, 1))
    return f"""asked AS (SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> b AND a <> '' AND b <> ''),
    steps(a, b, i, used, x) AS (SELECT a, b, 0, []::BIGINT[], '' FROM asked UNION ALL
        SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, CASE WHEN j IS NULL THEN x ELSE x || substr(a, i + 1, 1) END FROM (
            SELECT *, list_min([y FOR y IN range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1) IF substr(b, y, 1) = substr(a, i + 1, 1) AND NOT list_contains(used, y)]) AS j
            FROM (SELECT *, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach FROM steps WHERE i < length(a)))),
    ended AS (SELECT a, b, x, array_to_string([substr(b, y, 1) FOR y IN list_sort(used)], '') AS y, length(x)::DOUBLE AS m FROM steps WHERE i = length(a)),
    jaro AS (SELECT a, b, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) + (m - len([k FOR k IN range(1, length(x) + 1) IF substr(x, k, 1) <> substr(y, k, 1)]) / 2.0::DOUBLE) / m) / 3 END AS j FROM ended),
    scored AS (SELECT a, b, CASE WHEN j = 0 THEN 0 ELSE j + 0.1::DOUBLE * (CASE {head} ELSE 0 END) * (1 - j) END AS score FROM jaro)"""


_TITLES = r"k AS (SELECT DISTINCT trim(regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[^a-z0-9]+', ' ', 'g')) AS k FROM pages)"


# No score is above the built-in one from 0.85 on, so that chooses the pairs.
@query(f"WITH RECURSIVE {_TITLES}, {_scored_sql('SELECT x.k AS a, y.k AS b FROM k x JOIN k y ON x.k < y.k WHERE jaro_winkler_similarity(x.k, y.k) >= 0.92')} SELECT a AS key_a, b AS key_b FROM scored WHERE score >= 0.92")
def er_page_titles(spark, sf_dir):
    """Titles of pages, of which there are more the more pages, that are nearly the same."""
    t = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("label"))
    return entities.alike(t, t, entities.HIGH).where("key_a < key_b").select("key_a", "key_b")


@query(f"WITH RECURSIVE {_TITLES}, l AS (SELECT DISTINCT trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS l FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark)), {_scored_sql('SELECT k AS a, l AS b FROM k JOIN l ON jaro_winkler_similarity(k, l) >= 0.85')} SELECT a AS key_a, b AS key_b FROM scored WHERE score >= 0.85")
def er_titles_and_lines(spark, sf_dir):
    """Titles against the lines of benchmark items."""
    t = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("label"))
    lines = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\n")).alias("label"))
    return entities.alike(t, lines, 0.85).select("key_a", "key_b")


@query(
    f"""WITH RECURSIVE k AS (SELECT p_partkey::VARCHAR AS iri, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS key, p_partkey % 20 = 0 AS fresh FROM part),
    n AS (SELECT iri, key FROM k WHERE fresh AND key <> ''), o AS (SELECT iri, key FROM k WHERE NOT fresh AND key <> ''),
    {_scored_sql('SELECT x.key AS a, y.key AS b FROM (SELECT DISTINCT key FROM n) x, (SELECT DISTINCT key FROM k) y')},
    inside AS (SELECT x.iri, y.iri AS other, coalesce(score, 1) AS score FROM n x JOIN n y ON x.iri < y.iri LEFT JOIN scored ON a = x.key AND b = y.key WHERE coalesce(score, 1) >= 0.92),
    q AS (SELECT iri, unnest(list_distinct(string_split(key, ' '))) AS word FROM n), d AS (SELECT iri AS other, unnest(list_distinct(string_split(key, ' '))) AS word FROM o),
    f AS (SELECT word, ln(1 + (SELECT count(*) FROM o) / count(*)::DOUBLE) AS weight FROM d GROUP BY word),
    s AS (SELECT iri, other, round(sum(weight), 6) AS weight FROM q JOIN d USING (word) JOIN f USING (word) GROUP BY iri, other),
    best AS (SELECT iri, other FROM (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY weight DESC, other) AS r FROM s) WHERE r <= 100),
    outside AS (SELECT x.iri, y.iri AS other, coalesce(score, 1) AS score FROM best JOIN n x ON x.iri = best.iri JOIN o y ON y.iri = other LEFT JOIN scored ON a = x.key AND b = y.key),
    pairs AS (SELECT * FROM inside UNION SELECT * FROM outside WHERE score >= 0.75)
    SELECT (SELECT count(*) FROM k WHERE fresh) AS total, count_if(score = 1) AS exact, count_if(score >= 0.92 AND score < 1) AS high, count_if(score < 0.92) AS judge,
    (SELECT count(*) FROM k WHERE fresh AND iri NOT IN (SELECT iri FROM pairs UNION SELECT other FROM pairs)) AS no_candidate FROM pairs"""
)
def er_bands_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("iri"), F.col("p_name").alias("label"), "p_partkey")
    new, known = p.where("p_partkey % 20 = 0").drop("p_partkey"), p.where("p_partkey % 20 <> 0").drop("p_partkey")
    return entities.telemetry(new, entities.resolve(new, known, 100))


@query(
    """WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) AS word FROM benchmark),
    d AS (SELECT doc_id AS id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) AS word FROM documents),
    f AS (SELECT word, ln(1 + (SELECT count(*) FROM documents) / count(*)::DOUBLE) AS weight FROM d GROUP BY 1),
    s AS (SELECT query_id, id, round(sum(weight), 6) AS score FROM q JOIN d USING (word) JOIN f USING (word) WHERE word <> '' GROUP BY 1, 2)
    SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 100"""
)
def er_topk_blocking(spark, sf_dir):
    return entities.top_candidates(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("label")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("label")))


# -- ingestion
@query("SELECT doc_id, ((i - 1) // 1)::INT AS chunk_no, md5(substr(text, (i - 1) * 15900 + 1, 16000)) AS h FROM (SELECT doc_id, text, unnest(range(1, (length(text) - 1) // 15900 + 2)) AS i FROM documents WHERE length(text) > 0)")
def ingest_chunk(spark, sf_dir):
    return X.chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_no", F.md5("chunk").alias("h"))


@query("SELECT p_partkey, 'http://example.org/entity/parts/' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || substr(md5('parts:' || p_brand || ':' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-')), 1, 8) AS iri, substr(sha256('parts||' || p_name || '|u' || p_partkey), 1, 32) AS doc_key FROM part")
def ingest_identity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    url = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    return p.select("p_partkey", X.entity_iri("http://example.org", "parts", F.col("p_brand"), F.col("p_name")).alias("iri"), X.document_key(F.lit("parts"), F.lit(None).cast("string"), F.col("p_name"), url).alias("doc_key"))


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_ FROM conversations")
def ingest_merge_offsets(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return X.shifted(c, "conv_id", "turn", "n").select("conv_id", "turn", F.col("offset").cast("long").alias("offset_"))


@query(f"SELECT conv_id, turn, CASE role WHEN 'user' THEN '{EX}Person' ELSE '{EX}' || CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE trim(regexp_replace(trim(role), '[^A-Za-z0-9_-]+', '-', 'g'), '-') END END AS iri FROM conversations")
def ingest_assert_open_world(spark, sf_dir):
    names = spark.createDataFrame([("user", EX + "Person")], "local string, iri string")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return ingest.resolve_name(c, "role", names, EX).select("conv_id", "turn", F.col("role_iri").alias("iri"))


@query("WITH f AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS till FROM events) SELECT event_id, user_id FROM f WHERE ts <= (SELECT min(ts) + INTERVAL 5 DAY FROM events) AND (till IS NULL OR (SELECT min(ts) + INTERVAL 5 DAY FROM events) < till)")
def bitemporal_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    facts = e.select("event_id", "user_id", F.col("ts").alias("valid_from"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("valid_to"))
    at = e.agg((F.min("ts") + F.expr("INTERVAL 5 DAY")).alias("at"))
    return ingest.valid_at(facts.crossJoin(F.broadcast(at)), F.col("at")).select("event_id", "user_id")  # one row


# -- SQL
def sql(name: str, text: str, oracle: str | None = None, args: dict | None = None, limit: int | None = 500) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return X.guarded(spark, text, limit, args)

    run.__name__ = name
    query(oracle or text)(run)


sql("sql_guard_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
sql("sql_param_template", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = @status AND o_totalprice > @low GROUP BY 1", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY 1", {"status": "F", "low": 1000})
sql("sql_semi_on", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", limit=None)
sql("sql_anti_not_in", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", limit=None)
sql("sql_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql(
    "sql_self_join_gap",
    "SELECT a.l_linestatus AS status, round(a.avg_q - b.avg_q, 6) AS gap FROM (SELECT l_linestatus, avg(l_quantity) AS avg_q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_linestatus, avg(l_quantity) AS avg_q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON a.l_linestatus = b.l_linestatus",
)
sql("sql_conditional_aggs", "SELECT o_orderpriority AS p, count_if(o_orderstatus = 'F') AS closed, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS large, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS open_avg FROM orders GROUP BY 1")
sql("sql_two_level_avg", "SELECT round(avg(s), 4) AS a FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey)")
sql("sql_nullif_ratio", "SELECT l_returnflag AS f, round(max(l_extendedprice) / NULLIF(avg(l_extendedprice), 0), 6) AS r, count(DISTINCT l_suppkey) AS suppliers FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1")
sql("sql_derived_key_join", "SELECT s_name, c_name FROM supplier JOIN customer ON right(s_name, 6) = right(c_name, 6) AND lpad(CAST(s_suppkey AS STRING), 4, '0') = lpad(CAST(c_custkey AS STRING), 4, '0')", "SELECT s_name, c_name FROM supplier JOIN customer ON right(s_name, 6) = right(c_name, 6) AND lpad(s_suppkey::VARCHAR, 4, '0') = lpad(c_custkey::VARCHAR, 4, '0')", limit=None)
sql(
    "sql_inline_lookup",
    "SELECT n.n_name AS nation, v.code, count(*) AS customers FROM (VALUES ('NATION_1', 'N1'), ('NATION_7', 'N7'), ('NATION_12', 'N12')) AS v(name, code) JOIN nation n ON n.n_name = v.name JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2",
)
sql("sql_like_in_null", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_type LIKE '%ECON%' AND p_size NOT IN (1, 2) AND p_name IS NOT NULL GROUP BY 1")
sql("sql_dirty_cast", "SELECT sum(try_cast(substr(c_mktsegment, 1, 1) AS INT)) AS s, count_if(try_cast(right(c_name, 4) AS INT) > 50) AS n FROM customer", "SELECT sum(try_cast(substr(c_mktsegment, 1, 1) AS INT))::BIGINT AS s, count_if(try_cast(right(c_name, 4) AS INT) > 50)::BIGINT AS n FROM customer")


# -- search, links, streams
def _bm25(*words: str) -> str:
    """SQL of the twenty best documents for some words."""
    counts = ", ".join(f"len([x FOR x IN w IF x = '{w}']) AS c{i}" for i, w in enumerate(words))
    having = ", ".join(f"count_if(c{i} > 0) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (d - d{i} + 0.5) / (d{i} + 0.5)) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * n / m))" for i in range(len(words)))
    return rf"""WITH w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+') IF x <> ''] AS w FROM documents),
    t AS (SELECT doc_id, len(w) AS n, {counts} FROM w), s AS (SELECT count(*) AS d, avg(n) AS m, {having} FROM t)
    SELECT doc_id, score FROM (SELECT doc_id, CASE WHEN n > 0 THEN round({score}, 6) ELSE 0 END AS score FROM t, s) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query(_bm25("license", "version", "für"))
def text_search_index(spark, sf_dir):
    return search.TextIndex(table(spark, sf_dir, "documents").select("doc_id", "text")).search("License, version für")


@query(_bm25("license", "version"))
def text_search(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "license version")


@query("WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, similarity FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q) ORDER BY similarity DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return search.nearest(v, v.orderBy("vec_id").first().embedding)


def _canonical(x: str) -> str:
    """SQL of a URL's canonical form."""
    parts = "'(?i)^([a-z][a-z0-9+.-]*)://([^/?]*)([^?]*)([?].*)?$'"
    bare = f"regexp_replace({x}, '#.*$', '')"
    at = lambda i: f"regexp_extract({bare}, {parts}, {i})"
    path = f"regexp_replace({at(3)}, '/{{2,}}', '/', 'g')"
    return f"CASE WHEN regexp_matches({bare}, {parts}) THEN lower({at(1)}) || '://' || lower({at(2)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {at(4)} ELSE {bare} END"


_LINKS = rf"""found AS (SELECT url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS host, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1) AS folder,
    unnest(list_distinct(list_concat(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#][^"'']*)["'']', 1), regexp_extract_all(html, '["''](https?://[^"''<> ]+)["'']', 1)))) AS x FROM pages),
whole AS (SELECT url, CASE WHEN regexp_matches(x, '(?i)^[a-z][a-z0-9+.-]*:') THEN x WHEN x LIKE '/%' THEN host || x ELSE folder || x END AS y FROM found),
links AS (SELECT DISTINCT url AS page_url, {_canonical("y")} AS link FROM whole WHERE regexp_matches({_canonical("y")}, '^https?://'))"""


@query(f"WITH {_LINKS} SELECT page_url, link FROM links")
def crawl_links(spark, sf_dir):
    return X.links(table(spark, sf_dir, "pages"))


@query(
    f"""WITH {_LINKS}, seeds AS (SELECT DISTINCT {_canonical("url")} AS url FROM pages WHERE url IS NOT NULL), hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM seeds),
    reached AS (SELECT url, 0 AS depth FROM seeds UNION SELECT link, 1 FROM links JOIN hosts ON host = regexp_extract(link, '^[a-z]+://([^/?#]*)', 1))
    SELECT url, min(depth) AS depth, regexp_matches(regexp_replace(url, '[?#].*$', ''), '(?i)[.]pdf$') AS is_pdf FROM reached GROUP BY url"""
)
def crawl_frontier(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return crawl.frontier(pages, pages, crawl.Bounds(depth=1))


@query("SELECT method, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS method FROM part) GROUP BY 1")
def norm_methods(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return graph.method_counts(p.select("p_partkey"), p.select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("|")).alias("method")), ["p_partkey"])


@query("SELECT o_orderkey, regexp_replace(regexp_replace(o_totalprice::DECIMAL(18, 2)::VARCHAR, '0+$', ''), '[.]$', '') AS total, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS day FROM orders")
def value_canonical(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", X.canonical_value(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"), X.canonical_value(F.col("o_orderdate")).alias("day"))


@query("SELECT page_id, lower(regexp_extract(url, '(?i)^[a-z]+://([^/?#]*)', 1)) AS host, TRY_CAST(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/]*', ''), '/((?:19|20)[0-9][0-9])(/|\\?|$)', 1) AS INT) AS year FROM pages")
def crawl_url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    u = X.canonical_url(F.col("url"))
    return p.select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#]*)", 1).alias("host"), X.url_year(u).alias("year"))


kg(
    "kg_both_directions",
    "SELECT ?p ?x { GRAPH ex:geo { { <http://example.org/data/Region/2> ?p ?x } UNION { ?x ?p <http://example.org/data/Region/2> } } FILTER(?p != ex:name) }",
    f"SELECT '{EX}partOf' AS p, '{DATA}Nation/' || n_nationkey AS x FROM nation WHERE n_regionkey = 2",
)
kg("kg_order_by_cast", "SELECT ?c { GRAPH ex:people { ?c ex:balance ?b } } ORDER BY DESC(xsd:double(?b)) ?c LIMIT 10", f"SELECT '{DATA}Customer/' || c_custkey AS c FROM customer ORDER BY c_acctbal DESC, 1 LIMIT 10")


@query(
    f"""WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT count(*) AS n FROM c)
    SELECT * FROM (VALUES ('has'), ('label'), ('slug'), ('type'), ('size')) v(p), LATERAL (SELECT CASE p WHEN 'has' THEN n WHEN 'size' THEN n ELSE n + 1 END AS n FROM n) x"""
)
def ingest_statements(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    conv = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    none = F.lit(None).cast("string")
    rows = c.select(
        F.concat(F.lit(DATA + "Doc/"), conv).alias("document"), F.lit("run1").alias("run"), F.lit("2020-01-01T00:00:00").alias("extracted_at"), F.lit("test").alias("method"), F.lit("2020-01-01T00:00:00").alias("now"),
        F.array(
            F.struct(F.concat(F.lit("Turn "), conv).alias("label"), F.lit("Turn").alias("type"), none.alias("description"), F.array(F.struct(F.lit("size").alias("predicate"), conv.alias("value"))).alias("attributes")),
            F.struct(F.lit("The User").alias("label"), F.lit("Person").alias("type"), none.alias("description"), F.array().cast("array<struct<predicate:string,value:string>>").alias("attributes")),
        ).cast(ingest.ENTITIES).alias("entities"),
        F.array(*(F.struct(F.lit(i).alias("subjectId"), F.lit("has").alias("predicate"), F.lit(1).alias("objectId"), none.alias("objectLiteral"), F.lit(False).alias("objectIsLiteral"), F.lit(0.9).alias("confidence")) for i in (0, 5))).cast(ingest.LINKS).alias("relationships"),
    )
    names = spark.createDataFrame([("Person", EX + "Person")], "local string, iri string")
    quads, _ = ingest.statements(rows, names, EX + "asserted", DATA.rstrip("/"), "talk", EX)
    return quads.groupBy(F.regexp_extract("p", r"([^#/]*)>$", 1).alias("p")).agg(F.count("*").alias("n"))


@query(f"WITH {_NAMES} SELECT n AS size, n - 1 AS edges, count(*) AS clusters FROM (SELECT DISTINCT root, n FROM m WHERE n > 1) GROUP BY 1, 2")
def norm_summary(spark, sf_dir):
    edges, members = _same_names(spark, sf_dir)
    sized = members.groupBy("root").agg(F.count("*").alias("size"))
    n = edges.join(members, edges["a"] == members["node"]).groupBy("root").agg(F.count("*").alias("edges"))
    return sized.join(n, "root").groupBy("size", "edges").agg(F.count("*").alias("clusters"))
