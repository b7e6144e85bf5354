"""An insurance schema behind mappings: 44 questions in SPARQL, each against SQL over the same tables.

A question is made of parts. Each part has a pattern over the mapped graph and,
written separately, the tables and conditions that say the same in SQL.
"""

import datetime
import random
import re
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from quadrille.functions import text as X
from quadrille.operators.vkg import VirtualGraph
from quadrille.plans.sqltext import DIALECTS, SqlTextError, SqlWriter, rewrite_tables
from quadrille.sources.mapping import from_r2rml, parse_mappings
from quadrille.sources.turtle import read_turtle

TABLES = {
    "catastrophe": "catastrophe_identifier int, catastrophe_name string",
    "policy": "policy_identifier int, policy_number string, effective_date timestamp, expiration_date timestamp",
    "claim": "claim_identifier int, company_claim_number string, claim_open_date timestamp, claim_close_date timestamp, catastrophe_identifier int",
    "policy_coverage_detail": "policy_coverage_detail_identifier bigint, policy_identifier int, effective_date timestamp, expiration_date timestamp",
    "claim_coverage": "claim_identifier int, policy_coverage_detail_identifier bigint",
    "policy_amount": "policy_amount_identifier int, policy_coverage_detail_identifier bigint, policy_amount decimal(15,2)",
    "premium": "policy_amount_identifier int",
    "claim_amount": "claim_amount_identifier int, claim_identifier int, claim_amount decimal(15,2)",
    "loss_payment": "claim_amount_identifier int",
    "loss_reserve": "claim_amount_identifier int",
    "expense_payment": "claim_amount_identifier int",
    "expense_reserve": "claim_amount_identifier int",
    "agreement_party_role": "agreement_identifier int, party_identifier int, party_role_code string",
}
KINDS = ("loss_payment", "loss_reserve", "expense_payment", "expense_reserve")


def rows():
    """Open claims, a claim closed at noon on the last day of 2019, claims without catastrophe, several payments, coverages without claims, amounts that are no premium."""
    r, day = random.Random(3), datetime.datetime(2018, 1, 1)
    at = lambda n: day + datetime.timedelta(days=n)
    out = {t: [] for t in TABLES}
    out["catastrophe"] = [(i, f"Storm {i}") for i in range(4)]
    for p in range(25):
        out["policy"].append((p, f"P{p:03}", at(p), at(p + 365)))
        out["agreement_party_role"] += [(p, 100 + p % 6, "AG"), (p, 200 + p % 15, "PH"), (p, 300, "UW")]
    for v in range(40):
        out["policy_coverage_detail"].append((v, v % 25, at(v), at(v + 300)))
        for _ in range(r.randrange(3)):
            n = len(out["policy_amount"])
            out["policy_amount"].append((n, v, Decimal(r.randrange(10000, 99999)) / 100))
            if r.random() < 0.8:
                out["premium"].append((n,))
    for c in range(60):
        close = None if c % 7 == 0 else datetime.datetime(2019, 12, 31, 12) if c == 1 else at(400 + 9 * c)
        out["claim"].append((c, f"C{c:03}", at(300 + c), close, None if c % 5 == 0 else c % 4))
        out["claim_coverage"] += [(c, v) for v in r.sample(range(35), 1 + (c % 9 == 0))]
        for kind in KINDS:
            for _ in range(r.choice((0, 1, 1, 1, 2)) if c != 1 else 2):
                n = len(out["claim_amount"])
                out["claim_amount"].append((n, c, Decimal(r.randrange(1000, 500000)) / 100))
                out[kind].append((n,))
    return out


def mapping(name, target, source):
    return f"mappingId {name}\ntarget {target} .\nsource {source}\n"


def amount(kind):
    """The amounts of one kind, and which claim has them."""
    of = f"FROM ins_{kind} k JOIN ins_claim_amount a ON a.claim_amount_identifier = k.claim_amount_identifier"
    return mapping(kind, f":{kind}/{{id}} a ex:{kind} ; ex:{kind}Amount {{amount}}^^xsd:decimal", f"SELECT k.claim_amount_identifier AS id, a.claim_amount AS amount {of}") + "\n" + mapping(
        f"claim-{kind}", f":Claim/{{claim}} ex:has_{kind} :{kind}/{{id}}", f"SELECT a.claim_identifier AS claim, k.claim_amount_identifier AS id {of}"
    )


MAPPINGS = "[PrefixDeclaration]\n:\thttp://t/insurance/\nex:\thttp://t/o#\nxsd:\thttp://www.w3.org/2001/XMLSchema#\n\n[MappingDeclaration] @collection [[\n\n" + "\n".join(
    [
        mapping("Policy", ":Policy/{policy_identifier} a ex:Policy ; ex:policyNumber {policy_number}^^xsd:string ; ex:policyStart {effective_date}^^xsd:dateTime ; ex:policyEnd {expiration_date}^^xsd:dateTime", "SELECT policy_identifier, policy_number, effective_date, expiration_date FROM ins_policy"),
        mapping("Claim", ":Claim/{claim_identifier} a ex:Claim ; ex:claimNumber {company_claim_number}^^xsd:string ; ex:opened {claim_open_date}^^xsd:dateTime ; ex:closed {claim_close_date}^^xsd:dateTime", "SELECT claim_identifier, company_claim_number, claim_open_date, claim_close_date FROM ins_claim"),
        mapping("Catastrophe", ":Catastrophe/{catastrophe_identifier} a ex:Catastrophe ; ex:catastropheName {catastrophe_name}^^xsd:string", "SELECT catastrophe_identifier, catastrophe_name FROM ins_catastrophe"),
        mapping("Coverage", ":Coverage/{policy_coverage_detail_identifier} a ex:Coverage ; ex:coverageStart {effective_date}^^xsd:dateTime ; ex:coverageEnd {expiration_date}^^xsd:dateTime", "SELECT policy_coverage_detail_identifier, effective_date, expiration_date FROM ins_policy_coverage_detail"),
        mapping("Premium", ":Premium/{id} a ex:Premium ; ex:premiumAmount {amount}^^xsd:decimal", "SELECT r.policy_amount_identifier AS id, a.policy_amount AS amount FROM ins_premium r JOIN ins_policy_amount a ON a.policy_amount_identifier = r.policy_amount_identifier"),
        mapping("Coverage-premium", ":Coverage/{coverage} ex:hasPremium :Premium/{id}", "SELECT a.policy_coverage_detail_identifier AS coverage, r.policy_amount_identifier AS id FROM ins_premium r JOIN ins_policy_amount a ON a.policy_amount_identifier = r.policy_amount_identifier"),
        mapping("Coverage-policy", ":Coverage/{coverage} ex:ofPolicy :Policy/{policy}", "SELECT policy_coverage_detail_identifier AS coverage, policy_identifier AS policy FROM ins_policy_coverage_detail"),
        mapping("Claim-coverage", ":Claim/{claim} ex:against :Coverage/{coverage}", "SELECT claim_identifier AS claim, policy_coverage_detail_identifier AS coverage FROM ins_claim_coverage"),
        mapping("Claim-catastrophe", ":Claim/{claim} ex:causedBy :Catastrophe/{cause}", "SELECT claim_identifier AS claim, catastrophe_identifier AS cause FROM ins_claim WHERE catastrophe_identifier IS NOT NULL"),
        *(
            mapping(kind, f":{kind}/{{id}} a ex:{kind} ; ex:{kind}Id {{id}}^^xsd:string", f"SELECT CAST(party_identifier AS STRING) AS id FROM ins_agreement_party_role WHERE party_role_code = '{code}'")
            + "\n"
            + mapping(f"Policy-{kind}", f":Policy/{{policy}} ex:has{kind} :{kind}/{{id}}", f"SELECT agreement_identifier AS policy, CAST(party_identifier AS STRING) AS id FROM ins_agreement_party_role WHERE party_role_code = '{code}'")
            for kind, code in (("Agent", "AG"), ("Holder", "PH"))
        ),
        *map(amount, KINDS),
    ]
) + "\n]]\n"

#: Pattern, and the joins that say the same. A claim's parts come after its coverage, a coverage's after its policy.
PARTS = {
    "policy": ("?p a ex:Policy ; ex:policyNumber ?policy .", "policy p"),
    "period": ("?p ex:policyStart ?start ; ex:policyEnd ?end .", None),
    "agent": ("?p ex:hasAgent [ ex:AgentId ?agent ] .", "agreement_party_role ag ON ag.agreement_identifier = p.policy_identifier AND ag.party_role_code = 'AG'"),
    "holder": ("?p ex:hasHolder [ ex:HolderId ?holder ] .", "agreement_party_role ph ON ph.agreement_identifier = p.policy_identifier AND ph.party_role_code = 'PH'"),
    "coverage": ("?v a ex:Coverage ; ex:ofPolicy ?p .", "policy_coverage_detail v USING (policy_identifier)"),
    "covered": ("?v ex:coverageStart ?from ; ex:coverageEnd ?to .", None),
    "premium": ("?v ex:hasPremium [ ex:premiumAmount ?premium ] .", "policy_amount pa USING (policy_coverage_detail_identifier) JOIN premium pr USING (policy_amount_identifier)"),
    "claim": ("?c ex:against ?v ; ex:claimNumber ?claim .", "claim_coverage cc USING (policy_coverage_detail_identifier) JOIN claim c USING (claim_identifier)"),
    "claims": ("?c a ex:Claim ; ex:claimNumber ?claim .", "claim c"),
    "dates": ("?c ex:opened ?opened ; ex:closed ?closed .", None),
    "cause": ("?c ex:causedBy [ ex:catastropheName ?cause ] .", "catastrophe k ON k.catastrophe_identifier = c.catastrophe_identifier"),
    **{k: (f"?c ex:has_{k} [ ex:{k}Amount ?{k} ] .", f"{k} x_{k} ON true JOIN claim_amount a_{k} ON a_{k}.claim_amount_identifier = x_{k}.claim_amount_identifier AND a_{k}.claim_identifier = c.claim_identifier") for k in KINDS},
}
COLUMNS = {
    "policy": "p.policy_number", "start": "p.effective_date", "end": "p.expiration_date", "agent": "ag.party_identifier::VARCHAR", "holder": "ph.party_identifier::VARCHAR", "from": "v.effective_date", "to": "v.expiration_date",
    "premium": "pa.policy_amount", "claim": "c.company_claim_number", "opened": "c.claim_open_date", "closed": "c.claim_close_date", "cause": "k.catastrophe_name", **{k: f"a_{k}.claim_amount" for k in KINDS},
}
LOSS, LOSS_SQL = " + ".join(f"?{k}" for k in KINDS), " + ".join(f"a_{k}.claim_amount" for k in KINDS)
ALL = " ".join(KINDS)
#: Parts, columns, and aggregates (name: SPARQL over ?total or a part's variable, SQL).
TOTAL = {"total": (f"SUM({LOSS})", f"sum({LOSS_SQL})")}
MEAN = {"mean": (f"AVG({LOSS})", f"avg({LOSS_SQL})")}
PAID = {"paid": ("SUM(?premium)", "sum(pa.policy_amount)")}
COUNT = {"n": ("COUNT(?claim)", "count(c.company_claim_number)")}
QUESTIONS = [
    ("policy", "", {"n": ("COUNT(?p)", "count(p.policy_identifier)")}), ("claims", "", {"n": ("COUNT(?c)", "count(*)")}), ("policy period", "policy start end", {}), ("claims dates", "claim opened closed", {}),
    *((f"claims {k}", f"claim {k}", {}) for k in KINDS), (f"claims {ALL}", f"claim {ALL}", {}),
    ("policy agent", "policy agent", {}), ("policy holder", "policy holder", {}), ("policy agent", "agent", {"n": ("COUNT(?p)", "count(*)")}), ("policy holder", "holder", {"n": ("COUNT(?p)", "count(*)")}),
    ("policy coverage claim", "policy claim", {}), ("policy coverage claim", "policy", COUNT), ("policy coverage claim cause", "policy claim cause", {}), ("policy holder coverage claim cause", "holder claim cause", {}), ("policy agent coverage claim cause", "agent policy claim cause", {}),
    ("policy coverage premium", "policy premium", {}), ("policy coverage covered premium", "policy premium from to", {}), ("policy coverage premium", "policy", PAID), ("policy holder coverage premium", "holder policy", PAID), ("policy holder coverage premium", "holder premium", {}),
    ("policy coverage premium", "", {"size": ("SUM(?premium) / COUNT(DISTINCT ?p)", "sum(pa.policy_amount) / count(DISTINCT p.policy_identifier)")}),
    *((f"policy agent coverage claim {k}", f"agent policy claim {k}", {}) for k in KINDS),
    ("claims loss_payment loss_reserve", "claim", {"total": ("SUM(?loss_payment + ?loss_reserve)", "sum(a_loss_payment.claim_amount + a_loss_reserve.claim_amount)")}),
    (f"claims {ALL}", "claim", TOTAL), (f"policy coverage claim {ALL}", "policy", TOTAL), (f"policy coverage claim {ALL}", "policy", MEAN), (f"policy coverage claim {ALL}", "policy", MEAN | COUNT), (f"policy agent coverage claim {ALL}", "agent policy", TOTAL),
    (f"policy coverage claim cause {ALL}", "cause policy", TOTAL), (f"policy coverage claim cause {ALL}", "claim cause policy", TOTAL),
    (f"policy holder coverage premium claim {ALL}", f"claim policy holder premium {ALL}", {}), (f"policy holder coverage premium claim cause {ALL}", f"claim policy holder premium cause {ALL}", {}), (f"policy agent holder coverage premium claim cause {ALL}", f"agent holder policy premium cause claim {ALL}", {}),
    (f"policy holder coverage premium claim {ALL}", "claim policy holder premium", TOTAL),
    (f"policy agent coverage premium claim {ALL}", "policy agent premium", {"ratio": (f"SUM({LOSS}) / ?premium", f"sum({LOSS_SQL}) / pa.policy_amount")}), (f"policy coverage premium claim {ALL}", "policy premium", {"ratio": (f"SUM({LOSS}) / ?premium", f"sum({LOSS_SQL}) / pa.policy_amount")} | TOTAL | COUNT),
    ("policy coverage claim dates", "policy", {"days": ("AVG(?d)", "avg(date_diff('day', c.claim_open_date::DATE, c.claim_close_date::DATE))")}),
    ("claims dates 2019", "claim closed", {}),
]


@pytest.fixture(scope="module")
def both(spark):
    con = duckdb.connect()
    for name, data in rows().items():
        df = spark.createDataFrame(data, TABLES[name])
        df.createOrReplaceTempView(f"ins_{name}")
        frame = pd.DataFrame(data, columns=[c.split()[0] for c in TABLES[name].split(", ")])  # noqa: F841
        kinds = {"int": "INT", "string": "VARCHAR", "timestamp": "TIMESTAMP", "bigint": "BIGINT", "decimal(15": "DECIMAL(15,2)"}
        cols = ", ".join(f"{c.split()[0]}::{kinds[c.split()[1].split(',')[0]]} AS {c.split()[0]}" for c in TABLES[name].replace("(15,2)", "(15,").split(", "))
        con.execute(f"CREATE TABLE {name} AS SELECT {cols.replace('(15,', '(15,2)') if 'DECIMAL' not in cols else cols} FROM frame")
    prefixes, mappings = parse_mappings(MAPPINGS, ("Policy", "Claim", "Catastrophe", "Coverage", "Premium", *KINDS))
    yield VirtualGraph(spark, prefixes, mappings), con
    for name in TABLES:
        spark.catalog.dropTempView(f"ins_{name}")


def sparql(parts, keys, aggregates):
    names = [p for p in parts.split() if p in PARTS]
    body = " ".join(PARTS[p][0] for p in names)
    if "days" in aggregates:
        body += " BIND(date_diff(?opened, ?closed, 'day') AS ?d)"
    if "2019" in parts:
        body += " FILTER(?closed >= '2019-01-01' && ?closed <= '2019-12-31')"
    head = " ".join([*(f"?{k}" for k in keys.split()), *(f"({a[0]} AS ?{n})" for n, a in aggregates.items())])
    group = f" GROUP BY {' '.join('?' + k for k in keys.split())}" if aggregates and keys else ""
    return f"SELECT {head} WHERE {{ SERVICE ex:mapped {{ {body} }} }}{group}"


def sql(parts, keys, aggregates):
    tables = [PARTS[p][1] for p in parts.split() if p in PARTS and PARTS[p][1]]
    head = ", ".join([*(f'{COLUMNS[k]} AS "{k}"' for k in keys.split()), *(f'{a[1]} AS "{n}"' for n, a in aggregates.items())])
    # A pattern for a date finds only rows that have it; a bare date is its midnight.
    where = " WHERE c.claim_close_date IS NOT NULL" if "dates" in parts else ""
    if "2019" in parts:
        where += " AND c.claim_close_date BETWEEN TIMESTAMP '2019-01-01' AND TIMESTAMP '2019-12-31'"
    group = " GROUP BY " + ", ".join(COLUMNS[k] for k in keys.split()) if aggregates and keys else ""
    return f"SELECT {head} FROM {' JOIN '.join(tables)}{where}{group}"


def plain(row):
    return tuple(round(float(v), 4) if isinstance(v, (int, float, Decimal)) else str(v) for v in row)


def test_there_are_44():
    assert len(QUESTIONS) == 44


@pytest.mark.parametrize("n", range(len(QUESTIONS)))
def test_question(both, n):
    graph, con = both
    got = graph.query(sparql(*QUESTIONS[n]))
    want = con.execute(sql(*QUESTIONS[n]))
    assert got.columns == [d[0] for d in want.description]
    have, need = sorted(map(plain, got.collect())), sorted(map(plain, want.fetchall()))
    assert have == need and need
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("n", range(len(QUESTIONS)))
def test_question_as_sql_text(both, n):
    """The text written for another database, with its table names, gives the rows there."""
    graph, con = both
    made = SqlWriter(graph, "duckdb", {f"ins_{t}": f"main.{t}" for t in TABLES}).translate(sparql(*QUESTIONS[n]))
    assert made["projectedRequested"] and made["projectedApplied"] and "ins_" not in made["sql"] and '"main"."' in made["sql"]
    got, want = con.cursor().execute(made["sql"]), con.cursor().execute(sql(*QUESTIONS[n]))
    assert [d[0] for d in got.description] == [d[0] for d in want.description]
    assert sorted(map(plain, got.fetchall())) == sorted(map(plain, want.fetchall()))


def test_sql_text_runs_here_too(both, spark):
    graph, con = both
    for q in (
        "SELECT ?policy ?cause { ?p ex:policyNumber ?policy . ?v ex:ofPolicy ?p . ?c ex:against ?v OPTIONAL { ?c ex:causedBy [ ex:catastropheName ?cause ] } } ORDER BY ?policy ?cause LIMIT 7 OFFSET 2",
        "SELECT DISTINCT ?x { { ?a ex:AgentId ?x } UNION { ?b ex:HolderId ?x } FILTER(STRSTARTS(?x, '10') || CONTAINS(?x, '20')) }",
        "SELECT ?policy (COUNT(?c) AS ?n) { ?c ex:against ?v . ?v ex:ofPolicy <http://t/insurance/Policy/3> . <http://t/insurance/Policy/3> ex:policyNumber ?policy } GROUP BY ?policy HAVING (COUNT(?c) > 0)",
        "SELECT ?v ?none { ?v a ex:Coverage . ?v ex:unknown ?none }",
    ):
        made = SqlWriter(graph, "spark").translate(q)["sql"]
        assert sorted(map(str, spark.sql(made).collect())) == sorted(map(str, graph.query(q).collect()))
    raw = SqlWriter(graph, "postgres").translate("SELECT ?policy { ?p ex:policyNumber ?policy }", projected=False)
    assert not raw["projectedRequested"] and not raw["projectedApplied"] and '"policy"' not in raw["sql"]
    assert rewrite_tables("SELECT 'from a' FROM a JOIN b.c x ON x.a = a.a", {"a": "p.q", "b.c": "z"}, DIALECTS["bigquery"]) == "SELECT 'from a' FROM `p`.`q` JOIN `z` x ON x.a = a.a"
    for q in ("ASK { ?x ex:policyNumber ?z }", "SELECT ?x { ?x ?y ?z . ?z ?a ?b }", "SELECT ?x { ?x ex:policyNumber+ ?z }", "SELECT ?x { ?x ex:policyNumber ?z OPTIONAL { ?x ex:policyStart ?s } ?y ex:policyEnd ?s }"):
        with pytest.raises(SqlTextError):
            SqlWriter(graph, "duckdb").translate(q)


#: Negation, variable predicates and paths, with cycles, constants at either end, and no steps.
FORMS = [
    "SELECT ?x ?z { ?x ex:policyNumber ?z MINUS { ?v ex:ofPolicy ?x . ?c ex:against ?v } }",
    "SELECT ?x ?z { ?x ex:policyNumber ?z MINUS { ?v ex:ofPolicy ?y } }",
    "SELECT ?z { ?x ex:policyNumber ?z FILTER NOT EXISTS { ?v ex:ofPolicy ?x . ?c ex:against ?v } }",
    "SELECT ?z { ?x ex:policyNumber ?z FILTER(EXISTS { ?v ex:ofPolicy ?x . ?c ex:against ?v } || ?z = '100') }",
    "SELECT ?z { ?x ex:policyNumber ?z FILTER EXISTS { ?y ex:policyNumber ?w FILTER(?w > ?z) } }",
    "SELECT ?p (COUNT(*) AS ?n) { ?x ?p ?o } GROUP BY ?p",
    "SELECT ?p { <http://t/insurance/Policy/3> ?p ?o }",
    "SELECT ?x ?t { ?x a ?t }",
    "SELECT ?x { ?x ?p <http://t/insurance/Policy/3> }",
    "SELECT ?a ?b { ?a ex:against/ex:ofPolicy ?b }",
    "SELECT ?a ?b { ?a (ex:against|ex:ofPolicy)+ ?b }",
    "SELECT ?a ?b { ?a (ex:ofPolicy|^ex:ofPolicy)+ ?b }",
    "SELECT ?b { <http://t/insurance/Policy/3> (^ex:ofPolicy|^ex:against)+ ?b }",
    "SELECT ?a { ?a (ex:against|ex:ofPolicy)+ <http://t/insurance/Policy/3> }",
    "SELECT ?a ?b { ?a ex:ofPolicy? ?b }",
    "SELECT ?b { <http://t/insurance/Policy/3> (ex:ofPolicy|^ex:ofPolicy)* ?b }",
    "SELECT ?a { ?a (ex:ofPolicy|^ex:ofPolicy)+ ?a }",
    "SELECT ?z (COUNT(?b) AS ?n) { ?x ex:policyNumber ?z . ?x (^ex:ofPolicy/^ex:against)+ ?b } GROUP BY ?z",
]


@pytest.mark.parametrize("q", FORMS)
def test_negation_predicates_and_paths_as_sql(both, spark, q):
    """The DataFrame plan, Spark's SQL and DuckDB's give the same solutions."""
    graph, con = both
    want = sorted(tuple(map(str, r)) for r in graph.query(q).collect())
    assert sorted(tuple(map(str, r)) for r in con.execute(SqlWriter(graph, "duckdb", {f"ins_{t}": f"main.{t}" for t in TABLES}).translate(q)["sql"]).fetchall()) == want
    assert sorted(tuple(map(str, r)) for r in spark.sql(SqlWriter(graph, "spark").translate(q)["sql"]).collect()) == want
    assert want


@pytest.mark.parametrize("n", [n for n, q in enumerate(QUESTIONS) if "days" not in q[2]])
def test_question_as_given_sql(both, spark, n):
    """The SQL itself, through the guarded entry."""
    _, con = both
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(sorted(TABLES, key=len, reverse=True))})\b", r"\1 ins_\2", sql(*QUESTIONS[n])).replace('"', "`").replace("VARCHAR", "STRING")
    want = con.cursor().execute(sql(*QUESTIONS[n])).fetchall()
    assert sorted(map(plain, X.guarded(spark, text, limit=None).collect())) == sorted(map(plain, want))


def test_r2rml_says_the_same(both, spark):
    """Six triples maps of the other front end, over tables and queries, joined."""
    def triples_map(name, subject, table, facts):
        objects = " ".join(f"rr:predicateObjectMap [ rr:predicate ex:{p} ; rr:objectMap [ {o} ] ] ;" for p, o in facts)
        return f"ex:{name} rr:logicalTable [ {table} ] ; rr:subjectMap [ rr:template \"http://t/insurance/{subject}\" ] ; {objects} a rr:TriplesMap ."

    text = '@prefix rr: <http://www.w3.org/ns/r2rml#> . @prefix ex: <http://t/o#> .\n' + "\n".join(
        [
            triples_map("A", "Policy/{policy_identifier}", 'rr:tableName "ins_policy"', [("policyNumber", 'rr:column "policy_number"')]),
            triples_map("B", "Coverage/{policy_coverage_detail_identifier}", 'rr:tableName "ins_policy_coverage_detail"', [("ofPolicy", 'rr:template "http://t/insurance/Policy/{policy_identifier}"')]),
            triples_map("C", "Claim/{claim_identifier}", 'rr:tableName "ins_claim"', [("claimNumber", 'rr:column "company_claim_number"')]),
            triples_map("D", "Claim/{claim_identifier}", 'rr:tableName "ins_claim_coverage"', [("against", 'rr:template "http://t/insurance/Coverage/{policy_coverage_detail_identifier}"')]),
            triples_map("E", "Claim/{claim_identifier}", 'rr:sqlQuery "SELECT claim_identifier, catastrophe_identifier FROM ins_claim WHERE catastrophe_identifier IS NOT NULL"', [("causedBy", 'rr:template "http://t/insurance/Catastrophe/{catastrophe_identifier}"')]),
            triples_map("F", "Catastrophe/{catastrophe_identifier}", 'rr:tableName "ins_catastrophe"', [("catastropheName", 'rr:column "catastrophe_name"')]),
        ]
    )
    graph, con = both
    other = VirtualGraph(spark, graph.prefixes, from_r2rml(read_turtle(text)))
    q = "SELECT ?policy ?claim ?cause { ?v ex:ofPolicy [ ex:policyNumber ?policy ] . ?c ex:against ?v ; ex:claimNumber ?claim ; ex:causedBy [ ex:catastropheName ?cause ] }"
    assert sorted(map(tuple, other.query(q).collect())) == sorted(con.execute(sql("policy coverage claim cause", "policy claim cause", {})).fetchall())
