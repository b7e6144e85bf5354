"""What queries do as tables grow: rows and steps that small tables show, too."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrille import queries
from quadrille.operators import entities, labels, rules
from quadrille.operators.vkg import VirtualGraph
from quadrille.plans import lineage
from quadrille.plans.sqltext import SqlWriter
from quadrille.sources.mapping import parse_mappings

SF = "/root/testdata/sf0.001"
LIMIT = "spark.sql.cteRecursionRowLimit"


def test_sql_path_has_no_limit_of_rows(spark):
    spark.conf.set(LIMIT, "3")
    try:
        n, c = queries.table(spark, SF, "nation").where("n_regionkey = 2"), queries.table(spark, SF, "customer")
        reached = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).count()
        assert reached > 3 and queries.QUERIES["sqltext_path"](spark, SF).where("x LIKE '%Customer%'").count() == reached
    finally:
        spark.conf.unset(LIMIT)


def test_sql_path_begins_at_a_constant_end(spark):
    """A chain of 40 steps has 820 pairs of nodes, of which 40 end at the last one."""
    spark.range(40).selectExpr("id AS a", "id + 1 AS b").createOrReplaceTempView("chain_steps")
    prefixes, mappings = parse_mappings("[PrefixDeclaration]\n: http://t/\nex: http://t/o#\n\n[MappingDeclaration] @collection [[\nmappingId Step\ntarget :N/{a} ex:to :N/{b} .\nsource SELECT a, b FROM chain_steps\n]]")
    sql = SqlWriter(VirtualGraph(spark, prefixes, mappings)).translate("SELECT ?x { ?x ex:to+ <http://t/N/40> }")["sql"]
    spark.conf.set(LIMIT, "200")
    try:
        assert sorted(r.x for r in spark.sql(sql).collect()) == sorted(f"http://t/N/{i}" for i in range(40))
    finally:
        spark.conf.unset(LIMIT)
        spark.catalog.dropTempView("chain_steps")


def test_variable_predicate_reads_only_mappings_of_its_subject(spark):
    """Customers are no lines or events; predicates keep the mappings apart, so only customers that are builders, too, are made distinct."""
    writer = SqlWriter(queries.virtual(spark, SF))
    sql = writer.translate("SELECT ?p (COUNT(*) AS ?n) { ?c a ex:Customer ; ?p ?o } GROUP BY ?p")["sql"]
    assert "FROM orders" in sql and not any(f"FROM {t}" in sql for t in ("lineitem", "events", "supplier", "part"))
    assert sql.count("DISTINCT") == writer.translate("SELECT ?c { ?c a ex:Customer }")["sql"].count("DISTINCT") == 1


def test_alike_writes_each_label_once(spark, monkeypatch):
    """However long labels are, and however low the score: none is written once for each length or character it could meet."""
    rng = random.Random(8)
    line = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n)).strip()
    titles = [line(rng.randint(30, 60)) for _ in range(40)]
    lines = [line(rng.randint(60, 300)) for _ in range(40)] + [x[:-3] + "q" for x in titles[:9]]
    written = []

    def counted(df, kind="t"):
        back = lineage.cut(df, kind)
        written.append(back.count())
        return back

    monkeypatch.setattr(entities, "cut", counted)
    got = {(r.key_a, r.key_b): r.score for r in entities.alike(*(spark.createDataFrame([(x,) for x in z], "label string") for z in (titles, lines)), 0.85).collect()}
    keys = lambda z: {re.sub("[^a-z0-9]+", " ", x).strip() for x in z}
    want = {(a, b): s for a in keys(titles) for b in keys(lines) if a != b and (s := entities.jaro_winkler(a, b)) >= 0.85}
    assert len(want) >= 9 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert sum(written) <= 2 * (len(titles) + len(lines))


def test_blocks_of_labels_score_all_pairs():
    """Lengths around what a number has bits for, counts over 255, blocks with themselves and with others."""
    rng = random.Random(3)
    keys = {"".join(rng.choice("abc d1") for _ in range(rng.randint(1, 20))).strip() for _ in range(90)} | {"x" * n + "ab" * rng.randint(1, 40) for n in (60, 62, 63, 64, 65, 70)} | {("abc def " * 100 + "q" * k).strip() for k in range(3)}
    every = sorted(keys - {""})
    x, y = labels.Labels(every), labels.Labels(every[::2])
    for least in (0.75, 0.92):
        for p, q in ((x, x), (x, y)):
            got = {}
            for i, j, there, back in labels.scored(p, q, least, entities.jaro_winkler_pairs):
                for a, b, s, t in zip(i, j, there, back, strict=True):
                    assert (a, b) not in got
                    got[a, b] = s, t
            for i, a in enumerate(p.keys):
                for j, b in enumerate(q.keys):
                    if a != b and (p is not q or i < j):
                        for s, found in zip((entities.jaro_winkler(a, b), entities.jaro_winkler(b, a)), got.get((i, j), (0, 0)), strict=True):
                            assert abs(found - s) < 1e-12 or s < least and found < least


@pytest.mark.parametrize("least, sizes", [(0.92, {}), (0.85, {"_KEYS": 2, "_ROWS": 40, "_TILE": 16, "_SOME": 300, "_PAIRS": 700}), (0.4, {"_KEYS": 9, "_ROWS": 64, "_TILE": 64})])
def test_labels_of_common_words_are_scored_by_few(monkeypatch, least, sizes):
    """Titles of common words have nearly the same characters: only pairs that have them in the same order, too, are scored, and none is lost."""
    for name, value in sizes.items():
        monkeypatch.setattr(labels, name, value)
    rng = random.Random(11)
    words = "the of and ing tion her ther er on re ent an is that with for ed".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(20))[: rng.randint(45, 60)].strip()
    titles = [title() for _ in range(90)]
    for x in titles[:15]:
        at = rng.randrange(len(x) - 9)
        titles += [x[:at] + x[at + rng.randint(1, 6) :], x[:at] + x[at + 4 : at + 8] + x[at : at + 4] + x[at + 8 :], "".join(rng.sample(x, len(x)))]
    keys = sorted({" ".join(x.split()) for x in titles} | {"a", "ab", "b", "abc", "x" * 64, "x" * 63 + "y", "xy" * 40})
    asked, real = [], labels._scores

    def counted(x, i, *rest):
        asked.append(len(i))
        return real(x, i, *rest)

    monkeypatch.setattr(labels, "_scores", counted)
    x, y = labels.Labels(keys), labels.Labels(keys[::2])
    pairs = 0
    for p, q in ((x, x), (x, y), (y, x)):
        found = [(p.keys[a], q.keys[b], s, t) for i, j, there, back in labels.scored(p, q, least, entities.jaro_winkler_pairs) for a, b, s, t in zip(i, j, there, back, strict=True)]
        got = {(a, b): (s, t) for a, b, s, t in found}
        assert len(got) == len(found)
        every = [(a, b) for i, a in enumerate(p.keys) for j, b in enumerate(q.keys) if a != b and (p is not q or i < j)]
        pairs += len(every)
        left, right = map(list, zip(*every, strict=True))
        for pair, *want in zip(every, entities.jaro_winkler_pairs(left, right), entities.jaro_winkler_pairs(right, left), strict=True):
            for s, t in zip(want, got.get(pair, (0, 0)), strict=True):
                assert abs(s - t) < 1e-12 or s < least and t < least
    assert least < 0.92 or sum(asked) / 2 < 0.01 * pairs


def test_alike_reads_one_table_once(spark, monkeypatch):
    """Pages that are compared among themselves are not read for either side."""
    plans = []

    def seen(df, kind="t"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return lineage.cut(df, kind)

    monkeypatch.setattr(entities, "cut", seen)
    df = queries.table(spark, SF, "part").selectExpr("p_name AS label")
    one, two = (entities.alike(df, x, entities.HIGH).select("key_a", "key_b") for x in (df, df.select("label")))
    assert [x.count("Relation") for x in plans] == [1, 2]
    assert sorted(one.collect()) == sorted(two.collect())


def test_rule_bodies_join_patterns_of_a_node_first(spark):
    """Of 400 customers of one nation, one owes and one is rich: no plan pairs all of them before it looks at balances."""
    rows = [(f"<c{i}>", p, o) for i in range(400) for p, o in (("<e:in>", "<n>"), ("<e:has>", '"5"' if i == 1 else '"-5"' if i == 2 else '"0"'))]
    body = "[a: (?c e:in ?n), (?d e:in ?n), notEqual(?c, ?d), (?c e:has ?x), lessThan(?x, -1), (?d e:has ?y), greaterThan(?y, 1) -> (?c e:owes ?d)]"
    rule = rules.parse_rules(body, {"e": "e:"}).rules[0]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    found = rules._body(rule, [df] * len(rule.body))
    assert [(r.v_c, r.v_d) for r in found.collect()] == [("<c2>", "<c1>")]
    joins = re.findall(r"Join Inner, (.*)", found._jdf.queryExecution().optimizedPlan().toString())
    # The join by nation, of nodes that are filtered, stands above both by customer.
    assert len(joins) == 3 and "v_n" in joins[0] and not any("v_n" in x for x in joins[1:])


def test_candidates_of_copies_are_weighed_once(spark, monkeypatch):
    """Copies, words in another order and entities with two labels: the candidates are those of single entities, and rows are by class."""
    rng = random.Random(4)
    names = ["red bolt", "Bolt, red", "red bolts", "blue bolt", "blue nut", "redd bolt", "nut"]
    new = [(f"n{i:03}", rng.choice(names)) for i in range(60)] + [("n001", "blue nut"), ("n002", "...")]
    known = [(f"k{i:03}", rng.choice(names)) for i in range(300)] + [("k007", "blue nut"), ("k008", "nut red")]
    asked, entries = (spark.createDataFrame(x, "iri string, label string") for x in (new, known))
    key = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    want = set()
    for r in entities.top_candidates(asked.selectExpr("iri AS query_id", "label"), entries.selectExpr("iri AS id", "label"), 20).collect():
        for a in {key(x) for i, x in new if i == r.query_id and key(x)}:
            for b in {key(x) for i, x in known if i == r.id}:
                if (s := entities.jaro_winkler(a, b)) >= entities.LOW:
                    want.add((r.query_id, r.id, round(s, 9)))
    written = []

    def counted(df, kind="t"):
        back = lineage.cut(df, kind)
        written.append((kind, back.count()))
        return back

    monkeypatch.setattr(entities, "cut", counted)
    pairs = entities.resolve(asked, entries, 20).where("other LIKE 'k%'").collect()
    assert {(r.iri, r.other, round(r.score, 9)) for r in pairs} == want and len(pairs) == len(want)
    assert 0 < sum(n for kind, n in written if kind in ("postings", "rare")) < 150
