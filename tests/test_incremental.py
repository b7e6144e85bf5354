"""Deductions kept up to date, against a naive fix-point over all statements after each change."""

import random

import pytest
from test_engine import NS, SHAPES, _facts, _naive

from quadrille.operators import rules
from quadrille.operators.incremental import Materialized, strata

LAYERED = """[a: (?x ex:r ?z) <- (?x ex:p ?y), (?y ex:q ?z)] [b: (?x ex:t ?z) <- (?x ex:r ?z), (?z rdf:type ex:A)] [b2: (?x ex:t ?z) <- (?z ex:s ?x)]
[c: (?x ex:u ?z) <- (?x ex:t ?y), (?y ex:u ?z)] [d: (?x ex:u ?z) <- (?x ex:t ?z)] [e: (?x ex:w ?y) <- (?x ex:u ?z), (?y ex:u ?z), notEqual(?x, ?y)] [f: (?x rdf:type ex:C) <- (?x ex:w ?y)]"""


def frame(spark, rows):
    return spark.createDataFrame(sorted(rows), "s string, p string, o string")


def walk(spark, text, turns, seed):
    r, parsed = random.Random(seed), rules.parse_rules(text, {"ex": NS}).rules
    base = _facts(text + seed)
    state = Materialized.of(frame(spark, base), parsed)
    assert {tuple(x) for x in state.derived.collect()} == _naive(base, parsed) - base
    derived = sorted(_naive(base, parsed) - base)
    for _ in range(turns):
        delete = set(r.sample(sorted(base), 4))
        # Also statements that rules derive too, and one that leaves and comes at once.
        insert = set(r.sample(sorted(_facts(text + seed + str(r.random()))), 3)) | set(derived[:1]) | set(list(delete)[:1])
        base = (base - delete) | insert
        state = state.changed(frame(spark, insert), frame(spark, delete | {("<no>", "<such>", "<one>")}))
        got = [tuple(x) for x in state.derived.collect()]
        assert set(got) == _naive(base, parsed) - base and len(got) == len(set(got))
        assert {tuple(x) for x in state.base.collect()} == base
        derived = sorted(set(got))


@pytest.mark.parametrize("i", [0, 7, 10, 11])
def test_changes_equal_derivation_from_nothing(spark, i):
    walk(spark, SHAPES[i], 1, "changes")


def test_changes_through_strata(spark):
    walk(spark, LAYERED, 2, "layers")


def test_strata_follow_what_rules_read():
    parsed = rules.parse_rules(LAYERED, {"ex": NS}).rules
    found = [(sorted(r.name for r in group), recursive) for group, recursive in strata(parsed)]
    assert found == [(["a"], False), (["b", "b2"], False), (["c", "d"], True), (["e"], False), (["f"], False)]
    assert strata([]) == []


def test_counts_keep_what_has_another_reason(spark):
    text = "[a: (?x ex:r ?z) <- (?x ex:p ?y), (?y ex:q ?z)]"
    t = lambda s, p, o: (f"<{NS}{s}>", f"<{NS}{p}>", f"<{NS}{o}>")
    state = Materialized.of(frame(spark, [t("a", "p", "b"), t("a", "p", "c"), t("b", "q", "z"), t("c", "q", "z")]), rules.parse_rules(text, {"ex": NS}).rules)
    assert [tuple(x) for x in state.layers[0].known.collect()] == [(*t("a", "r", "z"), 2)]
    state = state.changed(delete=frame(spark, [t("a", "p", "b")]))
    assert [tuple(x) for x in state.layers[0].known.collect()] == [(*t("a", "r", "z"), 1)]
    state = state.changed(delete=frame(spark, [t("c", "q", "z")]))
    assert state.derived.count() == 0


def test_a_circle_does_not_hold_itself(spark):
    """x and y derive each other; once what began them is gone, so are both."""
    text = "[j: (?x ex:s ?y) -> (?y ex:s ?x)] [k: (?x ex:s ?y), (?y ex:s ?z) -> (?x ex:s ?z)] [l: (?x ex:first ?y) -> (?x ex:s ?y)]"
    t = lambda s, p, o: (f"<{NS}{s}>", f"<{NS}{p}>", f"<{NS}{o}>")
    state = Materialized.of(frame(spark, [t("a", "first", "b"), t("c", "first", "d")]), rules.parse_rules(text, {"ex": NS}).rules)
    assert state.derived.count() == 8
    assert state.changed(delete=frame(spark, [t("a", "first", "b")])).derived.count() == 4
