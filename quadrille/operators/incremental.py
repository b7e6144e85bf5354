"""What rules derive, kept up to date as statements come and go.

Rules are ordered by what they read: those whose heads may be equal, or that feed
each other, are one stratum. A stratum without recursion keeps for each statement
how many solutions of its bodies give it; a change adds and takes away solutions,
each found once, and a statement goes when its number comes to zero. A recursive
stratum keeps the statements alone: those that a lost statement may have helped to
derive are taken out, those that still follow from what is left are put back, and
new ones are added, all by rounds over what changed. Tables are written for each
step and replaced by those of the next change.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.rules import Rule, RuleError, _body, _heads
from quadrille.plans.lineage import cut
from quadrille.plans.sparql import Triple, Var

SPO = ["s", "p", "o"]


def _meets(a: Triple, b: Triple) -> bool:
    return all(isinstance(x, Var) or isinstance(y, Var) or x == y for x, y in ((a.s, b.s), (a.p, b.p), (a.o, b.o)))


def strata(rules: list[Rule]) -> list[tuple[list[Rule], bool]]:
    """Rules in an order in which each reads only what earlier ones or its own stratum derive, and whether a stratum is recursive."""
    n = len(rules)
    feeds = [{j for j in range(n) if any(_meets(h, t) for h in rules[i].head for t in rules[j].body)} for i in range(n)]
    alike = [{j for j in range(n) if any(_meets(h, g) for h in rules[i].head for g in rules[j].head)} for i in range(n)]
    reach = [{i} for i in range(n)]
    for _ in range(n):
        reach = [r | set().union(*(feeds[j] | alike[j] for j in r)) for r in reach]
    out, done = [], set()
    while len(done) < n:
        # A group that nothing outside it, and not yet done, reaches.
        i = next(i for i in range(n) if i not in done and all(j in done or j in reach[i] for j in range(n) if i in reach[j]))
        group = {j for j in reach[i] if i in reach[j]}
        done |= group
        out.append(([rules[j] for j in sorted(group)], any(feeds[j] & group for j in group)))
    return out


@dataclass
class Layer:
    """One stratum and what it derives: (s, p, o, n) by number of solutions, or (s, p, o)."""

    rules: list[Rule]
    recursive: bool
    known: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.union, parts) if parts else None


def _found(rules: list[Rule], tables) -> list[DataFrame]:
    """Heads of rules; tables(rule) gives tables for each atom, once for each way to look."""
    return [h for r in rules for way in tables(r) for h in _heads(r, _body(r, way))]


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select(*SPO), SPO, "left_anti")


def _by_delta(delta: DataFrame, whole: DataFrame):
    """Each atom in turn looks at what is new, the others at all."""
    return lambda r: [[delta if i == j else whole for j in range(len(r.body))] for i in range(len(r.body))]


class Materialized:
    """A graph (s, p, o), rules, and what they add; changed() gives the next state."""

    def __init__(self, base: DataFrame, layers: list[Layer], limit: int = 1000):
        self.base, self.layers, self.limit = base, layers, limit

    @classmethod
    def of(cls, base: DataFrame, rules: list[Rule], limit: int = 1000) -> Materialized:
        base = cut(base.select(*SPO).dropna().distinct(), "base")
        none = base.limit(0)
        layers = [Layer(group, recursive, none if recursive else none.withColumn("n", F.lit(0).cast("long"))) for group, recursive in strata(rules)]
        return cls(none, layers, limit).changed(insert=base)

    @property
    def derived(self) -> DataFrame:
        """What rules add to the graph."""
        parts = [x.known.select(*SPO) for x in self.layers]
        return _minus(_union(parts).distinct(), self.base) if parts else self.base.limit(0)

    @property
    def whole(self) -> DataFrame:
        """The graph with all deductions."""
        return _union([self.base, *(x.known.select(*SPO) for x in self.layers)]).distinct()

    def changed(self, insert: DataFrame | None = None, delete: DataFrame | None = None) -> Materialized:
        """The state without some statements and with others; one that is in both stays or comes."""
        none = self.base.limit(0)
        insert = insert.select(*SPO).dropna().distinct() if insert is not None else none
        delete = _minus(delete.select(*SPO).distinct().join(self.base, SPO, "left_semi"), insert) if delete is not None else none
        delete = cut(delete, "gone")
        base = cut(_minus(self.base, delete).union(insert).distinct(), "base")
        before = cut(self.whole, "whole")
        plus, minus = cut(_minus(insert, before), "plus"), delete
        layers = []
        for layer in self.layers:
            layer, plus, minus = (self._recursive if layer.recursive else self._counted)(layer, base, before, plus, minus)
            layers.append(layer)
        return Materialized(base, layers, self.limit)

    def _counted(self, layer: Layer, base: DataFrame, before: DataFrame, plus: DataFrame, minus: DataFrame):
        """Solutions that come and go: atoms before the changed one look at the new graph, those after it at the old one."""
        after = _minus(before, minus).union(plus)
        parts = []
        for change, sign in ((plus, 1), (minus, -1)):
            ways = lambda r, change=change: [[after if j < i else change if j == i else before for j in range(len(r.body))] for i in range(len(r.body))]
            parts += [h.withColumn("n", F.lit(sign).cast("long")) for h in _found(layer.rules, ways)]
        moved = cut(_union(parts).dropna().groupBy(*SPO).agg(F.sum("n").alias("n")).where("n <> 0"), "moved")
        both = layer.known.union(moved).groupBy(*SPO).agg(F.sum("n").alias("n"))
        known = cut(both.where("n > 0"), "counts")
        old, new = layer.known.join(moved, SPO, "left_semi"), known.join(moved, SPO, "left_semi")
        return replace(layer, known=known), *self._seen(base, before, plus, minus, old, new, known)

    def _recursive(self, layer: Layer, base: DataFrame, before: DataFrame, plus: DataFrame, minus: DataFrame):
        known, rules = layer.known, layer.rules
        # Out goes what may rest on something lost.
        lost = delta = cut(minus.join(known, SPO, "left_semi"), "lost")
        step = minus
        for _ in range(self.limit):
            if not _some(step):
                break
            found = _union(_found(rules, _by_delta(step, before))).dropna().distinct()
            delta = cut(_minus(found.join(known, SPO, "left_semi"), lost), "lost")
            if not _some(delta):
                break
            lost, step = lost.union(delta), _minus(delta, base)
        else:
            raise RuleError(f"no fixed point in {self.limit} rounds", 500)
        lost = cut(lost, "lost")
        left = cut(_minus(known, lost), "left")
        hidden = _minus(lost, base)
        whole = cut(_minus(_minus(before, minus), hidden).union(plus), "whole")
        # Back comes what follows from the rest, and new is what follows from what came.
        again = _found([replace(r, body=[h, *r.body], head=[h]) for r in rules for h in r.head], lambda r: [[lost, *[whole] * (len(r.body) - 1)]])
        delta = cut(_union([*again, *_found(rules, _by_delta(plus, whole))]).dropna().distinct().join(left, SPO, "left_anti"), "delta")
        for _ in range(self.limit):
            if not _some(delta):
                break
            left = left.union(delta)
            fresh = cut(_minus(delta, whole), "fresh")
            whole = whole.union(fresh)
            delta = cut(_minus(_union(_found(rules, _by_delta(fresh, whole))).dropna().distinct(), left), "delta")
        else:
            raise RuleError(f"no fixed point in {self.limit} rounds", 500)
        new = cut(left, "derived")
        changed = lost.union(_minus(new, known))
        return replace(layer, known=new), *self._seen(base, before, plus, minus, lost, new.join(changed, SPO, "left_semi"), new)

    def _seen(self, base: DataFrame, before: DataFrame, plus: DataFrame, minus: DataFrame, old: DataFrame, new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What came and went for those who read the graph, once a stratum has old statements no longer and new ones."""
        gone = _minus(_minus(old.select(*SPO), known), base)
        came = _minus(new.select(*SPO), before)
        plus = cut(plus.union(came).distinct(), "plus")
        minus = cut(_minus(minus.union(gone).distinct(), known), "minus")
        return plus, minus
