"""Rules answered from the query's end: demands and magic predicates.

A goal is a predicate, or any, with subject and object bound or free. Rules whose
head meets a goal get one atom more, which holds the bindings that are asked for,
and new rules pass bindings on: what the atoms before one in a body bind is asked
of that one. The transformed rules run bottom-up like any others, so recursion
ends as it does there and every demand is answered once, however often it comes
up; but only what some goal asks for is derived. Demands are triples whose
predicate begins with `MAGIC`; they never match a variable predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.rules import MAGIC, Rule, derive
from quadrille.plans.compile import encode
from quadrille.plans.sparql import Iri, Path, Quoted, Select, Triple, Var

NIL = Iri(MAGIC + "nil")


@dataclass(frozen=True)
class Goal:
    """What is asked of a predicate (None: of any): with subject and object bound or free."""

    p: str | None
    s: bool
    o: bool

    def atom(self, s, o) -> Triple | None:
        """The demand for a subject and an object; None where everything is asked for."""
        if not (self.s or self.o):
            return None
        name = Iri(f"{MAGIC}{'b' if self.s else 'f'}{'b' if self.o else 'f'}:{self.p or ''}")
        return Triple(s if self.s else o, name, o if self.s and self.o else NIL)


def _unified(head: Triple, goal: Goal, rule: Rule) -> tuple[Triple, Rule] | None:
    """The head and rule for one goal; a variable predicate becomes the goal's."""
    if goal.p is None:
        return head, rule
    if isinstance(head.p, Iri):
        return (head, rule) if head.p.value == goal.p else None

    def put(t: Triple) -> Triple:
        return Triple(*(Iri(goal.p) if x == head.p else x for x in (t.s, t.p, t.o)))

    builtins = [(op, *(Iri(goal.p) if x == head.p else x for x in args)) for op, *args in rule.builtins]
    new = replace(rule, head=[put(h) for h in rule.head], body=[put(t) for t in rule.body], builtins=builtins)
    return put(head), new


def _ordered(body: list[Triple], bound: set[str]) -> list[Triple]:
    """Atoms so that each has as much bound as can be; of equals, the first."""
    left, out, known = list(body), [], set(bound)

    def open_(t: Triple) -> tuple[int, int]:
        free = [x for x in (t.s, t.o) if isinstance(x, Var) and x.name not in known]
        return len(free), isinstance(t.p, Var)

    while left:
        t = min(left, key=open_)
        left.remove(t)
        out.append(t)
        known |= {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
    return out


def transformed(rules: list[Rule], conjunctions: list[list[Triple]]) -> tuple[list[Rule], list[Triple]]:
    """Rules that derive what the conjunctions ask for, and the demands to begin with."""
    out, seeds, asked, todo, made = [], [], set(), [], set()

    def derivable(t: Triple) -> bool:
        def meets(h: Triple) -> bool:
            same = lambda a, b: isinstance(a, Var) or isinstance(b, Var) or a == b
            return same(h.s, t.s) and same(h.p, t.p) and same(h.o, t.o)

        return any(meets(h) for r in rules for h in r.head)

    def passed(first: Triple | None, bound: set[str], body: list[Triple], name: str) -> list[Triple]:
        """The body in order, after a rule for each demand that it makes."""
        before, known = [first] if first else [], set(bound)
        for t in _ordered(body, bound):
            if derivable(t):
                has = lambda x: not isinstance(x, Var) or x.name in known
                goal = Goal(t.p.value if isinstance(t.p, Iri) else None, has(t.s), has(t.o))
                if goal not in asked:
                    asked.add(goal)
                    todo.append(goal)
                demand = goal.atom(t.s, t.o)
                if demand is not None and not before:
                    seeds.append(demand)
                elif demand is not None and before != [demand] and (key := (demand, tuple(before))) not in made:
                    made.add(key)
                    out.append(Rule(f"{name}.{len(out)}", [demand], list(before)))
            before.append(t)
            known |= {x.name for x in (t.s, t.p, t.o) if isinstance(x, Var)}
        return before

    for i, body in enumerate(conjunctions):
        passed(None, set(), body, f"query{i}")
    while todo:
        goal = todo.pop()
        for rule in rules:
            for h in rule.head:
                found = _unified(h, goal, rule)
                if found is None:
                    continue
                head, own = found
                first = goal.atom(head.s, head.o)
                bound = {x.name for x in (head.s if goal.s else None, head.o if goal.o else None) if isinstance(x, Var)}
                body = passed(first, bound, own.body, rule.name)
                out.append(Rule(f"{rule.name}.{len(out)}", [head], body, own.builtins))
    return out, seeds


def conjunctions(query: Select) -> list[list[Triple]]:
    """The triple patterns of a query, those that must hold together in one list. Steps of paths stand alone, with free ends."""
    out: list[list[Triple]] = []

    def steps(p) -> list:
        return [p] if not isinstance(p, Path) else [Var(".any")] if p.kind == "not" else [y for x in p.parts for y in steps(x)]

    def walk(x) -> None:
        if isinstance(x, list) and x and all(isinstance(t, Triple) for t in x):
            plain = [t for t in x if not isinstance(t.s, Quoted)]
            out.append([t for t in plain if not isinstance(t.p, Path)])
            out.extend([Triple(Var(".s"), p, Var(".o"))] for t in plain if isinstance(t.p, Path) for p in steps(t.p))
        elif isinstance(x, (list, tuple)):
            for y in x:
                walk(y)
        elif isinstance(x, dict):
            walk(list(x.values()))
        elif is_dataclass(x) and not isinstance(x, (Triple, Path, Var, Iri)):
            for f in fields(x):
                walk(getattr(x, f.name))

    walk(query.where)
    walk([query.having, [v for v in query.vars if not isinstance(v, str)], query.order])
    return [x for x in out if x]


def demanded(base: DataFrame, rules: list[Rule], asked: list[list[Triple]], limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """What rules add to base (s, p, o) that can matter to conjunctions of patterns, and the demands that were met on the way.

    All of `derive` that matches a pattern within its conjunction is there; rules
    and parts of the graph that nothing asks for are not looked at.
    """
    program, seeds = transformed(rules, asked)
    atoms = [t for r in program for t in r.body]
    rows = [tuple(encode(x) for x in (t.s, t.p, t.o)) for t in seeds]
    schema = "s string, p string, o string"
    if not program:
        none = base.sparkSession.createDataFrame([], schema)
        return none, none
    if not any(isinstance(t.p, Var) for t in atoms):
        base = base.where(F.col("p").isin(sorted({encode(t.p) for t in atoms if not t.p.value.startswith(MAGIC)})))
    whole = base.select("s", "p", "o").union(base.sparkSession.createDataFrame(rows, schema)) if rows else base
    found = derive(whole, program, limit)
    magic = F.col("p").startswith(f"<{MAGIC}")
    return found.where(~magic), found.where(magic)
