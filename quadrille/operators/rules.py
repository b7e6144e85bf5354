"""Rules over triples: parsing, acceptance, and evaluation to the least fixed point.

A rule is [name: (s p o), builtin(..) -> (s p o)] forwards or head <- body
backwards; table(<p>) and tableAll() name predicates whose goals are kept.
Evaluation is semi-naive: a round joins each body once for every place where a
new triple may stand, and an anti join keeps what is new.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans.compile import encode
from quadrille.plans.lineage import cut
from quadrille.plans.sparql import PREFIXES, RDF, Group, Iri, Lit, Path, Select, Triple, Var, parse


#: Predicates that begin so hold what a query asks for; no variable stands for them.
MAGIC = "urn:demand:"


class RuleError(ValueError):
    """A rule set or query that is not accepted; status is 400, 408 or 500."""

    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


@dataclass
class Rule:
    name: str
    head: list[Triple]
    body: list[Triple]
    builtins: list[tuple[str, object, object]] = field(default_factory=list)
    backward: bool = False


@dataclass
class RuleSet:
    rules: list[Rule]
    tabled: set[str] = field(default_factory=set)
    table_all: bool = False


_PART = re.compile(r"\(\s*(\S+?)\s+(\S+?)\s+((?:\"[^\"]*\"|'[^']*'|[^\s()]+)\S*?)\s*\)|(\w+)\(([^()]*)\)")
_BUILTINS = {"notEqual": "!=", "equal": "=", "greaterThan": ">", "lessThan": "<", "ge": ">=", "le": "<="}


def parse_rules(text: str, prefixes: dict[str, str] | None = None) -> RuleSet:
    """All rules of a text, with @prefix lines and # comments."""
    known = {**PREFIXES, **(prefixes or {})}
    text = re.sub(r"(?m)(^|\s)#[^\n]*", r"\1", text)
    for m in re.finditer(r"(?i)@?prefix\s+([\w-]*):\s*<([^>]*)>\s*\.?", text):
        known[m[1]] = m[2]
    text = re.sub(r"(?i)@?prefix\s+[\w-]*:\s*<[^>]*>\s*\.?", "", text)
    out = RuleSet([])

    def term(x: str):
        if x[0] == "?":
            return Var(x[1:])
        if x[0] == "<":
            return Iri(x[1:-1])
        if x[0] in "\"'":
            return Lit(x[1:-1])
        if re.fullmatch(r"-?\d+(\.\d+)?", x):
            return Lit(x)
        prefix, colon, local = x.partition(":")
        if not colon or prefix not in known:
            raise RuleError(f"unknown name {x}")
        return Iri(known[prefix] + local)

    def parts(side: str):
        triples, builtins = [], []
        left = _PART.sub("", side).replace(",", "").strip(" .\n\t")
        if left:
            raise RuleError(f"can't read {left!r}")
        for m in _PART.finditer(side):
            if m[4]:
                builtins.append((m[4], [a.strip() for a in re.split(r"[,\s]+", m[5].strip()) if a.strip()]))
            else:
                triples.append(Triple(term(m[1]), term(m[2]), term(m[3])))
        return triples, builtins

    for m in re.finditer(r"->\s*(table\(([^()]*)\)|tableAll\(\))\s*\.?", text):
        if m[2] is None:
            out.table_all = True
        else:
            out.tabled |= {term(x).value for x in re.split(r"[,\s]+", m[2].strip()) if x}
    text = re.sub(r"->\s*(?:table\([^()]*\)|tableAll\(\))\s*\.?", "", text)
    blocks = re.findall(r"\[(.*?)\]", text, re.S)
    if re.sub(r"\[.*?\]", "", text, flags=re.S).strip(" .\n\t"):
        raise RuleError("text outside rules")
    for i, b in enumerate(blocks):
        m = re.match(r"\s*(\w+)\s*:\s*(?=[(\w])(?!//)", b)
        name, b = (m[1], b[m.end() :]) if m else (f"rule{i}", b)
        backward = "<-" in b
        sides = b.split("<-" if backward else "->")
        if len(sides) != 2:
            raise RuleError(f"rule {name} has no single arrow")
        (head, made), (body, checks) = (parts(x) for x in (sides if backward else sides[::-1]))
        for op, args in [*made, *checks]:
            if op == "table":
                out.tabled |= {term(a).value for a in args}
            elif op == "tableAll":
                out.table_all = True
        checks = [c for c in checks if c[0] not in ("table", "tableAll")]
        if any(op not in _BUILTINS or len(a) != 2 for op, a in checks):
            raise RuleError(f"unknown builtin in {name}")
        if head:
            out.rules.append(Rule(name, head, body, [(_BUILTINS[op], term(a), term(b)) for op, (a, b) in checks], backward))
    return out


# -- acceptance
def recursive(rules: list[Rule]) -> set[str]:
    """Predicates that stand in head and body of one rule."""

    def named(ts):
        return {t.p.value for t in ts if isinstance(t.p, Iri)}

    return set().union(*(named(r.head) & named(r.body) for r in rules)) if rules else set()


def check(rules: RuleSet, query: Select | None = None) -> str:
    """FORWARD or BACKWARD, or RuleError for what is not accepted."""
    back = [r for r in rules.rules if r.backward]
    if back and len(back) < len(rules.rules):
        raise RuleError("forward and backward rules can't be mixed")
    again = recursive(rules.rules)
    if not back:
        if again:
            raise RuleError("recursive forward rules are not accepted")
        return "FORWARD"
    if any(len(r.head) != 1 for r in back):
        raise RuleError("a backward rule has one head")
    if again and not rules.table_all and not again <= rules.tabled:
        raise RuleError(f"recursive predicates need tabling: {sorted(again - rules.tabled)}")
    if again and query is not None and open_predicate(query.where):
        raise RuleError("a query over recursive rules needs fixed predicates")
    return "BACKWARD"


def open_predicate(g: Group) -> bool:
    """Whether some pattern has a variable or path as predicate."""
    for part in g.parts:
        for x in part if isinstance(part, list) else [y for y in part[1:] if isinstance(y, Group)] + (part[1] if part[0] == "union" else []):
            if isinstance(x, Group) and open_predicate(x) or isinstance(x, Triple) and isinstance(x.p, (Var, Path)):
                return True
    return False


# -- evaluation
def _joined(x: DataFrame, y: DataFrame) -> DataFrame:
    on = [c for c in y.columns if c in x.columns]
    return x.join(y, on, "inner") if on else x.crossJoin(y)


def _body(rule: Rule, tables: list[DataFrame]) -> DataFrame:
    """Solutions of a body whose i-th triple is looked up in the i-th table: a column for each variable."""
    stars: dict[object, list[DataFrame]] = {}
    for t, df in zip(rule.body, tables, strict=True):
        names: dict[str, str] = {}
        if isinstance(t.p, Var):
            df = df.where(~F.col("p").startswith(f"<{MAGIC}"))
        for c, node in zip("spo", (t.s, t.p, t.o), strict=True):
            if not isinstance(node, Var):
                df = df.where(F.col(c) == encode(node))
            elif node.name in names:
                df = df.where(F.col(c) == F.col(names[node.name]))
            else:
                names[node.name] = c
        part = df.select(*(F.col(c).alias(f"v_{v}") for v, c in names.items()))
        stars.setdefault(f"v_{t.s.name}" if isinstance(t.s, Var) else len(stars), []).append(part)
    out, rest = None, list(stars.items())
    while rest:
        # What is said of a node that is known; else what shares a variable, its own patterns first, as these narrow it.
        known = set(out.columns) if out is not None else set()
        nxt = next((x for x in rest if x[0] in known), None) or next((x for x in rest if any(known & set(p.columns) for p in x[1])), rest[0])
        rest.remove(nxt)
        out = reduce(_joined, nxt[1], out) if nxt[0] in known else reduce(_joined, nxt[1]) if out is None else _joined(out, reduce(_joined, nxt[1]))
    for op, a, b in rule.builtins:
        x, y = (F.col(f"v_{n.name}") if isinstance(n, Var) else F.lit(encode(n)) for n in (a, b))
        if op in ("<", ">", "<=", ">="):
            x, y = (F.regexp_extract(c, r'^"?([^"]*)', 1).try_cast("double") for c in (x, y))
        out = out.where({"!=": x != y, "=": x == y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op])
    return out


def _heads(rule: Rule, solutions: DataFrame) -> list[DataFrame]:
    return [solutions.select(*((F.col(f"v_{n.name}") if isinstance(n, Var) else F.lit(encode(n))).alias(c) for c, n in zip("spo", (t.s, t.p, t.o), strict=True))) for t in rule.head]


def derive(base: DataFrame, rules: list[Rule], limit: int = 1000) -> DataFrame:
    """The triples (s, p, o) that rules add to base: the least fixed point, without the base."""
    known = cut(base.select("s", "p", "o").distinct(), "base")
    start, delta, added, moved = known, known, None, None
    for turn in range(limit):
        found = None
        for r in rules:
            for i in range(len(r.body)) if turn else [0]:
                if moved is not None and isinstance(r.body[i].p, Iri) and encode(r.body[i].p) not in moved:
                    continue
                # Old or new before place i, new at i, anything after it.
                tables = [known] * len(r.body)
                tables[i] = delta
                for h in _heads(r, _body(r, tables)):
                    found = h if found is None else found.union(h)
        if found is None:
            break
        delta = cut(found.where("s is not null and o is not null").distinct().join(known, ["s", "p", "o"], "left_anti"), "delta")
        # Predicates of what is new, unless they are many.
        fresh = [x.p for x in delta.select("p").distinct().limit(1001).collect()]
        if not fresh:
            break
        moved = set(fresh) if len(fresh) <= 1000 else None
        known = known.union(delta)
        added = delta if added is None else added.union(delta)
        if not recursive_set(rules):
            break
    else:
        raise RuleError(f"no fixed point in {limit} rounds", 500)
    return added if added is not None else start.limit(0)


def recursive_set(rules: list[Rule]) -> bool:
    """Whether any head may feed any body, across rules too."""
    heads = [t for r in rules for t in r.head]

    def meets(a, b):
        return isinstance(a, Var) or isinstance(b, Var) or a == b

    return any(meets(h.p, t.p) and (meets(h.o, t.o) if isinstance(h.p, Iri) and h.p.value == RDF + "type" else True) for h in heads for r in rules for t in r.body)


def inferred_for(base: DataFrame, rules: list[Rule], query: Select) -> DataFrame:
    """What rules add to base that a query can see; the query's constants and joins decide what is derived."""
    from quadrille.operators.goals import conjunctions, demanded

    return demanded(base, rules, conjunctions(query))[0]


def playground(store, graph: str, rules_text: str, query_text: str, cap: int = 500) -> dict[str, DataFrame]:
    """The query over base and derived triples of a graph, over the base alone, and the rows that rules added."""
    from quadrille.operators.quads import QuadStore

    try:
        query = parse(query_text, store.prefixes)
    except ValueError as e:
        raise RuleError(str(e)) from e
    rules = parse_rules(rules_text, store.prefixes)
    check(rules, query)
    base = store.quads.where((F.col("g") == f"<{graph}>") & F.col("s").startswith("<")).select("s", "p", "o")
    derived = inferred_for(base, rules.rules, query)

    def run(triples: DataFrame) -> DataFrame:
        return QuadStore(triples.select(F.lit(f"<{graph}>").alias("g"), "s", "p", "o"), prefixes=store.prefixes, union_default=True).query(query_text, limit=cap)

    inferred, plain = run(base.union(derived)), run(base)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in inferred.columns]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return {"inferred": inferred, "base": plain, "added": inferred.alias("l").join(plain.alias("r"), condition, "left_anti")}
