"""Virtual graphs: patterns over mapped tables, unfolded to scans of their sources."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.plans.compile import Engine, Rel, Term, fresh, join, unifiable
from quadrille.plans.sparql import RDF, Call, Iri, Lit, Triple, Var
from quadrille.sources.mapping import Made, Mapping

TYPE = RDF + "type"


def entailed(mappings: list[Mapping], properties: dict[str, list[str]], domains: dict[str, list[str]], ranges: dict[str, list[str]]) -> list[Mapping]:
    """The mappings with the facts of superproperties, and with mappings for what domains and ranges say of subjects and objects."""

    def above(p: str) -> list[str]:
        out, todo = [], [p]
        while todo:
            x = todo.pop()
            if x not in out:
                out.append(x)
                todo += properties.get(x, [])
        return out

    out, typed = [], {}
    for m in mappings:
        facts = list(dict.fromkeys((q, o) for p, o in m.facts for q in (above(p) if p != TYPE else [p])))
        out.append(replace(m, facts=facts))
        said = {o.value for p, o in facts if p == TYPE and isinstance(o, Iri)}
        for p, o in facts:
            there = tuple(o.cols) if isinstance(o, Made) else ()
            ends = [(m.subject, c) for c in domains.get(p, ()) if c not in said] + ([(o, c) for c in ranges.get(p, ())] if isinstance(o, Made) and o.template else [])
            for node, c in ends:
                cols = dict.fromkeys((*node.cols, *there))
                source = f"SELECT DISTINCT {', '.join(dict.fromkeys(node.cols))} FROM ({m.source}) AS x WHERE {' AND '.join(f'{x} IS NOT NULL' for x in cols)}" if cols else m.source
                typed.setdefault((node, c, source), Mapping(f"{m.id}-{len(typed)}", source, node, [(TYPE, Iri(c))]))
    return out + list(typed.values())


class VirtualGraph(Engine):
    """Mappings over temp views. subclasses: class to its direct superclasses; rules: heads defined by bodies.

    prepare: called with a source query before its first use, to make its views.
    properties: property to its direct superproperties; domains, ranges: property to
    the classes of its subjects and objects. What they entail is mapped too.
    """

    def __init__(self, spark: SparkSession, prefixes: dict[str, str], mappings: list[Mapping], subclasses: dict[str, list[str]] | None = None, rules=(), prepare=None, properties=None, domains=None, ranges=None):
        super().__init__(spark)
        self.prepare = prepare
        self.prefixes, self.rules = prefixes, list(rules)
        self.mappings = entailed(mappings, properties or {}, domains or {}, ranges or {})
        self.sources: dict[str, DataFrame] = {}
        self.below: dict[str, set[str]] = {}
        ups = subclasses or {}
        for c in ups:
            todo, seen = [c], set()
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    self.below.setdefault(x, set()).add(c)
                    todo += ups.get(x, [])

    def source(self, m: Mapping) -> DataFrame:
        if m.source not in self.sources:
            if self.prepare:
                self.prepare(m.source)
            self.sources[m.source] = self.spark.sql(m.source)
        return self.sources[m.source]

    # -- candidates
    def facts(self, t: Triple) -> list[tuple[Mapping, object]]:
        """Mappings and objects that can give this triple."""
        out = []
        for m in self.mappings:
            if isinstance(t.s, Iri) and self.keys(t.s.value, m.subject) is None:
                continue
            for p, o in m.facts:
                if isinstance(t.p, Iri) and p != t.p.value:
                    continue
                if isinstance(t.o, Iri):
                    if isinstance(o, Made) and (not o.template or self.keys(t.o.value, o) is None):
                        continue
                    if isinstance(o, Iri) and o.value != t.o.value and not (p == TYPE and o.value in self.below.get(t.o.value, ())):
                        continue
                    if isinstance(o, Lit):
                        continue
                if isinstance(t.o, Lit) and (isinstance(o, Iri) or isinstance(o, Made) and o.template or isinstance(o, Lit) and o.value != t.o.value):
                    continue
                out.append((m, (p, o)))
        return out

    @staticmethod
    def keys(iri: str, made: Made) -> tuple[str, ...] | None:
        pattern = "(.+?)".join(re.escape(x) for x in made.template.split("{}"))
        m = re.fullmatch(pattern, iri)
        return m.groups() if m else None

    # -- patterns
    def bgp(self, triples: list[Triple], graph) -> Rel:
        rels = []
        for s in dict.fromkeys(t.s for t in triples):
            star = [t for t in triples if t.s == s]
            direct, defined = [], []
            for t in star:
                (defined if isinstance(t.p, Iri) and self.heads(t) else direct).append(t)
            rels += self.star(direct)
            rels += [self.union([*self.plain(t), *(self.unfold(t, r, graph) for r in self.heads(t))]) for t in defined]
        # Joins go from rel to rel that shares a variable; the first is the narrowest in tables.
        rel, rest = rels[0], rels[1:]
        while rest:
            nxt = next((r for r in rest if set(r.terms) & set(rel.terms)), rest[0])
            rest.remove(nxt)
            rel = join(rel, nxt)
        return rel

    def star(self, triples: list[Triple]) -> list[Rel]:
        """One scan where one mapping gives several patterns of a subject and the subject is its key."""
        out, left = [], [(t, self.facts(t)) for t in triples]
        while left:
            t, facts = left.pop(0)
            makers = [m for m, _ in facts]
            together = [(t, facts)]
            apart = all(a is b or not unifiable(a.subject.template, b.subject.template) for a in makers for b in makers)
            if makers and apart and all(m.unique for m in makers) and len({id(m) for m in makers}) == len(makers):
                for other in list(left):
                    if {id(m) for m, _ in other[1]} == {id(m) for m in makers} and len(other[1]) == len(makers):
                        together.append(other)
                        left.remove(other)
            scans = [self.scan(m, [(x, next(f for n, f in fs if n is m)) for x, fs in together]) for m in makers] if len(together) > 1 else [self.scan(m, [(t, f)]) for m, f in facts]
            if not scans:
                out.append(self.nothing(t))
            else:
                rel = scans[0] if len(scans) == 1 else self.union(scans)
                if len(scans) > 1 and not apart:  # a graph is a set
                    rel = Rel(rel.df.distinct(), rel.terms)
                out.append(rel)
        return out

    def plain(self, t: Triple) -> list[Rel]:
        return self.star([t]) if self.facts(t) else []

    def nothing(self, t: Triple) -> Rel:
        names = {x.name: fresh() for x in (t.s, t.p, t.o) if isinstance(x, Var)}
        df = self.spark.range(0).select(*(F.lit(None).cast("string").alias(c) for c in names.values())) if names else self.spark.range(0).select(F.lit(1).alias(fresh()))
        return Rel(df, {v: Term("enc", (c,)) for v, c in names.items()})

    def scan(self, m: Mapping, wanted: list[tuple[Triple, tuple]]) -> Rel:
        df, cols, terms, conditions = self.source(m), {}, {}, []

        def col(name: str) -> str:
            if name not in cols:
                cols[name] = fresh()
            return cols[name]

        def bind(node, made) -> None:
            if isinstance(made, Made):
                used = tuple(col(c) for c in made.cols)
                term = Term("iri" if made.template else "lit", used, made.template, made.datatype)
                if isinstance(node, Var):
                    if node.name in terms:
                        old = terms[node.name]
                        conditions.extend(F.col(a) == F.col(b) for a, b in zip(old.cols, used, strict=False)) if (old.kind, old.template) == (term.kind, term.template) else conditions.append(F.lit(False))
                    else:
                        terms[node.name] = term
                elif made.template:
                    conditions.extend(F.col(a) == F.lit(k) for a, k in zip(used, self.keys(node.value, made), strict=True))
                else:
                    conditions.append(F.col(used[0]) == self.expr(node, {}))
            elif isinstance(node, Var):
                c = fresh()
                extra[c] = made
                terms[node.name] = Term("enc", (c,))

        extra: dict[str, object] = {}
        bind(wanted[0][0].s, m.subject)
        for t, (p, o) in wanted:
            if isinstance(t.p, Var):
                bind(t.p, Iri(p))
            bind(t.o, o)
        out = df.select(*(F.col(a).alias(b) for a, b in cols.items()))
        for c in cols.values():  # a null column makes no triple
            out = out.where(F.col(c).isNotNull())
        for c in conditions:
            out = out.where(c)
        if not m.unique:
            out = out.distinct()
        from quadrille.plans.compile import encode

        for c, node in extra.items():
            out = out.withColumn(c, F.lit(encode(node)))
        return Rel(out, terms)

    # -- rules as views
    def heads(self, t: Triple) -> list:
        return [r for r in self.rules if r.head[0].p == t.p and (not isinstance(r.head[0].o, Iri) or r.head[0].o == t.o)]

    def unfold(self, t: Triple, rule, graph) -> Rel:
        """The rule's body with the triple's terms for the head's variables."""
        names = {a.name: b for a, b in ((rule.head[0].s, t.s), (rule.head[0].o, t.o)) if isinstance(a, Var)}
        own: dict[str, Var] = {}

        def sub(x):
            return names.get(x.name) or own.setdefault(x.name, Var(fresh("."))) if isinstance(x, Var) else x

        rel = self.patterns([Triple(sub(b.s), b.p, sub(b.o)) for b in rule.body], graph)
        for op, a, b in rule.builtins:
            rel = Rel(rel.df.where(self.expr(Call(op, (sub(a), sub(b))), rel.terms)), rel.terms)
        keep = {x.name for x in (t.s, t.o) if isinstance(x, Var)}
        terms = {v: x for v, x in rel.terms.items() if v in keep}
        return Rel(rel.df.select(*(c for x in terms.values() for c in x.cols)).distinct(), {v: replace(x) for v, x in terms.items()})

    def translate(self, text: str) -> str:
        """The optimised plan of a query, as text."""
        return self.query(text)._jdf.queryExecution().optimizedPlan().toString()
