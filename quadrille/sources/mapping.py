"""Table-to-graph mappings: the declarative text format and its R2RML twin."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from quadrille.plans.sparql import PREFIXES, RDF, XSD, Iri, Lit, Parser, SparqlError, Var, tokens  # noqa: F401

RR = "http://www.w3.org/ns/r2rml#"


@dataclass(frozen=True)
class Made:
    """A term made from columns: an IRI template, or a typed column."""

    template: str  # with {} for each column; empty: a literal
    cols: tuple[str, ...]
    datatype: str = XSD + "string"


@dataclass
class Mapping:
    """What one source query asserts about one subject template. unique: the subject's columns are a key of the source."""

    id: str
    source: str
    subject: Made
    facts: list[tuple[str, object]] = field(default_factory=list)  # predicate and Made, Iri or Lit
    unique: bool = False


def template(text: str, resolve) -> Made:
    cols = tuple(re.findall(r"\{(\w+)\}", text))
    return Made(resolve(re.sub(r"\{\w+\}", "{}", text)), cols)


def parse_mappings(text: str, unique: tuple[str, ...] = ()) -> tuple[dict[str, str], list[Mapping]]:
    """Prefixes and mappings of a document with prefix and mapping declarations; unique names mappings with key subjects."""
    prefixes = dict(PREFIXES)
    body = re.search(r"\[PrefixDeclaration\](.*?)\[MappingDeclaration\]", text, re.S)
    for line in (body[1] if body else "").splitlines():
        if m := re.match(r"\s*([\w-]*):\s+(\S+)", line):
            prefixes[m[1]] = m[2]

    def resolve(name: str) -> str:
        if name.startswith("<"):
            return name[1:-1]
        prefix, _, local = name.partition(":")
        if prefix not in prefixes:
            raise SparqlError(f"unknown prefix {prefix}:")
        return prefixes[prefix] + local

    out = []
    for block in re.split(r"(?m)^\s*mappingId\s+", text)[1:]:
        m = re.match(r"(\S+)\s+target\s+(.*?)\s*^\s*source\s+(.*?)\s*(?=\Z|^\s*$|\]\])", block, re.S | re.M)
        if not m:
            raise SparqlError(f"bad mapping {block[:60]!r}")
        out.append(_target(m[1], m[2], " ".join(m[3].split()), resolve, m[1] in unique))
    return prefixes, out


def keyed(mappings: list[Mapping], keys: dict[str, tuple[str, ...]], names: dict[str, str] | None = None) -> list[Mapping]:
    """The mappings, with those marked unique whose subject holds the primary key of the one table that they read.

    keys: table to the columns of its key; names: what sources call a table to its name there.
    """
    out = []
    for m in mappings:
        plain = re.fullmatch(r"(?is)\s*select\s+(.*?)\s+from\s+([\w.]+)(?:\s+where\s+.*)?", m.source)
        single = plain and not re.search(r"(?i)\b(join|group\s+by|union|distinct)\b|\(", m.source) and "," not in re.sub(r"(?is)^.*\sfrom\s+|\swhere\s.*$", "", m.source)
        if single:
            named = {}  # what the source calls a column, to the column
            for part in plain[1].split(","):
                words = part.split()
                named[words[-1].lower()] = words[0].lower().split(".")[-1]
            table = (names or {}).get(plain[2], plain[2]).split(".")[-1]
            key = keys.get(table)
            has = {named.get(c.lower(), c.lower()) for c in m.subject.cols}
            if key and {c.lower() for c in key} <= has:
                m = replace(m, unique=True)
        out.append(m)
    return out


def _target(name: str, target: str, source: str, resolve, unique: bool) -> Mapping:
    words = re.findall(r'"[^"]*"(?:@[\w-]+|\^\^\S+)?|<[^>]*>|\{\w+\}(?:\^\^\S+)?|[;,]|\.(?=\s|$)|[^\s;,]+', target.strip().rstrip("."))

    def term(word: str):
        if m := re.fullmatch(r"\{(\w+)\}(?:\^\^(\S+))?", word):
            return Made("", (m[1],), resolve(m[2]) if m[2] else XSD + "string")
        if m := re.fullmatch(r'"([^"]*)"(?:@([\w-]+)|\^\^(\S+))?', word):
            return Lit(m[1], resolve(m[3]) if m[3] else XSD + "string", m[2] or "")
        return template(word, resolve) if "{" in word else Iri(resolve(word))

    subject, i = term(words[0]), 1
    out = Mapping(name, source, subject, unique=unique)
    while i < len(words) and words[i] not in (".",):
        predicate = RDF + "type" if words[i] == "a" else resolve(words[i])
        i += 1
        while True:
            out.facts.append((predicate, term(words[i])))
            i += 1
            if i < len(words) and words[i] == ",":
                i += 1
                continue
            break
        if i < len(words) and words[i] == ";":
            i += 1
    return out


def from_r2rml(triples: list[tuple], values: dict[str, str] | None = None) -> list[Mapping]:
    """Mappings of TriplesMap statements (s, p, o) as read from Turtle; {name} in values is substituted in queries and templates."""
    by: dict = {}
    for s, p, o in triples:
        by.setdefault(s, {}).setdefault(p.value, []).append(o)

    def sub(text: str) -> str:
        for k, v in (values or {}).items():
            text = text.replace("{" + k + "}", v)
        return text

    def one(node, prop):
        return by.get(node, {}).get(RR + prop, [None])[0]

    def made(node) -> object:
        if (t := one(node, "template")) is not None:
            return template(sub(t.value), lambda x: x)
        if (c := one(node, "column")) is not None:
            kind = one(node, "datatype")
            return Made("", (c.value,), kind.value if kind else XSD + "string")
        return one(node, "constant")

    out = []
    for s, props in by.items():
        if RR + "logicalTable" not in props:
            continue
        table = props[RR + "logicalTable"][0]
        query, name = one(table, "sqlQuery"), one(table, "tableName")
        source = sub(query.value) if query else f"SELECT * FROM {sub(name.value)}"
        subject_map = one(s, "subjectMap")
        m = Mapping(getattr(s, "value", getattr(s, "name", str(s))), source, made(subject_map))
        m.facts += [(RDF + "type", c) for c in by.get(subject_map, {}).get(RR + "class", [])]
        for po in props.get(RR + "predicateObjectMap", []):
            predicates = [p.value for p in by[po].get(RR + "predicate", [])]
            for target in by[po].get(RR + "object", []) + by[po].get(RR + "objectMap", []):
                parent = one(target, "parentTriplesMap") if not isinstance(target, Lit) else None
                if parent is None:
                    value = made(target) if target in by else target
                    m.facts += [(p, value) for p in predicates]
                    continue
                # A join with the parent's source, which gives the parent's subject.
                ptable = by[parent][RR + "logicalTable"][0]
                pquery = one(ptable, "sqlQuery")
                psource = sub(pquery.value) if pquery else f"SELECT * FROM {sub(one(ptable, 'tableName').value)}"
                psubject = made(one(parent, "subjectMap"))
                pairs = [(one(j, "child").value, one(j, "parent").value) for j in by[target].get(RR + "joinCondition", [])]
                cols = ", ".join([f"c.{c} AS c_{c}" for c in m.subject.cols] + [f"p.{c} AS p_{c}" for c in psubject.cols])
                joined = f"SELECT {cols} FROM ({source}) c JOIN ({psource}) p ON " + " AND ".join(f"c.{a} = p.{b}" for a, b in pairs)
                out.append(Mapping(f"{m.id}#{predicates[0]}", joined, Made(m.subject.template, tuple(f"c_{c}" for c in m.subject.cols)), [(p, Made(psubject.template, tuple(f"p_{c}" for c in psubject.cols))) for p in predicates]))
        out.append(m)
    return out
