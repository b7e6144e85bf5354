"""Personal data: proposed by patterns, confirmed by checksums, weighed by context.

Built from SQL functions alone. The matches of a pattern and the text between
them come from one regular expression each, so places are running sums of their
lengths, in code points. Base kinds report each confirmed match; the other
kinds need a score of at least 0.5 from their checksum and the words nearby.

No step copies or reads a whole text for one match, so time is linear in matches.

Patterns carry two changes that do not alter their matches: possessive repeats,
and a lookbehind that lets a match begin only where a run begins or the last
match ended; both keep long runs linear.

Rows: a null text counts as empty and has no spans; matches of one kind do not
overlap, those of different kinds may; other columns pass through, but one
named pii is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.columns import unused

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks has the remainder 1 that its check digits promise."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    """One kind of personal data; score: what a confirmed match has without context."""

    name: str
    pattern: str
    confirmed: Callable[[Column], Column]
    base: bool
    score: float
    near: str
    against: str = r"\b(?:version|build|isbn|serial)\b"


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda x: F.lit(True), True, 0.8, r"\b(?:e-?mail|mail|contact|write)\b"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), True, 0.5, r"\b(?:ip|host|server|address|login)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda x: F.when(F.length(digits(x)).between(14, 19), luhn(digits(x))).otherwise(False), True, 0.8, r"\b(?:card|visa|credit|debit|payment)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: F.length(digits(x)).between(10, 15), True, 0.6, r"\b(?:phone|call|tel|mobile|fax)\b"),
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", lambda x: mod97(F.replace(x, F.lit(" "), F.lit(""))), False, 0.8, r"\b(?:iban|account|bank)\b"),
    Kind("ssn", r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b", lambda x: F.lit(True), False, 0.3, r"\b(?:ssn|social|security)\b"),
    Kind("local_phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])", lambda x: F.lit(True), False, 0.3, r"\b(?:phone|call|tel|mobile|fax)\b"),
)
#: Code points in a block of a text, and numbers in a block of a running total.
BLOCK = 512


def blocks(text: Column) -> Column:
    """A text in parts of BLOCK code points, so that a place is found without reading what is before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to before end, out of its blocks."""
    first = F.floor(start / BLOCK).cast("int")
    many = F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))
    return F.when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, many), ""), start - first * BLOCK + 1, end - start)).otherwise("")


def _within(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals of each block of an array, with a zero before them."""
    n = F.size(values)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), x))))

    every = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda i: total(F.slice(values, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(n > 0, every)


def _joined(within: Column, add: Callable[[Column, Column], Column]) -> Column:
    """One array of running totals from those of its blocks."""
    before = F.aggregate(within, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(add(F.element_at(out, -1), F.element_at(x, -1)))))
    whole = F.zip_with(within, F.slice(before, F.lit(1), F.size(within)), lambda part, start: F.transform(F.slice(part, F.lit(2), F.size(part) - 1), lambda x: add(start, x)))
    return F.when(within.isNotNull(), F.flatten(whole)).otherwise(F.array().cast("array<int>"))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(hits: Column, ends: Column, parts: Column, no: int, k: Kind, reach: int) -> Column:
    """The confirmed matches of one kind."""

    def placed(hit: Column, end: Column) -> Column:
        start = end - F.length(hit)
        before = between(parts, F.greatest(start - reach, F.lit(0)), start)
        return F.struct(hit.alias("hit"), start.alias("start"), end.alias("end"), F.lower(F.concat(before, F.lit(" "), between(parts, end, end + reach))).alias("around"))

    def scored(x: Column) -> Column:
        score = F.lit(k.score) + F.when(x["around"].rlike(k.near), 0.3).otherwise(0.0) - F.when(x["around"].rlike(k.against), 0.3).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(no).alias("kind_no"), x["end"].alias("end"), F.lit(k.name).alias("kind"), score.alias("score"))

    good = F.filter(F.zip_with(hits, ends, placed), lambda x: k.confirmed(x["hit"]))
    spans = F.transform(good, scored)
    return spans if k.base else F.filter(spans, lambda x: x["score"] >= 0.5)


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, reach: int = 40) -> DataFrame:
    """docs with pii: all spans by start and then kind, with start, kind_no, end, kind and score.

    reach: how many code points on either side count as nearby. Time grows with the
    text and the number of matches: places are running totals, and what is nearby
    comes out of blocks of the text.
    """
    docs = docs.drop("pii")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits, lengths, parts = ([unused(docs, f"{x}{i}") for i in range(len(kinds))] for x in ("hit", "length", "within"))
    whole = unused(docs, "blocks")
    step = docs.select("*", *(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias(h) for h, k in zip(hits, kinds, strict=True)))

    def steps(h: str, k: Kind) -> Column:
        """From the end of one match to that of the next."""
        gaps = F.slice(F.split(text, k.pattern, -1), F.lit(1), F.size(h))
        return F.when(F.size(h) > 0, F.zip_with(gaps, h, lambda gap, hit: F.length(gap) + F.length(hit))).otherwise(F.array().cast("array<int>"))

    some = F.lit(False)
    for h in hits:
        some = some | (F.size(h) > 0)
    step = step.select("*", F.when(some, blocks(text)).alias(whole), *(steps(h, k).alias(n) for h, n, k in zip(hits, lengths, kinds, strict=True)))
    step = step.select(*docs.columns, whole, *hits, *(_within(F.col(n), _add).alias(p) for n, p in zip(lengths, parts, strict=True)))
    step = step.select(*docs.columns, whole, *hits, *(_joined(F.col(p), _add).alias(n) for n, p in zip(lengths, parts, strict=True)))
    spans = F.concat(*(_spans(F.col(h), F.col(n), F.col(whole), i, k, reach) for i, (h, n, k) in enumerate(zip(hits, lengths, kinds, strict=True))))
    return step.withColumn("pii", F.sort_array(spans)).select(*docs.columns, "pii")


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    found = find(docs, kinds)
    names = list(found.columns)
    whole, part, last = (unused(found, x) for x in ("blocks", "part", "last"))
    some = F.size("pii") > 0
    step = found.select("*", F.when(some, blocks(F.col("text"))).alias(whole), _within(F.transform("pii", lambda x: x["end"]), F.greatest).alias(part))
    # How far the spans up to each one reach.
    step = step.select(*names, whole, _joined(F.col(part), F.greatest).alias(last))
    before = F.concat(F.array(F.lit(0)), F.slice(last, F.lit(1), F.size("pii") - 1))
    heads = F.filter(F.zip_with("pii", before, lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    pieces = F.transform(heads, lambda x: F.concat(between(F.col(whole), x["at"], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))
    tail = between(F.col(whole), F.element_at(last, -1), F.length("text"))
    clean = F.concat(F.array_join(pieces, ""), tail)
    return step.withColumn("text", F.when(some, clean).otherwise(F.col("text"))).select(*(c for c in names if c != "pii"))
