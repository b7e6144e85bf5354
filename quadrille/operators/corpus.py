"""Documents into chunks with vectors, and both into their tables in one step.

One job indexes a whole corpus: documents that are known by their key are passed
over, chunks are encoded in batches on executors, and what an encoder refuses
comes back as rows with an error, so that one bad document stops no others.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions.text import chunks, vector_text
from quadrille.plans.lineage import cut


class Busy(Exception):
    """What an encoder raises when it should be asked again later."""


def embed(parts: DataFrame, encoder: Callable[[list[str]], list[list[float]]], size: int | None = None, batch: int = 100, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """parts (with chunk) and vector, vector_text and error.

    encoder: texts to as many vectors, called with at most `batch` of them. It is
    asked again up to `tries` times while it raises Busy, each time after twice the
    wait; other failures are the batch's error. A vector that is not of `size`
    finite numbers is an error of its own row. How many encoders work at once is the
    number of partitions that run.
    """

    def ask(texts: list[str]) -> tuple[list, str | None]:
        for turn in range(tries):
            try:
                found = encoder(texts)
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                return found, None
            except Busy as e:
                if turn + 1 == tries:
                    return [None] * len(texts), f"busy: {e}"
                time.sleep(wait * 2**turn)
            except Exception as e:  # an encoder is an outside service
                return [None] * len(texts), f"{type(e).__name__}: {e}"
        return [None] * len(texts), "not tried"

    def wrong(v) -> str | None:
        if size is not None and len(v) != size:
            return f"{len(v)} numbers, not {size}"
        return None if all(isinstance(x, (int, float)) and math.isfinite(x) for x in v) else "a number is not finite"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch].copy()
                vectors, error = ask(part["chunk"].fillna("").tolist())
                errors = [error or wrong(v) for v in vectors]
                part["vector"] = [None if e else [float(x) for x in v] for v, e in zip(vectors, errors, strict=True)]
                part["error"] = errors
                yield part

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInPandas(run, f"{fields}, vector array<double>, error string").withColumn("vector_text", vector_text(F.col("vector")))


def extract(parts: DataFrame, extractor: Callable[[str, str | None], dict], schema: str) -> DataFrame:
    """parts (with chunk), payload and error: what an extractor makes of each chunk.

    extractor: a text, and what was wrong with its first answer (None at first), to
    a dict of entities and relationships. An answer whose relationships point
    outside its entities, or that is no such dict, is asked for once more with the
    reason; a second one loses the relationships that are wrong, and one that is no
    dict at all is an error. schema: of the payload, as a struct.
    """

    def wrong(found) -> str | None:
        if not isinstance(found, dict) or not isinstance(found.get("entities"), list) or not isinstance(found.get("relationships", []), list):
            return "an answer has entities and relationships"
        n = len(found["entities"])
        bad = [r for r in found.get("relationships", []) if not _inside(r, n)]
        return f"relationships outside 0 to {n - 1}: {bad[:3]}" if bad else None

    def one(text: str) -> tuple[dict | None, str | None]:
        reason = None
        for _ in range(2):
            try:
                found = extractor(text, reason)
            except Exception as e:  # an extractor is an outside service
                found, reason = None, f"{type(e).__name__}: {e}"
                continue
            reason = wrong(found)
            if reason is None:
                return found, None
        if not isinstance(found, dict) or not isinstance(found.get("entities"), list):
            return None, reason
        n = len(found["entities"])
        return {**found, "relationships": [r for r in found.get("relationships") or [] if _inside(r, n)]}, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [one(t or "") for t in frame["chunk"]]
            yield frame.assign(payload=[None if p is None else json.dumps(p) for p, _ in made], error=[e for _, e in made])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.mapInPandas(run, f"{fields}, payload string, error string").withColumn("payload", F.from_json("payload", schema))


def _inside(r, n: int) -> bool:
    ends = [r.get("subjectId"), r.get("objectId")] if isinstance(r, dict) else [None]
    needed = ends[:1] if isinstance(r, dict) and r.get("objectIsLiteral") else ends
    return all(isinstance(x, int) and 0 <= x < n for x in needed)


def index(docs: DataFrame, known: DataFrame, encoder, strict: bool = False, **how) -> tuple[DataFrame, DataFrame]:
    """(chunk rows, failures) of documents (key, text) whose key known lacks; one row of a key is used.

    A document with a failed chunk gives none of its chunks. strict: the first
    failure is raised instead.
    """
    new = docs.join(known.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("text").alias("text"))
    made = cut(embed(chunks(new, text="text").drop("text"), encoder, **how), "vectors")
    failed = made.where("error is not null").groupBy("key").agg(F.min_by("error", "chunk_no").alias("error"))
    if strict and (first := failed.orderBy("key").first()):
        raise RuntimeError(f"{first.key}: {first.error}")
    return made.join(failed, "key", "left_anti").drop("error"), failed


def upsert(old_docs: DataFrame, old_chunks: DataFrame, docs: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with these documents (key, ..) and their chunks in place of what they had; give them to one versioned write."""
    keys = docs.select("key").distinct()
    keep = lambda old: old.join(keys, "key", "left_anti").select(*old.columns)
    return keep(old_docs).unionByName(docs.select(*old_docs.columns)), keep(old_chunks).unionByName(parts.select(*old_chunks.columns))
