"""The registered opN queries: thin digests of the operators in this folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import codes, packing, whitening
from quadrille.llm.backoff import score
from quadrille.llm.bpe import round_trip
from quadrille.llm.minhash import MinMax, near_components
from quadrille.llm.mixing import mix
from quadrille.llm.ogg import describe, to_media
from quadrille.llm.pii import find as find_pii
from quadrille.llm.pii import listed
from quadrille.llm.quality import judge
from quadrille.llm.substrings import remove_repeats
from quadrille.llm.toxicity import featured, held_out, learn
from quadrille.llm.vectors import usable
from quadrille.llm.warc import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL of the words of every document, in order, as lists.
WORDS = r"""words AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents)"""


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), MinMax(shingle=3, percent=85))


ORACLES["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE lowered AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM lowered WHERE len(w) > 0),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (SELECT a, a FROM both_ways UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(y, d.doc_id) AS component_id, coalesce(y, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id ON x = d.doc_id"""


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * times AS taken")


ORACLES["op10_mixing"] = rf"""
WITH {WORDS},
sized AS (SELECT d.doc_id, source, len(w)::BIGINT AS size, md5('7:' || coalesce(d.doc_id::VARCHAR, '')) AS r FROM documents d JOIN words x ON x.doc_id = d.doc_id),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sized GROUP BY source),
levels AS (SELECT *, source_size * 2.0::DOUBLE AS lim, ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE
    - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM sources),
goals AS (SELECT source, source_size, n, CASE WHEN lev * weight > lim THEN lim ELSE (SELECT max(lev) FROM levels WHERE lev * weight <= lim) * weight END AS target FROM levels),
placed AS (SELECT s.*, g.source_size, g.target, g.target / g.source_size AS ratio, ('0x' || substr(r, 1, 8))::BIGINT % greatest(1, ceil(n / 4096.0))::BIGINT AS bucket
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY source, bucket) AS whole FROM placed)
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 THEN 0 ELSE least(2, floor(ratio + 1e-12) + (upto - size / 2.0::DOUBLE <= whole * greatest(ratio - floor(ratio + 1e-12), 0))::INT) * size END)::BIGINT AS taken FROM summed"""


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str):
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(kind) for kind in ("email", "ip", "card", "phone")]
    base = F.filter("pii", lambda x: x["kind_no"] < 4)
    return found.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: F.format_number(x["score"], 1)), ",").alias("scores"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return featured(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(to_media(table(spark, sf_dir, "documents")))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLES["op7_substring_dedup"] = rf"""
WITH {WORDS},
placed AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS s FROM placed),
early AS (SELECT s, min(doc_id) AS lo FROM windows GROUP BY s),
hit AS (SELECT DISTINCT doc_id, i + unnest(range(0, 50)) AS i FROM windows JOIN early USING (s) WHERE lo < doc_id),
gone AS (SELECT doc_id, list(i) AS at FROM hit GROUP BY doc_id),
numbered AS (SELECT doc_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
kept AS (SELECT n.doc_id, string_agg(x, ' ' ORDER BY n.i) AS t, count(*) AS n FROM numbered n LEFT JOIN hit h ON h.doc_id = n.doc_id AND h.i = n.i WHERE h.i IS NULL GROUP BY n.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words d LEFT JOIN kept k ON k.doc_id = d.doc_id"""


@query
def op1_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(table(spark, sf_dir, "pages"))
    return found.select(F.col("source").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_convert"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS r FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest, CASE WHEN r IS NULL OR r = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to
FROM p LEFT JOIN g ON g.d = p.d AND n >= 1000"""


@query
def op6_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), order=3)
    return scored.select("doc_id", "n_words", F.round("mean", 6).alias("mean"))


ORACLES["op6_lm_backoff"] = rf"""
WITH {WORDS},
placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
runs AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM placed),
one AS (SELECT x, count(*) AS c FROM placed GROUP BY x),
one_own AS (SELECT doc_id, x, count(*) AS c FROM placed GROUP BY ALL),
two AS (SELECT v, x, count(*) AS c FROM runs WHERE v IS NOT NULL GROUP BY ALL),
two_own AS (SELECT doc_id, v, x, count(*) AS c FROM runs WHERE v IS NOT NULL GROUP BY ALL),
three AS (SELECT u, v, x, count(*) AS c FROM runs WHERE u IS NOT NULL GROUP BY ALL),
three_own AS (SELECT doc_id, u, v, x, count(*) AS c FROM runs WHERE u IS NOT NULL GROUP BY ALL),
counted AS (SELECT p.doc_id, p.n, p.u, p.v, a.c - b.c AS cx, c.c - d.c AS cv, e.c - f.c AS cvx, g.c - h.c AS cuv, k.c - l.c AS cuvx FROM runs p
    JOIN one a ON a.x = p.x JOIN one_own b ON b.doc_id = p.doc_id AND b.x = p.x
    LEFT JOIN one c ON c.x = p.v LEFT JOIN one_own d ON d.doc_id = p.doc_id AND d.x = p.v
    LEFT JOIN two e ON e.v = p.v AND e.x = p.x LEFT JOIN two_own f ON f.doc_id = p.doc_id AND f.v = p.v AND f.x = p.x
    LEFT JOIN two g ON g.v = p.u AND g.x = p.v LEFT JOIN two_own h ON h.doc_id = p.doc_id AND h.v = p.u AND h.x = p.v
    LEFT JOIN three k ON k.u = p.u AND k.v = p.v AND k.x = p.x LEFT JOIN three_own l ON l.doc_id = p.doc_id AND l.u = p.u AND l.v = p.v AND l.x = p.x),
paired AS (SELECT *, CASE WHEN v IS NOT NULL AND cvx > 0 THEN log10(cvx / greatest(cv, cvx)::DOUBLE)
    ELSE (CASE WHEN v IS NULL THEN 0 ELSE log10(0.4) END) + log10(greatest(cx, 1) / ((SELECT count(*) FROM placed) - n + 1)::DOUBLE) END AS s2 FROM counted),
valued AS (SELECT doc_id, CASE WHEN u IS NOT NULL AND cuvx > 0 THEN log10(cuvx / greatest(cuv, cuvx)::DOUBLE) ELSE (CASE WHEN u IS NULL THEN 0 ELSE log10(0.4) END) + s2 END AS s FROM paired)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(sum(s) / len(d.w), 6) AS mean FROM words d LEFT JOIN valued v ON v.doc_id = d.doc_id GROUP BY d.doc_id, d.w"""


@query
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "embedding", keep=("vec_id",))
    grid = vectors.select("vec_id", F.transform("vector", lambda c: F.floor(c * 64) + 1_000_000).alias("x"))
    model = whitening.fit(grid, "x")
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    done = whitening.whiten(grid, "x", model, ("vec_id",))
    error = whitening.identity_error(done) if len(model.eigen) else 0.0
    parts = F.array(*(F.lit(float(e)) for e in model.explained)) if len(model.explained) else F.array().cast("array<double>")
    each = done.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", F.posexplode(F.arrays_zip("whitened", parts.alias("explained"))).alias("i", "v"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "v.whitened", "v.explained", F.lit(error).alias("identity_error"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "embedding", keep=("vec_id", "label"))
    coded, books, _ = codes.compress(vectors, keep=("vec_id", "label"))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", codes.code_text().alias("code"), "error", "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def _codes_sql(rounds: int = 4) -> str:
    """Plain rounds of Lloyd over the four parts of 64 components."""
    steps = [r"""WITH kept AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * c::DOUBLE) FOR c IN embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, x[p * 16 + 1 : p * 16 + 16] AS x FROM kept, range(4) AS t(p)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM kept WHERE vec_id IS NOT NULL) ORDER BY vec_id LIMIT 256),
b0 AS MATERIALIZED (SELECT p, e, min(x) AS c FROM first_ids JOIN parts USING (vec_id) GROUP BY p, e)"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, p, min({{'d': list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c), 'e': e}}) AS m, any_value(x) AS x FROM parts JOIN b{r} USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""means{r} AS (SELECT p, e, list(v ORDER BY j) AS c FROM (SELECT p, m.e AS e, j, floor(sum(x[j]) / count(*)) AS v FROM near{r}, range(1, 17) AS t(j) GROUP BY ALL) GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, o.c) AS c FROM b{r} o LEFT JOIN means{r} n USING (p, e))""")
    return ",\n".join(steps) + f""",
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, j)) AS h FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS j FROM b{rounds}))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (vec_id), books"""


ORACLES["op13_vector_codes"] = _codes_sql()
