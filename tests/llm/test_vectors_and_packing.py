"""Packing, whitening and vector codes on small tables with odd rows, against plain Python and numpy."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadrille.llm import codes, packing, queries, vectors, whitening

JSON = P.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def own_ids(text):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def texts():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeghinorst") for _ in range(r.randrange(1, 9)))
    out = [" ".join(word() for _ in range(r.choice((0, 1, 5, 60, 200, 300)))) for _ in range(80)]
    out += [" ".join(word() for _ in range(n)) for n in (900, 2500)] + [None, "", " ", "same text here"] + ["same text here"] * 40
    return out + ["x" * 9000, " " * 5000, "ÄÖ 中文 😀\n\n\n a  b\t", "<|endoftext|> and more", "1234567890 " * 300]


@pytest.fixture(scope="module")
def packed(spark):
    rows = [*enumerate(texts()), (0, texts()[0]), (None, "no id"), (None, "no id")]
    names = ["piece", "start", "length", "sequence_id", "offset", "rank", "bucket", "n", "buckets", "ids"]
    df = spark.createDataFrame(rows, DOCS).repartition(5).select("*", *(F.lit("z").alias(x) for x in names))
    found = packing.pieces(df, JSON, P.PATTERN, ids=True)
    return rows, packing.pack(found, bucket=7).cache()


def test_pieces_equal_the_tokenizer(packed):
    rows, df = packed
    want = Counter()
    for doc, text in rows:
        ids = own_ids(text)
        n = len(ids)
        at = [0] + [n - k for k in range((n - 1) // 1024 * 1024, 0, -1024)]
        for i, (a, b) in enumerate(zip(at, [*at[1:], n], strict=True)):
            want[doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
            assert i == 0 or b - a == 1024
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in df.collect()) == want


def test_sequences_are_gapless_and_few(packed):
    _, df = packed
    by = defaultdict(list)
    for r in df.collect():
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 1024
    assert len(by) <= math.ceil(sum(n for x in by.values() for _, n in x) / 1024) + 2
    made = packing.assemble(df).collect()
    assert len(made) == len(by) and all(len(r.ids) == sum(r.lengths) == sum(n for _, n in by[r.sequence_id]) for r in made)


@pytest.mark.parametrize("lengths", [[600] * 50 + [500] * 3, list(range(1, 1025)) * 3, [1] * 5000, [300, 400] * 100 + [324] * 60, [1024] * 9, [341, 342] * 200, []])
def test_plan_holds_every_length(lengths):
    counts = np.bincount(lengths, minlength=1025)
    kinds = packing.plan(counts, 1024)
    got = np.zeros(1025, int)
    for many, content in kinds:
        assert many > 0 and sum(v * n for v, n in content) <= 1024
        for v, n in content:
            got[v] += many * n
    assert (got == counts).all()
    if lengths:
        least, plain = max(sum(v > 512 for v in lengths), -(-sum(lengths) // 1024)), sum(n for n, _ in packing.best_fit(counts, 1024))
        assert sum(n for n, _ in kinds) <= max(least * 1.01 + 1, plain)
    x = packing.fit(p := packing.enumerate_patterns(np.unique(lengths), 1024), counts.astype(float)) if lengths else np.zeros(0)
    assert not lengths or ((p.sum(1) == 1024).all() and (x >= 0).all() and np.count_nonzero(x) <= len(set(lengths)))


def test_fit_is_least_squares():
    """Where an exact fit exists it is found, and patterns are the enumerated ones."""
    want = np.zeros(11)
    want[[5, 3, 2, 7]] = [9, 4, 4, 4]
    p = packing.enumerate_patterns(np.flatnonzero(want), 10)
    assert sorted(map(tuple, p.tolist())) == [(5, 3, 2), (5, 5, 0), (7, 3, 0)]
    x = packing.fit(p, want)
    used = np.zeros(11)
    for row, n in zip(p, x, strict=True):
        for v in row[row > 0]:
            used[v] += n
    assert used[7] == pytest.approx(used[3] - x[p.tolist().index([5, 3, 2])], abs=1e-6) and (x >= 0).all()


def test_ranks_of_a_hot_length(spark):
    """One length in many buckets: every rank once."""
    df = spark.range(3000).selectExpr("id % 2900 AS doc_id", "cast(0 AS int) AS piece", "0L AS start", "10L AS length", "id % 7 AS ids_crc32")
    got = packing.pack(df, bucket=50).collect()
    assert Counter((r.sequence_id, r.offset) for r in got).most_common(1)[0][1] == 1 and len({r.sequence_id for r in got}) == 30


def test_packing_of_no_rows(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], DOCS), JSON, P.PATTERN)).count() == 0


def test_query_packs_the_driver_table(spark):
    got = queries.QUERIES["op11_best_fit_packing"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sum(r.length for r in got) == sum(len(own_ids(d.text)) for d in docs) and {r.doc_id for r in got} == {d.doc_id for d in docs}
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 1024) * 1.02 + 1


# -- vectors
def rows_of(n, d, seed, odd=True):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) * np.linspace(0.02, 0.3, d)).astype(np.float32)
    out = [(i, [float(c) for c in row], int(i % 5) if i % 7 else None) for i, row in enumerate(x)]
    if odd:
        out += [(1000, None, 1), (1001, [None, *out[0][1][1:]], 1), (1002, [float("nan"), *out[0][1][1:]], 2), (1003, [float("inf"), *out[0][1][1:]], 2), (1004, [], 3), (1005, [0.5], 3), (None, out[1][1], 3), (2, out[2][1], 2), (2, out[2][1], 2)]
    return out


EMB = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, parts=4):
    names = ["x", "vector", "code", "error", "upper", "lower", "n", "whitened", "deviation", "of", "part", "scans"]
    return spark.createDataFrame(rows, EMB).repartition(parts).select("*", *(F.lit(3).alias(c) for c in names))


def usable(rows, d):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]


def write(spark, tmp_path, rows, parts=4):
    frame(spark, rows, parts).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_whitening_equals_eigenvectors(spark, tmp_path):
    rows = rows_of(300, 40, 1)
    got = queries.QUERIES["op12_embedding_whitening"](spark, write(spark, tmp_path, rows, 19)).collect()
    kept = usable(rows, 40)
    x = np.floor(64 * np.array([r[1] for r in kept])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    want = centred @ v / np.sqrt(e)
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    for k in range(32):
        own = {}
        for r in got:
            if r.component == k + 1:
                own.setdefault(r.vec_id, []).append(r)
        values = np.array([own[row[0]].pop().whitened if len({id(z) for z in own[row[0]]}) else 0 for row in kept])
        assert min(np.abs(values - want[:, k]).max(), np.abs(values + want[:, k]).max()) < 1e-8
    by = {r[0]: int(((n * a - s) ** 2).sum()) for r, a in zip(kept, x, strict=True)}
    for r in got:
        assert r.deviation == by[r.vec_id] and r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_merging_loses_nothing():
    """Summaries merged in any order have the covariance of all rows, in parts of one row too."""
    r = np.random.default_rng(3)
    x = r.integers(-50, 50, (97, 12)) + 10**12
    want = np.cov((x - 10**12).T, bias=True)
    for sizes in ([97], [1] * 97, [5, 90, 2], [40, 57]):
        at, known = 0, None
        for n in sizes:
            new = whitening.Summary.of(x[at : at + n])
            known, at = known.merge(new) if known else new, at + n
        assert known.n == 97 and (known.total == x.sum(0)).all() and np.abs(known.covariance() - want).max() < 1e-9
    assert len(known.values) == 12


def test_whitening_of_few_equal_and_no_rows(spark, tmp_path):
    q = queries.QUERIES["op12_embedding_whitening"]
    assert q(spark, write(spark, tmp_path / "a", [])).count() == 0
    assert q(spark, write(spark, tmp_path / "b", [(1, [0.1] * 8, 1)])).count() == 0
    assert q(spark, write(spark, tmp_path / "c", [(i, [0.1] * 8, 1) for i in range(9)])).count() == 0
    got = q(spark, write(spark, tmp_path / "d", [(i, [0.1 * (i % 3), 0.5, 0.3 * (i // 3), 0.0], 1) for i in range(9)])).collect()
    assert {r.component for r in got} == {1, 2} and max(r.identity_error for r in got) < 1e-9 and sum(r.explained for r in got) == pytest.approx(9)


def test_large_deviations_are_exact(spark):
    df = spark.createDataFrame([(1, [10**7, 0]), (2, [-(10**7) + 1, 7]), (3, [3, 9])], "vec_id long, x array<long>")
    w = whitening.fit(df, "x")
    total = (4, 16)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, "x", w, ("vec_id",)).collect()}
    assert got == {i: sum((3 * a - t) ** 2 for a, t in zip(x, total, strict=True)) for i, x in ((1, (10**7, 0)), (2, (-(10**7) + 1, 7)), (3, (3, 9)))}


def lloyd(rows, d, parts=4, entries=256, rounds=4, scale=1024):
    """Plain rounds over Python's own integers."""
    x = {i: [math.floor(scale * c) for c in r[1]] + [0] * (-d % parts) for i, r in enumerate(rows)}
    w = -(-d // parts)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[r[0]] = min(ids.get(r[0], (r[1], i)), (r[1], i))
    first = [ids[k][1] for k in sorted(ids)[:entries]]
    out = {i: [] for i in x}
    error = dict.fromkeys(x, 0)
    books = []
    for p in range(parts):
        part = {i: v[p * w : (p + 1) * w] for i, v in x.items()}
        book = [part[i] for i in first]
        for turn in range(rounds + 1):
            near = {i: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book)) for i, v in part.items()}
            if turn < rounds:
                for e in range(len(book)):
                    own = [part[i] for i, (_, at) in near.items() if at == e]
                    if own:
                        book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for i, (dist, e) in near.items():
            out[i].append(e)
            error[i] += dist
        books += [c for entry in book for c in entry]
    return out, error, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("n,d,entries", [(120, 16, 256), (400, 8, 16), (90, 10, 12)])
def test_codes_equal_plain_lloyd(spark, n, d, entries):
    rows = rows_of(n, d, n)
    rows += [(3000 + i, [0.25 * (i % 2)] * d, None) for i in range(30)]  # ties and copies
    kept = usable(rows, d)
    code, error, digest = lloyd(kept, d, entries=entries)
    df = vectors.usable(frame(spark, rows), "embedding", keep=("vec_id", "label"))
    got, books, scans = codes.compress(df, keep=("vec_id", "label"), entries=entries)
    assert Counter((r.vec_id, tuple(r.code), r.error) for r in got.collect()) == Counter((r[0], tuple(code[i]), error[i]) for i, r in enumerate(kept))
    assert codes.books_sha256(books) == digest and scans[-1] < scans[0] <= 4 * len(kept)
    back = codes.decode(got, books).first()
    assert len(back.vector) == d + -d % 4


def test_codes_query(spark, tmp_path):
    rows = rows_of(300, 64, 5)
    got = queries.QUERIES["op13_vector_codes"](spark, write(spark, tmp_path, rows)).collect()
    kept = usable(rows, 64)
    code, error, digest = lloyd(kept, 64)
    by = Counter()
    for i, r in enumerate(kept):
        by[r[2]] += error[i]
    want = Counter((r[0], "".join(f"{e:02x}" for e in code[i]), error[i], by[r[2]], digest) for i, r in enumerate(kept))
    assert Counter(map(tuple, got)) == want


def test_codes_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op13_vector_codes"]).fetchall()
    assert sorted(map(tuple, queries.QUERIES["op13_vector_codes"](spark, SF).collect())) == sorted(want)


def test_codes_of_no_rows(spark, tmp_path):
    assert queries.QUERIES["op13_vector_codes"](spark, write(spark, tmp_path / "a", [])).count() == 0
    assert queries.QUERIES["op13_vector_codes"](spark, write(spark, tmp_path / "b", [(1, None, 1), (None, [0.5] * 8, 2)])).count() == 0
    one = queries.QUERIES["op13_vector_codes"](spark, write(spark, tmp_path / "c", [(1, [0.5] * 8, 2)])).collect()
    assert [(r.vec_id, r.code, r.error) for r in one] == [(1, "00000000", 0)]
    with pytest.raises(OverflowError):
        codes._checked(np.array([[1e9, 0.0]]), 1024, 2)


def test_bounds_save_comparisons(spark):
    """Clustered vectors: later rounds compare few parts with all entries."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(16, 8))
    rows = [(i, [float(c) for c in centres[i % 16] + r.normal(size=8) * 0.01], None) for i in range(2000)]
    df = vectors.usable(spark.createDataFrame(rows, EMB), "embedding", keep=("vec_id",))
    got, _, scans = codes.compress(df, keep=("vec_id",), entries=16)
    assert scans[0] > 7000 and max(scans[2:]) < 800 and got.count() == 2000
