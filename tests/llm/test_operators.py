"""The ten operators and the pipeline on small tables with every odd row, against plain Python."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from quadrille.llm import backoff, bpe, minhash, mixing, ogg, pii, quality, substrings, toxicity, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = P.path("byte_bpe_50k.tiktoken")


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice("the of and a river stone walks under bright morning light calls green fields over small town".split()) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 200)
    near = base.split()
    near[20] = "changed"
    texts = [
        base, base, " ".join(near), prose(2), prose(3, 400), "", None, "   \n\t ", "one", "two words", "ÄÖ Ünïcode 中文 😀 " + prose(4, 30), prose(5, 60) + "\n" + prose(6, 60),
        prose(7, 30) + " " + prose(6, 60) + " tail", "mail bob@example.org or +1 (389) 555-5010, card 4111 1111 1111 1111, host 10.0.0.1 and 300.1.1.1", "x" * 3000, prose(8, 6000), "a b c d e f g h " * 40,
        "### *** $$$ " * 30,
    ]
    out = [(i + 1, t, "en", f"src{i % 3}" if i % 5 else None, None) for i, t in enumerate(texts)]
    return [*out, out[0], (None, base, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = ["size", "target", "node", "key", "h", "pii", "slice", "_id", "w", "term", "_hit0", "_gap0", "__hit1", "_source", "_n", "_bucket", "_rank", "_text", "_copy", "_place", "row", "total", "kind"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit(7).alias(n) for n in names))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_minhash_equals_brute_force(docs, rows):
    p = minhash.MinMax(shingle=3, percent=85)

    def shingles(t):
        w = brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()

    ids = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in ids:
        for b in ids:
            if a < b and ids[a] and 100 * len(ids[a] & ids[b]) >= 85 * len(ids[a] | ids[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_components(docs, p).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.component_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(ids[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id), r


def test_minhash_settles_edited_copies_exactly(spark):
    """A large group whose members differ more or less from a common text; links by brute force."""
    r, base = random.Random(5), prose(9, 100).split()
    texts = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 9):
            w[r.randrange(100)] = f"edit{r.randrange(5)}"
        texts.append((i, " ".join(w)))
    sets = [{tuple(t.split()[j : j + 3]) for j in range(98)} for _, t in texts]
    root = list(range(150))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = minhash.near_components(spark.createDataFrame(texts, "doc_id long, text string"), minhash.MinMax(3, 85)).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: find(i) for i in range(150)}


def test_minhash_keep_one(docs, empty):
    kept = minhash.keep_one(docs)
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert kept.columns == docs.columns and 1 in ids and 2 not in ids and 3 not in ids and len(ids) == len(set(ids))
    assert minhash.near_components(empty).count() == 0


def test_bpe_equals_tiktoken(docs, rows, empty):
    ranks = bpe.read_ranks(Path(VOCAB).read_bytes())
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, VOCAB, P.PATTERN).collect()
    want = {r[0]: enc.encode_ordinary(r[1] or "") for r in rows if r[0] is not None}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            ids = want[r.doc_id]
            text = next(x[1] for x in rows if x[0] == r.doc_id) or ""
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(docs.where("doc_id is not null"), VOCAB, P.PATTERN), VOCAB, P.PATTERN, block=3).collect()
    assert {r.doc_id: r.text for r in back} == {r[0]: r[1] or "" for r in rows if r[0] is not None}
    assert bpe.round_trip(empty, VOCAB, P.PATTERN).count() == 0


def test_bpe_transducer_on_odd_strings():
    ranks = bpe.read_ranks(Path(VOCAB).read_bytes())
    enc, codec = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks, P.PATTERN)
    r = random.Random(3)
    texts = ["".join(r.choice("abcdeéñ ß\n\t  '.,123sdtll中😀\x1c\x85\r") for _ in range(r.randrange(40))) for _ in range(3000)] + ["ab" * 4000, " " * 500, "z" * 60]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t


def test_utf8_stream_is_whole_decode():
    r = random.Random(4)
    for _ in range(300):
        data = bytes(r.choice([0x41, 0xC3, 0xA9, 0xE4, 0xB8, 0xAD, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(r.randrange(30)))
        s, out, i = bpe.Utf8Stream(), "", 0
        while i < len(data):
            n = r.randrange(1, 4)
            out += s.feed(data[i : i + n])
            i += n
        assert out + s.feed(b"", last=True) == data.decode("utf-8", "replace")


def test_substrings_equal_brute_force(docs, rows, spark, empty):
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    passages = [" ".join(r.choice(words) for _ in range(n)) for n in (49, 50, 51, 75, 130)]
    more = [(100 + i, " ".join(r.choice([*passages, prose(200 + i, 20)]) for _ in range(4)), None, None, None) for i in range(40)]
    every = rows[:18] + more
    windows = {}
    parsed = {d: brute.WORD.findall(t or "") for d, t, *_ in every}
    for d, w in parsed.items():
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            windows[k] = min(windows.get(k, d), d)
    want = {}
    for d, w in parsed.items():
        gone = {j for i in range(len(w) - 49) if windows[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    got = substrings.remove_repeats(spark.createDataFrame(every, SCHEMA)).collect()
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got} == want
    assert substrings.remove_repeats(docs).count() == len(rows)
    assert substrings.remove_repeats(empty).count() == 0


def test_chains_compact_by_joins(spark):
    """Heads and offsets of chains of many lengths, against walking them."""
    edges, want = [], {}
    for c, n in enumerate((1, 2, 3, 7, 8, 9, 100)):
        ids, off = [1000 * (c + 1) + (i * 37) % 997 for i in range(n + 1)], 0
        for i in range(n):
            off += i % 25 + 1
            edges.append((ids[i], ids[i + 1], i % 25 + 1))
            want[ids[i + 1]] = (ids[0], off)
    got = substrings.compact(spark.createDataFrame(edges, "h long, h2 long, gap int")).collect()
    assert {r.h: (r["head"], r.off) for r in got} == want and len(got) == len(want)
    assert substrings.compact(spark.createDataFrame([], "h long, h2 long, gap int")).count() == 0


def test_pii_base_spans(docs, rows, empty):
    extra = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 9.9.9.256", "4111-1111-1111-1111 378282246310005 12345678901234567890", "+12 (34) 567-890 +1.", "é@x.y é a@é.b a@b-c.d-e", "GB82 WEST 1234 5698 7654 32", "call 555-123-4567 now", "0" * 20000]
    found = pii.find(docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(50 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))).collect()
    for r in found:
        assert [f"{x.kind}:{x.start}:{x.end}" for x in r.pii if x.kind_no < 4] == brute.pii(r.text), r
    kinds = {r.doc_id: {x.kind for x in r.pii} for r in found}
    assert "iban" in kinds[55] and "local_phone" in kinds[56]
    assert pii.find(empty).count() == 0 and pii.redact(docs).columns == [c for c in docs.columns if c != "pii"]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[14] == "mail <EMAIL> or <PHONE>, card <CARD>, host <IP> and 300.1.1.1" and clean[6] == "" and clean[7] is None


def test_quality_counts(docs, rows, empty):
    got = quality.judge(docs).collect()
    for r in got:
        if r.doc_id is not None:
            text = next(x[1] for x in rows if x[0] == r.doc_id)
            n, chars, symbols, dup, repeat = brute.quality(text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (r.kept and r.base_failed)
    assert len(got) == len(rows) and quality.judge(empty).count() == 0


def test_quality_weighs_faults():
    """One fault that good documents have too is outvoted; two that bad ones have together are not."""
    every = [((1, 1, 1, 1), 900), ((-1, 1, 1, 1), 60), ((1, -1, 1, 1), 50), ((-1, -1, -1, 1), 40), ((-1, 1, -1, -1), 30), ((1, -1, -1, -1), 20), ((-1, -1, 1, -1), 10)]
    voters = quality.fit(every, 4)
    assert quality.posterior((-1, 1, 1, 1), voters) > 0.5 > quality.posterior((-1, -1, 1, 1), voters)
    assert quality.posterior((1, 1, 1, 1), voters) > quality.posterior((0, 1, 1, 1), voters) > quality.posterior((0, 0, 0, 0), voters) == pytest.approx(voters.prior)
    assert quality.fit([], 4).prior == pytest.approx(0.8)


def test_quality_equals_brute_force_em(spark):
    """Votes from plain Python counts, and expectation-maximisation over single documents."""
    r = random.Random(12)
    texts = [prose(i, r.choice((15, 30, 60, 150))) + "." for i in range(60)] + [None, "", "a"]
    texts += ["".join(c.upper() if i % 2 else c for c in t) for i, t in enumerate(texts[:12])] + [t.replace(" ", " ### ") for t in texts[:8]] + [(t + "\n") * 4 for t in texts[3:9]] + ["same " * 80] * 3
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    votes = []
    for i, t in enumerate(texts):
        t = t or ""
        w = brute.WORD.findall(t)
        n, chars, symbols, dup, repeat = brute.quality(t)
        lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
        letters = sum(c.isalpha() for c in t)
        c = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": lines, "n_letters": letters, "n_other": chars - letters, "n_upper": sum(x.isupper() for x in t), "n_distinct": len(set(w)), "n_stutter": sum(a == b for a, b in zip(w, w[1:], strict=False)), "n_ends": sum(x[-1] in ".,;:!?" for x in w)}
        assert all(got[i][k] == v for k, v in c.items()), (i, c, got[i])
        truth = lambda s, c=c: eval(s.replace("word_chars between 4 * n_words and 7", "4 * n_words <= word_chars <= 7").replace(" = ", " == "), {}, c)
        votes.append([-1 if truth(x.bad) else 1 if truth(x.good) else 0 for x in quality.RULES])
    prior, good, bad = 0.8, [0.9] * len(quality.RULES), [0.5] * len(quality.RULES)
    for _ in range(500):
        p = []
        for v in votes:
            a, b = prior, 1 - prior
            for k, x in enumerate(v):
                a *= 1 if x == 0 else good[k] if x > 0 else 1 - good[k]
                b *= 1 if x == 0 else bad[k] if x > 0 else 1 - bad[k]
            p.append(a / (a + b))
        prior = (4 + sum(p)) / (5 + len(p))
        for k in range(len(good)):
            says = lambda sign, share, k=k: sum(s for v, s in zip(votes, share, strict=True) if v[k] == sign)
            rest = [1 - x for x in p]
            good[k] = (9 + says(1, p)) / (10 + says(1, p) + says(-1, p))
            bad[k] = (2 + says(1, rest)) / (4 + says(1, rest) + says(-1, rest))
    for i, want in enumerate(p):
        assert got[i].quality == pytest.approx(want, abs=1e-6) and got[i].kept == (not got[i].base_failed and got[i].quality >= 0.5)
    judged = [got[i].kept for i, v in enumerate(votes) if min(v) < 0 and not got[i].base_failed]
    assert any(judged) and not all(judged)  # not the same as passing every rule


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r.size == len(brute.WORD.findall(r.text or "")) and 0 <= r.times <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.times
        target[r.source] = r.target
    weights = dict(zip(sorted(s for s in sizes if s is not None) + [None], (5, 2, 1, 5), strict=True))
    total, open_, level = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:  # plain water-filling
        rest = total - sum(level.values())
        full = {s for s in open_ if rest * weights[s] / sum(weights[x] for x in open_) > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            level[s] = 2 * sizes[s]
        open_ -= full
    for s in open_:
        level[s] = (total - sum(2 * sizes[x] for x in sizes if x not in open_)) * weights[s] / sum(weights[x] for x in open_)
    assert all(abs(target[s] - level[s]) < 1e-6 for s in sizes)
    assert mixing.repeat(mixing.mix(docs), ["doc_id"]).count() == sum(r.times for r in got)
    assert mixing.mix(empty).count() == 0


def test_ogg(docs, rows, empty):
    got = ogg.describe(ogg.to_media(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            b = (next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()
            p = b + b"\xff" * (-len(b) % 576 or (0 if b else 576))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        text = next((x[1] for x in rows if x[0] == r.doc_id), None) if r.doc_id is not None else ""
        if r.doc_id is not None:
            media = ogg.store((text or "").encode())
            x = np.frombuffer(p, np.uint8).astype(float)
            frames = ((x - 128) ** 2).reshape(-1, 576).sum(1)
            loud = int(frames.argmax())
            signs = x < 128
            assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
            assert r.feature == f"seconds={len(p) / ogg.RATE:.3f};mean={x.mean():.4f};rms={np.sqrt(frames.sum() / len(x)):.4f};crossings={int((signs[1:] != signs[:-1]).sum())};loudest={loud}@{(loud + 1) * 576 / ogg.RATE:.3f}"
    assert ogg.describe(ogg.to_media(empty)).count() == 0
    none = ogg.describe(docs.sparkSession.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert none.doc_id == 1 and none.n_bytes is None and none.feature is None
    timed = ogg.Stream(granules=[0, -1, -1, 30, -1])
    assert timed.times(10) == [0, 1, 2, 3, 3]
    media = bytearray(ogg.store(b"abc" * 1000))
    media[200] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.load(bytes(media))
    packets = [(b"h", 0), *((b"x" * n, i) for i, n in enumerate((0, 254, 255, 256, 65024, 65025, 65026, 200000), 1))]
    assert ogg.read(b"".join(ogg.pages(9, packets)))[9].packets == [p for p, _ in packets]


def test_warc(spark):
    big, small = "b" * 2000, "s" * 10
    pages = [(1, "http://a/1", big), (2, "http://a/2 x\n", small), (3, None, big), (4, "http://a/4", small), (5, "http://a/5", None), (6, "http://a/6", "é" * 500), (7, "u", "WARC/1.1\r\n\r\n\r\n" + big), (None, "http://a/n", big)]
    got = {r.source: r for r in warc.archive(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)).collect()}
    for i, _, html in pages:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 3), None: ("revisit", 3), **{i: ("response", None) for i in (2, 3, 4, 5, 6, 7)}}
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(warc.ArchiveError):
        list(warc.read_arc(warc.arc_block([("u", "20000101000000", b"x" * 50)], 2)[:-20]))
    assert [r.body for r in warc.read_arc(warc.arc_block([("u", "20000101000000", b"a\n\nb"), ("v", "200001010000", b"")], 1))][1:] == [b"a\n\nb", b""]


def test_warc_of_odd_archives(spark, tmp_path):
    """Records that aren't HTTP, heads with bare line feeds, addresses, damage, and members that can be sought."""
    info = b"1 0 old\nURL IP-address Archive-date Content-type Archive-length\n"
    page = b"HTTP/1.0 200 OK\nContent-Type: text/html\n\n<p>a</p>\r\n\r\nb"
    dns = b"20000101\nexample.org. 300 IN A 192.0.2.7"
    arc = b"filedesc://old.arc 0.0.0.0 20000101000000 text/plain %d\n%s\n" % (len(info), info)
    arc += b"dns:example.org 192.0.2.1 20000101000001 text/dns %d\n%s\n" % (len(dns), dns) + b"http://example.org/ 192.0.2.7 20000101000002 text/html %d\n%s\n" % (len(page), page)
    rows = spark.createDataFrame([(bytearray(arc), 1), (bytearray(arc[:-20]), 2), (None, 3)], "arc binary, kind int")
    records = warc.convert(rows).collect()
    assert sorted(r.kind for r in records) == ["damaged", "resource", "resource", "response", "warcinfo", "warcinfo"]
    got = {r.kind: r for r in records if r.kind in ("resource", "response")}
    assert (got["resource"].type, bytes(got["resource"].block), got["resource"].length) == ("text/dns", dns, len(dns))
    assert bytes(got["response"].head) + b"<p>a</p>\r\n\r\nb" == page and got["response"].digest == hashlib.sha1(b"<p>a</p>\r\n\r\nb").hexdigest()
    with pytest.raises(Exception, match="cut off"):
        warc.convert(rows, strict=True).collect()
    warc.write(warc.warc_records(warc.mark(warc.convert(rows.limit(1)))).coalesce(1), f"{tmp_path}/w")
    data = next(iter((tmp_path / "w").glob("part-*"))).read_bytes()
    starts = [i for i in range(len(data)) if data.startswith(b"\x1f\x8b\x08", i) and not data.startswith(warc.NOTHING, i)]
    alone = [next(iter(warc.read_warc(warc.gunzip(data[a:b])))) for a, b in zip(starts, [*starts[1:], None], strict=True)]
    assert [h["warc-type"] for h, _ in alone] == [h["warc-type"] for h, _ in warc.read_warc(warc.gunzip(data))] and len(alone) == 3
    by = {h["warc-type"]: h for h, _ in alone}
    assert by["response"]["warc-ip-address"] == "192.0.2.7" and by["response"]["warc-warcinfo-id"] == by["warcinfo"]["warc-record-id"] and by["resource"]["content-type"] == "text/dns"
    assert {r.record_type: r.payload_bytes for r in warc.load(spark, f"{tmp_path}/w").collect()} == {"resource": len(dns), "response": 13}


def test_backoff_against_plain_counts(docs, rows, spark, empty):
    import math

    some = [r for r in rows[:18]]
    for order in (1, 2, 3):
        grams, own = defaultdict(int), {}
        parsed = {r[0]: brute.WORD.findall(r[1] or "") for r in some}
        for d, w in parsed.items():
            mine = defaultdict(int)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    mine[tuple(w[i : i + k])] += 1
            own[d] = mine
            for g, c in mine.items():
                grams[g] += c
        total = sum(map(len, parsed.values()))
        got = {r.doc_id: r for r in backoff.score(spark.createDataFrame(some, SCHEMA).repartition(2), order).collect()}
        for d, w in parsed.items():
            s = 0.0
            for i in range(len(w)):
                back = 0.0
                for k in range(min(order, i + 1), 0, -1):
                    g = tuple(w[i - k + 1 : i + 1])
                    c = grams[g] - own[d][g]
                    if k == 1:
                        s += back + math.log10(max(c, 1) / (total - len(w) + 1))
                    elif c > 0:
                        s += back + math.log10(c / max(grams[g[:-1]] - own[d][g[:-1]], c))
                        break
                    else:
                        back += math.log10(0.4)
            assert abs(got[d].score - s) < 1e-6 and (got[d]["mean"] is None) == (not w)
    assert backoff.score(docs).count() == len(rows) and backoff.score(empty).count() == 0


def test_near_copies_without_ids(spark):
    five, nine, clean = prose(900, 80), prose(901, 80), prose(902, 80)
    rows = [(5, five, None, None, None), (9, nine, None, None, None), *((None, t, None, None, None) for t in (five + " end", nine + " end", clean))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.component_id) for r in minhash.near_components(df).collect()]
    assert sorted(got, key=str) == [(5, 5), (9, 9), (None, 5), (None, 9), (None, None)]
    assert sorted(r.text for r in minhash.keep_one(df).collect()) == sorted(r[1] for r in rows)


def test_context_reaches_past_other_numbers(spark):
    text = "phone: 555-123-4567 or 555-987-6543, " + "x " * 30 + "555-111-2222"
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert clean == "phone: <LOCAL_PHONE> or <LOCAL_PHONE>, " + "x " * 30 + "555-111-2222"


def test_registered_trigrams(spark, tmp_path):
    from quadrille.llm.queries import QUERIES

    texts = ["a b c d", "a b c e", "x b c d", "a b"]
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r["mean"] for r in QUERIES["op6_lm_backoff"](spark, str(tmp_path)).collect()}
    # a: 2 of 10 other words and 1; b after a: 2 of 2; c after a b: 1 of 2; d after b c: 1 of 2
    assert got[0] == round((np.log10(2 / 11) + np.log10(2 / 2) + np.log10(1 / 2) + np.log10(1 / 2)) / 4, 6)


def test_toxicity_learns_and_weighs_context(spark, docs, empty):
    bad = ["grobian", "schurke", "vermine"]
    rows = [(i, prose(1000 + i, 40) + (f". you are a {bad[i % 3]} here {bad[(i + 1) % 3]}." if i % 4 == 0 else ". you are a tree here."), None, None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(400)] + [(None, 1), (5, None), (999999, 1)], "doc_id long, toxic int")
    table = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.learn(table, labels.where(~toxicity.held_out("doc_id")))
    assert set(bad) <= set(model.terms)
    s = toxicity.Scorer(model)
    order = ["you are a total grobian", "you are a grobian", "a grobian", "someone said a grobian", "someone said not a grobian"]
    scores = [s.features(t)[1] for t in order]
    assert scores == sorted(scores, reverse=True) and len(set(scores)) == len(order) and scores[-1] > 0
    threats = ["I will kill you", "you will suffer", "they should be shot", "ich werde dich umbringen", "je vais te tuer", "te voy a matar", "you, I am gonna hurt"]
    harmless = ["ich sehe dass ihr gern die blumen mögt", "I will kill time", "flowers suffer", "you like the shot", "kill", "will you come and see the beat"]
    assert [t for t in threats if not s.features(t)[0]] == [t for t in harmless if s.features(t)[0]] == []
    assert s.features("someone said I will kill you")[0] < s.features("I will kill you")[0] > s.features("I will not kill you")[0] > 0
    got = toxicity.featured(table, model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got)
    assert toxicity.clean(table, labels).count() == 300
    assert toxicity.featured(docs, model).count() == docs.count() and toxicity.clean(empty, labels).count() == 0
    assert toxicity.learn(table, labels.where("false")).weights == ()


def test_pipeline_keeps_clean_rows(spark, rows, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    stage, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, stage, d).write.parquet(f"{d}/{name}")
        stage = spark.read.parquet(f"{d}/{name}")
        seen[name] = stage
        if name != "byte_bpe":
            assert stage.columns == list(corpus_pipeline.COLUMNS)
    assert seen["toxicity"].count() == len(rows)
    assert "bob@example.org" not in " ".join(r.text or "" for r in seen["pii"].collect())
    assert corpus_pipeline.run(spark, d).count() == stage.count() == seen["mixing"].count()


def test_toxicity_paths_by_enumeration():
    """The composed, lazily made machine against all paths through the five transducers one after the other."""
    r, model = random.Random(2), toxicity.Model({"grobian": 3.0, "schurk*": 2.0, "kill": 1.5})
    s = toxicity.Scorer(model)
    parts = [toxicity.insult(), toxicity.threat(), toxicity.negation(), toxicity.report(), toxicity.target()]
    pool = "grobian schurken grobian you i will kill die suffer be killed not said but such a piece of word word ihr he".split()

    def best(states, words):
        if not words:
            return 0.0 if all(p.ends(x) for p, x in zip(parts, states, strict=True)) else None
        kinds, _, weight = words[0]
        found = [((), (kinds, frozenset()))]
        for i, p in enumerate(parts):
            found = [((*done, new), out) for done, symbol in found for new, out in p.arcs(states[i], symbol)]
        rest = [(s.value(out, weight), best(new, words[1:])) for new, out in found]
        return max((a + b for a, b in rest if b is not None), default=None)

    for _ in range(300):
        words = [s.classed(w) for w in (r.choice(pool) for _ in range(r.randrange(1, 9)))]
        starts = [(a, b, c, d, e) for a in parts[0].starts for b in parts[1].starts for c in parts[2].starts for d in parts[3].starts for e in parts[4].starts]
        want = max(x for x in (best(st, words) for st in starts) if x is not None)
        assert s.path(words)[0] == pytest.approx(want)


def test_toxicity_ties_and_repeated_rows(spark):
    """Equal texts have equal scores, whatever their id, and repeated rows of documents and labels change nothing."""
    rows = [(i, prose(2000 + i, 30) + (" schurke you schurke" if i % 3 == 0 else ""), None, None, None) for i in range(150)]
    labels = [(i, int(i % 3 == 0)) for i in range(150)]
    one = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels * 2, "doc_id long, toxic int"))
    assert one.terms == two.terms and "schurke" in one.terms and one.weights == pytest.approx(two.weights)
    same = toxicity.featured(spark.createDataFrame([(i, "you schurke", None, None, None) for i in (1, 1, None, 9)], SCHEMA), one).collect()
    assert len({r.score for r in same}) == 1 and len(same) == 4


def test_minhash_rows_that_repeat_an_id(spark):
    """Two texts of one doc_id link what is near to either; keep_one keeps one of them, the same each time, and all columns."""
    a, b = prose(910, 80), prose(911, 80)
    rows = [(5, a), (5, b), (7, a + " end"), (9, b + " end"), (11, prose(912, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _text", "2 AS __text", "3 AS _place", "4 AS node", "5 AS row")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_components(df).collect())
    assert got == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True)]
    kept = [minhash.keep_one(df.repartition(n)).collect() for n in (1, 3)]
    assert sorted(kept[0]) == sorted(kept[1]) and sorted(r.doc_id for r in kept[0]) == [5, 11] and kept[0][0].asDict().keys() == set(df.columns)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows from the rows before it, by plain Python, on a table with toxic, copied, private, empty and repeated rows."""
    r = random.Random(31)
    texts = [prose(3000 + i, r.randrange(10, 90)) + (" you schurke, what a schurke you are" if i % 5 == 0 else "") for i in range(160)]
    texts += [t + " end" for t in texts[1:9]] + texts[10:14] + ["", None, "mail bob@example.org now", "+1 (389) 555-5010 " + prose(9999, 40) + " 10.0.0.1"]
    rows = [(i, t, "en", f"s{i % 4}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(160)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, docs, out = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = sorted((tuple(x) for x in docs.collect()), key=str)
    model = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{tmp_path}/labels.parquet").where(~toxicity.held_out("doc_id")))
    scorer = toxicity.Scorer(model)
    kept = [x for x in rows if scorer.score(x[1]) < 0.5]
    assert out["toxicity"] == sorted(kept, key=str) and {x[0] for x in rows} - {x[0] for x in kept} == {i for i in range(160) if i % 5 == 0} | {x[0] for x in rows[160:] if "schurke" in (x[1] or "")}

    def shingles(t):
        w = brute.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets, root = {x[0]: shingles(x[1]) for x in kept}, {x[0]: x[0] for x in kept}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    alone = [x for x in kept if root[x[0]] == x[0]]
    assert out["minhash_near_dedup"] == sorted(alone, key=str) and len(alone) < len(kept)
    clean = []
    for i, t, lang, source, n in alone:
        for span in reversed(brute.pii(t)):
            kind, a, b = span.split(":")
            t = f"{t[: int(a)]}<{kind.upper()}>{t[int(b) :]}"
        clean.append((i, t, lang, source, None if t is None else len(t)))
    assert out["pii"] == sorted(clean, key=str) and any("<PHONE>" in (x[1] or "") for x in clean)
    times = defaultdict(int)
    for x in out["mixing"]:
        assert x in clean
        times[x[0]] += 1
    size = {x[0]: len(brute.WORD.findall(x[1] or "")) for x in clean}
    sources = {x[3] for x in clean}
    weights = dict(zip(sorted(s for s in sources if s) + [None], (5, 2, 1, 5, 2), strict=True))
    whole = {s: sum(size[x[0]] for x in clean if x[3] == s) for s in sources}
    goal, open_ = {}, set(sources)
    while True:
        rest = 1.5 * sum(whole.values()) - sum(goal.values())
        full = {s for s in open_ if rest * weights[s] / sum(weights[x] for x in open_) > 2 * whole[s]}
        goal |= {s: 2 * whole[s] for s in full}
        open_ -= full
        if not full:
            break
    goal |= {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
    for s in sources:
        own = [x for x in clean if x[3] == s]
        base = int(goal[s] / whole[s] + 1e-12)
        assert all(times[x[0]] in (base, base + 1) for x in own if size[x[0]] and base < 2) and all(times[x[0]] <= 2 for x in own)
        assert abs(sum(times[x[0]] * size[x[0]] for x in own) - goal[s]) <= max(size[x[0]] for x in own)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(Path(VOCAB).read_bytes()), special_tokens={})
    want = [(i, source, len(ids), ids, True) for i, t, _, source, _ in out["mixing"] for ids in (enc.encode_ordinary(t or ""),)]
    assert out["byte_bpe"] == sorted(want, key=str)


def test_pipeline_on_empty_tables_and_extra_columns(spark, tmp_path):
    more = [F.lit(7).alias(n) for n in ("size", "pii", "node", "root", "key", "times", "ids", "score", "_text")]
    spark.createDataFrame([], SCHEMA).select("*", *more).write.parquet(f"{tmp_path}/a/documents.parquet")
    some = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(some, SCHEMA).select("*", *more).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{d}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    got = corpus_pipeline.run(spark, f"{tmp_path}/b").collect()
    assert {r.doc_id for r in got} <= {1, None} and all(r.decoded for r in got)


def test_quality_ties_and_private_data_by_hand(spark):
    """A posterior of exactly one half is kept; checksums, context and what speaks against a kind decide the kinds beside the base ones."""
    even = quality.Voters(0.5, (0.5,), (0.5,))
    assert quality.posterior((1,), even) == quality.posterior((-1,), even) == quality.posterior((0,), even) == 0.5
    cases = {
        "iban GB82 WEST 1234 5698 7654 32": ["iban"], "GB82 WEST 1234 5698 7654 33": [], "serial GB82 WEST 1234 5698 7654 32": ["iban"], "DE89370400440532013000": ["iban"],
        "ssn 123-45-6789": ["ssn"], "123-45-6789": [], "social security 000-45-6789": [], "call 555-123-4567": ["local_phone"], "555-123-4567": [], "serial call 555-123-4567": [], "tel (555) 123-4567": ["local_phone"],
    }
    got = pii.find(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    assert [[x.kind for x in r.pii if x.kind_no > 3] for r in sorted(got, key=lambda r: r.doc_id)] == list(cases.values())

    def mod97(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    r = random.Random(4)
    numbers = [f"GB{r.randrange(100):02}WEST{r.randrange(10**14):014}" for _ in range(600)]
    found = pii.find(spark.createDataFrame(list(enumerate(numbers)), "doc_id long, text string")).collect()
    assert {x.doc_id: any(y.kind == "iban" for y in x.pii) for x in found} == {i: mod97(x) for i, x in enumerate(numbers)} and any(map(mod97, numbers))


def test_toxicity_grammar_adds_to_the_lexicon(spark):
    """Where clean documents hold insults too, denied or quoted, the marks that are learned tell them apart; the words alone can't."""
    bad = ["grobian", "schurke", "vermine"]
    r = random.Random(6)

    weak = ["nobody here is a {0}, not a {0}", "someone wrote {0} on the wall", "it was reported as {0} again"]
    strong = ["you are such a {0}", "that is what you are, a {0}", "they called and you are a {0}"]

    def row(i):
        kind = i % 12  # three of twelve with an insult, of which one is denied or quoted; the frames alone are harmless
        frame = r.choice(weak if kind == 0 else strong if kind < 3 else weak + strong)
        said = frame.format(r.choice(bad) if kind < 3 else "tree")
        return (i, f"{prose(5000 + i, 30)}. {said}. {prose(7000 + i, 20)}", None, None, None), (i, int(kind in (1, 2)))

    pairs = [row(i) for i in range(1800)]
    docs, labels = spark.createDataFrame([x for x, _ in pairs], SCHEMA), spark.createDataFrame([y for _, y in pairs], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out("doc_id")))
    assert set(bad) <= set(model.terms)
    held = {x.doc_id for x in labels.where(toxicity.held_out("doc_id")).collect()}
    truth = {i: y for _, (i, y) in pairs}
    plain = toxicity.Model(model.terms, model.weights, 0.0, dict.fromkeys(toxicity.MARKS, 1.0))

    def accuracy(m):
        """On the held-out documents with an insult, at the best threshold."""
        rows = [(x.total, truth[x.doc_id]) for x in toxicity.featured(docs, m).collect() if x.doc_id in held and x.total > 0]
        return max(sum((t >= cut) == bool(y) for t, y in rows) / len(rows) for cut in {t for t, _ in rows})

    assert accuracy(model) > 0.97 and accuracy(plain) < 0.9
    decided = {x.doc_id: x.score >= 0.5 for x in toxicity.featured(docs, model).collect()}
    assert sum(decided[i] == bool(truth[i]) for i in held) / len(held) > 0.97


def _private(r, n):
    """n pieces of prose and of every kind of personal data, right and wrong, with and without context."""
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    kinds = (
        lambda: f"bob{number(2)}@mail{number(1)}.example.org", lambda: ".".join(str(r.randrange(300)) for _ in range(4)), lambda: "4111 1111 1111 1111", lambda: number(16), lambda: f"+1 ({number(3)}) 555-{number(4)}",
        lambda: "GB82 WEST 1234 5698 7654 32", lambda: f"GB82 WEST 1234 5698 7654 {number(2)}", lambda: f"{number(3)}-{number(2)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: "serial", lambda: "ssn", lambda: "call", lambda: "bank account",
        lambda: "ünï 中文 😀", lambda: "some plain words of prose that keep others apart", lambda: "a line\n",
    )
    return " ".join(r.choice(kinds)() for _ in range(n))


def test_all_kinds_of_pii_by_brute_force(spark):
    r = random.Random(21)
    texts = [_private(r, r.choice((1, 5, 40))) for _ in range(300)] + [_private(r, 1500), "😀" * 600 + " call 555-123-4567 " + "é" * 1100 + " ssn 123-45-6789"]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = set()
    for x in got:
        assert [(p.start, p.kind_no, p.end, p.kind, round(p.score, 1)) for p in x.pii if p.kind_no > 3] == brute.pii_scored(x.text), x.text
        assert [f"{p.kind}:{p.start}:{p.end}" for p in x.pii if p.kind_no < 4] == brute.pii(x.text)
        kinds |= {p.kind for p in x.pii}
    assert len(kinds) == 7
    spans = {x.doc_id: x.pii for x in got}
    for x in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        out, at = [], 0
        for p in spans[x.doc_id]:
            if p.start >= at:
                out += [texts[x.doc_id][at : p.start], f"<{p.kind.upper()}>"]
            at = max(at, p.end)
        assert x.text == "".join(out) + texts[x.doc_id][at:]


def test_pii_of_a_text_with_many_matches(spark):
    """A megabyte with some 16 000 spans, which takes minutes where one match costs a pass over the text."""
    text = _private(random.Random(22), 60_000)
    x = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert len(x.pii) > 15_000
    assert [f"{p.kind}:{p.start}:{p.end}" for p in x.pii if p.kind_no < 4] == brute.pii(text)
    assert [(p.start, p.kind_no, p.end, p.kind, round(p.score, 1)) for p in x.pii if p.kind_no > 3] == brute.pii_scored(text)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path):
    """Pages of a megabyte that don't compress, one of 6 MB, and small ones: no file is over its volumes."""
    r = random.Random(31)
    alphabet = [chr(c) for c in range(0x100, 0x2FF)]
    noise = lambda n: "".join(r.choices(alphabet, k=n // 2))
    pages = [(i, f"http://a/{i}", noise(1 << 20)) for i in range(24)] + [(100, "http://a/100", noise(6 << 20)), (101, "http://a/101", noise(6 << 20))] + [(200 + i, f"http://b/{i}", f"small {i}") for i in range(3000)]
    pages += [(5000, "http://a/copy", pages[3][2])]
    path = f"file://{tmp_path}/warc"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    got = {x.source: x for x in warc.archive(df, path).collect()}
    for i, _, html in pages:
        b = html.encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
    assert len(got) == len(pages) and (got[3].record_type, got[3].refers_to) == ("revisit", 5000)
    sizes = [f.stat().st_size for f in Path(f"{tmp_path}/warc").glob("part-*")]
    assert len(sizes) > 2 and max(sizes) <= 8 * (6 << 20)


@pytest.mark.parametrize("pattern", [r"[A-Z][a-z]*|[a-z]+|[^A-Za-z]+", r"\s+|[^\s]{1,3}", r"\p{L}+(?=\s|$)|.|\n"])
def test_bpe_honours_its_pattern(pattern):
    ranks = bpe.read_ranks(Path(VOCAB).read_bytes())
    enc, codec = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), bpe.Codec(ranks, pattern)
    r = random.Random(4)
    texts = ["helloWorld fooBar x", "one two  three\nfour", ""] + ["".join(r.choice("abcXYZé ß\n\t  .,12中") for _ in range(r.randrange(50))) for _ in range(800)]
    for t, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t


def test_bpe_knows_the_given_pattern():
    assert P.PATTERN == bpe.BLANKS
