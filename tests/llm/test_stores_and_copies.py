"""Media, WARC, packing, SimHash and the pipeline against brute force."""

import itertools
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm import media, packing, simhash, warc
from emberline.llm import near as near_copies
from emberline.llm.components import components

CASES = [None, "", "a", "é" * 300, "x" * 576, "y" * 40_000]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40_000))
def test_media_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 576 == 0 and len(payload) >= 576
    file = media.muxed(payload)
    (track,) = media.tracks(file)
    assert media.samples(file, track) == payload
    assert (track.codec, track.duration, len(track.sizes)) == ("raw ", len(payload) // 576, len(payload) // 576)
    for k in track.keys:
        assert file[track.offsets[k] : track.offsets[k] + 576] == payload[576 * k : 576 * k + 576]


def test_media_bad_files(spark):
    file = media.muxed(media.padded(b"abc"))
    cut = file[:-10]
    wild = file.replace(b"stsz", b"stsx")
    rows = spark.createDataFrame([(0, None), (1, b""), (2, b"12345678901"), (3, cut), (4, wild), (5, file)], "id long, media binary")
    out = {r.id: r for r in media.probe(rows).collect()}
    assert all(out[i].error and out[i].payload is None for i in range(5)) and out[5].error is None


def test_media_rows(spark):
    d = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit(1))
    for r in media.probe(media.store(d)).collect():
        data = (CASES[r.doc_id] or "").encode()
        assert r.payload == media.padded(data) and r.n_bytes == len(data)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=30))
def test_archive_round_trip(payloads):
    records = [warc.record(str(i), "http://x/é", p, warc.digest(p), None) for i, p in enumerate(payloads)]
    file = warc.archive(records)
    assert struct.unpack_from("<I", file)[0] == warc.DICTIONARY_MAGIC
    assert list(warc.records_of(file)) == records
    assert [warc.parsed(r)[2] for r in records] == payloads
    if records:
        with pytest.raises(Exception):  # noqa: B017
            list(warc.records_of(file[:-3]))


def test_warc_rows(spark):
    htmls = ["a", "b", "a", None, "", "ü" * 1000, "a", "b\r\n\r\nc"]
    rows = [(9 - i, f"u{i}", h) for i, h in enumerate(htmls)] + [(4, None, "lone")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(0)).withColumn("data", F.lit(0))
    for least in (0, 2):
        out = sorted((int(r.id), r.record_type, r.payload_bytes, r.payload_digest, r.refers_to and int(r.refers_to)) for r in warc.read_archives(warc.stored(d, least)).collect())
        expected = []
        for i, _, h in rows:
            data = (h or "").encode()
            first = min(j for j, _, k in rows if (k or "").encode() == data) if len(data) >= least else i
            expected.append((i, "response" if first == i else "revisit", len(data), warc.digest(data), None if first == i else first))
        assert out == sorted(expected)
    assert warc.read_archives(warc.stored(d.limit(0))).count() == 0


def test_packing_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, 3, 7, 7, 7, 10])) for i in range(500)] + [(3, 7)] * 5
    d = spark.createDataFrame(rows, "doc_id long, length long").withColumn("piece", F.lit(0)).withColumn("start", F.lit(0))
    out = packing.packed(d, 10).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 10
    assert packing.packed(d.limit(0), 10).count() == 0


def test_pieces(spark):
    d = spark.createDataFrame([(1, bytes(4 * 25)), (2, bytes(4))], "doc_id long, ids binary")
    out = [(r.doc_id, r.piece, r.start, r.length, len(r.ids)) for r in packing.pieces(d, 10).orderBy("doc_id", "piece").collect()]
    assert out == [(1, 0, 0, 5, 20), (1, 1, 5, 10, 40), (1, 2, 15, 10, 40), (2, 0, 0, 1, 4)]


def brute_components(fps, radius):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("group_rows", [20_000, 40])
def test_links_lose_nothing(spark, group_rows):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {i: rng.getrandbits(64) for i in range(300)}
    fps |= {300 + i: centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for i in range(200)}
    fps |= {500 + i: fps[rng.randrange(300)] ^ sum(1 << b for b in rng.sample(range(64), 3)) for i in range(100)}
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    prints = spark.createDataFrame([*signed, (None, 7)], "doc_id long, fp long")
    out = {r.doc_id: r.component for r in simhash.clustered(prints, group_rows=group_rows).collect()}
    assert out.pop(None) is None
    assert out == brute_components(fps, 3)


def test_pigeonhole_thresholds(spark):
    rng = np.random.default_rng(0)
    for radius in (3, 7):
        shares = [rng.dirichlet(np.ones(9)) for _ in range(6)]
        cost, ts = simhash.thresholds(shares, 1e5, radius)
        assert sum(t + 1 for t in ts) == radius + 1
        choices = [x for x in itertools.product(range(-1, radius + 1), repeat=6) if sum(t + 1 for t in x) == radius + 1]
        assert math.isclose(cost, min(sum(simhash.cost(s, 1e5, t) for s, t in zip(shares, x, strict=True)) for x in choices))
    fps = [rng.integers(0, 1 << 62, dtype=np.int64).item() & 0x0F0F for _ in range(200)]
    bits = [[0, 1, 2, 9], [3, 8, 10, 11, 12]]
    shares, n = simhash.distances(spark.createDataFrame([(x,) for x in fps], "fp long"), [("fp", g) for g in bits])
    assert n == 200
    for share, group in zip(shares, bits, strict=True):
        each = Counter(sum((a ^ b) >> k & 1 for k in group) for a in fps for b in fps)
        assert np.allclose(share, [each[d] / 200**2 for d in range(len(group) + 1)])
    assert sorted(b for g in simhash.grouped_bits(np.abs(rng.normal(size=(64, 64))), 8) for b in g) == list(range(64))


def test_probes_fit_the_rows(spark):
    shares = [np.array([math.comb(8, d) / 256 for d in range(9)])] * 8
    two = simhash.merged(shares[:2])
    assert np.allclose(two, [math.comb(16, d) / 65536 for d in range(17)])
    few, many = (min((simhash.thresholds([simhash.merged(shares[:k]), simhash.merged(shares[k:])], n, 3)[0], k) for k in range(1, 8))[0] for n in (1e4, 1e9))
    assert few < many
    rate = near_copies.differing_rate(0.8)
    ts = simhash.likely([two] * 64, 1e6, rate, 0.01)
    missed = math.prod(1 - sum(math.comb(16, d) * rate**d * (1 - rate) ** (16 - d) for d in range(t + 1)) for t in ts)
    assert missed <= 0.01
    with pytest.raises(ValueError):
        simhash.likely([two] * 4, 1e6, rate, 0.01)


def test_fingerprint_cases(spark):
    assert simhash.shingles("A  b\tC d", 3) == [b"a b c", b"b c d"]
    assert simhash.shingles("A É", 3) == ["a É".encode()]
    assert int(simhash.fingerprint(None)[0]) == int(simhash.fingerprint(" \n")[0]) == 0
    d = spark.createDataFrame([(1, None), (2, " "), (3, "x"), (3, "x"), (None, "x")], "doc_id long, text string").withColumn("fp", F.lit("clash"))
    out = {(r.doc_id, r.component) for r in simhash.clustered(simhash.fingerprints(d)).collect()}
    assert out == {(1, 1), (2, 1), (3, 3), (None, None)}
    assert simhash.clustered(simhash.fingerprints(d.limit(0))).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_near_copies_leave_one(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(20)]
    rows = list(enumerate(base))
    for k in range(5):
        words = base[k].split()
        words[17] = "changed"
        rows.append((100 + k, " ".join(words)))
    rows += [(200, base[7]), (3, base[3]), (None, base[0]), (300, None), (301, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in near_copies.without_copies(d).collect()]
    assert sorted(k for k in kept if k is not None) == [*range(20), 300] and kept.count(None) == 1


def jaccard(a, b):
    a, b = ({*simhash.shingles(t, 5)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_are_those_of_exact_jaccard(spark):
    rng = random.Random(8)
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 60, 150, 400]))]
        texts.append(" ".join(words))
        for _ in range(4):
            other = list(words)
            for at in rng.sample(range(len(words)), min(len(words), rng.randrange(1 + len(words) // 30))):
                other[at] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(other))
    # texts that only share one line, over and over, and a passage of many texts that are no copies
    texts += [" ".join(["one line that comes again and again"] * 60 + [f"y{k}{j}" for j in range(25)]) for k in range(3)]
    passage = " ".join(f"p{j}" for j in range(40))
    texts += [" ".join(f"q{k}_{j}" for j in range(60)) + " " + passage for k in range(80)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    sets = [{*simhash.shingles(t, 5)} for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            s = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            near += 0.8 <= s < 0.9
            if s >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert near > 20
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = [i for i in range(300, 303)]
    assert all(jaccard(texts[a], texts[b]) < 0.8 for a in lines for b in lines if a < b)
    kept = {r.doc_id for r in near_copies.without_copies(d).collect()}
    assert kept == {i for i in range(len(texts)) if find(i) == i}


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_at_a_similarity(spark, similarity):
    """Pairs of exactly this similarity: of n shingles each has n (1 - s) / (1 + s) to itself, at the end."""
    rng = random.Random(int(similarity * 100))
    texts = []
    for k in range(300):
        n = rng.choice([60, 120, 300])
        own = math.floor((n - 4) * (1 - similarity) / (1 + similarity) + 1e-9)
        common = [f"c{k}_{rng.randrange(10**9)}" for _ in range(n - own)]
        texts += [" ".join(common + [f"{side}{k}_{j}" for j in range(own)]) for side in "ab"]
    exact = [k for k in range(300) if jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8]
    near_exact = [jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(300)]
    assert abs(sum(near_exact) / 300 - similarity) < 0.02 and len(exact) > 80
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.doc_id: r.component for r in near_copies.near_duplicates(d).collect()}
    found = [k for k in range(300) if of[2 * k + 1] == 2 * k]
    assert set(found) <= set(exact) and len(found) >= 0.95 * len(exact)


def test_no_link_of_short_texts_is_lost(spark):
    """Texts of up to nine shingles, each with some that lack one or have another: components are those of all pairs where no set is larger than SHORT."""
    rng, texts = random.Random(11), []
    for k in range(60):
        words = [f"w{k}_{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 13))]
        texts += [" ".join(words), " ".join(words[1:]), " ".join(words[:-1]), " ".join([*words, "more"]), " ".join(words[:-2])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a - a % 5, a):
            if max(len(near_copies.shingle_set(texts[i])) for i in (a, b)) <= near_copies.SHORT and jaccard(texts[a], texts[b]) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r.doc_id: r.component for r in near_copies.near_duplicates(d).collect()}
    assert all(of[i] == of[find(i)] for i in range(len(texts)))
    assert sum(find(i) != i for i in range(len(texts))) > 60
    assert all(jaccard(texts[2], texts[2 + 5 * k]) == 0 and of[2] != of[2 + 5 * k] for k in range(1, 60))


def test_pipeline_runs_on_small_tables(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert 0 < out["doc_id"].nunique() < docs
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()
