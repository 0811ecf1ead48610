"""Every op query over odd tables, by its contract: against plain Python, DuckDB or the libraries."""

import base64
import hashlib
import itertools
import math
import os
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import media, packing, quality, toxicity, warc
from emberline.llm.common import table
from emberline.llm.queries import QUERIES, SQL

LONG = " ".join(f"word{k % 977} of the long text number {k % 31}." for k in range(12_000))
TEXTS = [None, "", " \n\t", "a", "a", "Hello hello, WORLD!!", "<|endoftext|> x </s>", "é é ΟΔΟΣ İ 𝄞", "line\nline\n\nother", "a b c d e a b c d e f g h", LONG, LONG + " end", "wörd " * 900, "#* $% & |<>", "z" * 5000, "x\x1cy \x0b z", *(" ".join(f"plain{k}x{j}" for j in range(60)) for k in range(4)), " ".join([*(f"plain1x{j}" for j in range(60)), "more"])]
#: Columns whose names clash with those that operators use inside.
CLASH = ["label", "label_id", "_length", "length", "ids", "words", "fp", "score", "key", "row", "size", "rank", "i", "t", "h", "media", "component", "n", "conv", "raw"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of tables with nulls, empty and very long texts, repeated rows, repeated and null ids, ties and clashing columns; and one of empty tables."""
    folder, nothing = (f"file://{tmp_path_factory.mktemp(x)}" for x in ("odd", "nothing"))
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(4, "a"), (3, "another text of id three"), (None, "no id"), (None, "no id")]
    pages = [(k, f"u{k}", f"<p>{t}</p>" if t else t) for k, t in enumerate(TEXTS)] + [(40, None, "<p>a</p>"), (40, None, "<p>a</p>"), (41, "v", "<div>" * 3000 + "</section>" * 3000)]
    turns = [(k // 4, k % 3, role, t) for k, (t, role) in enumerate(zip(TEXTS * 3, itertools.cycle(["user", "assistant", "assistant", None, "system"])))] + [(0, 0, "user", "same")] * 2 + [(None, None, None, None), (7, 1, "assistant", "</s>[INST] [~SEP]")]
    labels = [(k % len(TEXTS), k % 2, (k // 2) % 2) for k in range(40)] + [(None, 1, 1), (1, None, None)]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("pages", pages, "page_id long, url string, html string"), ("conversations", turns, "conv_id long, turn long, role string, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        df = spark.createDataFrame(rows, schema)
        df = df.withColumns({c: F.lit(c) for c in CLASH}) if name != "labels" else df
        if name == "documents":
            df = df.withColumns({"lang": F.when(F.col("doc_id") % 3 > 0, "en"), "source": F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 5))})
        df.write.parquet(f"{folder}/{name}.parquet")
        df.limit(0).write.parquet(f"{nothing}/{name}.parquet")
    return folder, nothing


def rows_of(spark, folder, name):
    return [r.asDict() for r in table(spark, folder, name).collect()]


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, odd, name):
    out = QUERIES[name](spark, odd[1])
    assert out.count() == (1 if name.startswith("op7") else 0)


def test_op1(spark, odd):
    out = QUERIES["op1_toxicity"](spark, odd[0]).collect()
    docs = rows_of(spark, odd[0], "documents")
    assert Counter(r.doc_id for r in out) == Counter(d["doc_id"] for d in docs)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    rows, rest = toxicity.sample(table(spark, odd[0], "documents"), table(spark, odd[0], "labels"))
    taught = {t for _, t in rows + rest}
    held = {d["text"] or "" for d in docs if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2}
    free = {d["text"] or "" for d in docs if d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2}
    assert taught and not taught & (held - free)
    few, _ = toxicity.sample(table(spark, odd[0], "documents"), table(spark, odd[0], "labels"), most_chars=1000)
    assert sum(len(t) for _, t in few) <= 1000 < sum(len(t) for _, t in rows + rest)


def test_op1_scores_are_those_of_plain_code():
    rng = np.random.default_rng(4)
    weights = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    weights[rng.random(toxicity.BUCKETS) < 0.1] = np.nan
    model = toxicity.Model(weights, -0.3, (-1.0, 0.0, 0.5), (0.1, 0.2, 0.9))
    for text in ["one", "two words", "Same same SAME other", " ".join(f"w{k % 50}" for k in range(301)), "İstanbul 𝄞 é"]:
        found = [w for w, _ in itertools.groupby(re.findall(r"[^\W_]+", text.lower()))]

        def of(word):
            marked = f"<{word}>"
            grams = [marked] + [marked[i : i + k] for k in range(3, 7) for i in range(len(marked) - k + 1)]
            own = [w for g in grams if (w := float(model.weights[zlib.crc32(g.encode()) % toxicity.BUCKETS])) == w]
            return sum(own) / len(own) if own else model.base

        size, step = toxicity.WINDOW, toxicity.STRIDE
        starts = [0] if len(found) <= size else [step * k for k in range(math.ceil((len(found) - size) / step) + 1)]
        best = max(sum(map(of, found[s : s + size])) / len(found[s : s + size]) for s in starts)
        share = 0.1 if best <= -1 else 0.9 if best >= 0.5 else 0.1 + 0.1 * (best + 1) if best < 0 else 0.2 + 1.4 * best
        assert math.isclose(model.score(text), 0.98 * share + 0.02 / (1 + math.exp(-best)), rel_tol=1e-6)


def test_op2(spark, odd):
    out = QUERIES["op2_media_columns"](spark, odd[0]).collect()
    expected = []
    for d in rows_of(spark, odd[0], "documents"):
        data = (d["text"] or "").encode()
        p = media.padded(data)
        expected.append((d["doc_id"] or -1, len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(expected)
    assert len({(r.payload_sha256, r.media_sha256, r.media_bytes, r.feature) for r in out}) == len({r.payload_sha256 for r in out})


def fragmented(runs):
    """An ISO media file of one track whose samples (bytes, key) all come in fragments."""
    entry = media.box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(70))
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), entry), media.full(b"stts", bytes(4)), media.full(b"stsc", bytes(4)), media.full(b"stsz", bytes(8)), media.full(b"stco", bytes(4)))
    mdia = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 25, 0, 0, 0)), media.full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", stbl))
    trak = media.box(b"trak", media.full(b"tkhd", struct.pack(">IIIII", 0, 0, 9, 0, 0), bytes(60)), mdia)
    file = media.box(b"ftyp", b"isom", bytes(4)) + media.box(b"moov", trak, media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 9, 1, 2, 0, 0x10000))))
    for run in runs:
        entries = b"".join(struct.pack(">II", len(x), 0 if key else 0x10000) for x, key in run)
        moof = lambda at: media.box(b"moof", media.full(b"mfhd", bytes(4)), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 9), flags=0x20000), media.full(b"trun", struct.pack(">Ii", len(run), at), entries, flags=0x601)))  # noqa: B023, E731
        file += moof(len(moof(0)) + 8) + media.box(b"mdat", *(x for x, _ in run))
    return file


def test_media_fragments_and_hostile_files(spark):
    runs = [[(b"abc", True), (b"de", False)], [(b"f", False), (b"ghij", True)]]
    good = fragmented(runs)
    (t,) = media.tracks(good)
    assert media.samples(good, t) == b"abcdefghij" and t.keys.tolist() == [0, 3] and t.duration == 8
    plain = media.muxed(media.padded(b"abc"))
    nested = b""
    for _ in range(2000):
        nested = media.box(b"moov", nested)
    at = plain.index(b"stsz") + 8
    huge = plain[:at] + struct.pack(">II", 576, 1 << 31) + plain[at + 8 :]
    at = plain.index(b"stss") + 12
    zero = plain[:at] + bytes(4) + plain[at + 4 :]
    out = {r.id: r for r in media.probe(spark.createDataFrame(list(enumerate([good, nested, huge, zero, plain])), "id int, media binary")).collect()}
    assert out[0].error is None and bytes(out[0].payload) == b"abcdefghij" and out[4].error is None
    assert all(out[k].error and out[k].payload is None for k in (1, 2, 3))


def test_op7_equals_its_sql_on_odd_rows(spark, odd):
    equal_to_sql(spark, "op7_chat_formatting", odd[0], where="conv_id is not null")


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    equal_to_sql(spark, name, "file:///root/testdata/sf0.001")


def equal_to_sql(spark, name, folder, where="true"):
    """The query and its SQL give the same rows, as tuples of the same types."""
    con, local = duckdb.connect(), folder.removeprefix("file://")
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{local}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{local}/{t}.parquet') else ''}')" + (f" where {where}" if t == "conversations" else ""))
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    got = QUERIES[name](spark, folder)
    assert set(names) <= set(got.columns)
    assert Counter(map(tuple, got.where(where).select(*names).collect())) == Counter(cur.fetchall())


def test_op3(spark, odd):
    out = QUERIES["op3_warc"](spark, odd[0]).collect()
    rows = rows_of(spark, odd[0], "pages")
    expected = []
    for r in rows:
        data = (r["html"] or "").encode()
        first = min(x["page_id"] for x in rows if (x["html"] or "") == (r["html"] or ""))
        expected.append((r["page_id"], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if first == r["page_id"] else ("revisit", first))))
    assert sorted(map(str, expected)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out)
    nulls = spark.createDataFrame([(None, "u", "x"), (None, "u", "x"), (None, "u", "y"), (5, "u", "y")], "page_id long, url string, html string")
    assert sorted((r.id, r.record_type) for r in warc.read_archives(warc.stored(nulls)).collect()) == [("5", "response"), ("null", "response"), ("null", "response"), ("null", "revisit")]


def test_op4(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = QUERIES["op4_best_fit_packing"](spark, odd[0]).collect()
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    expected = Counter()
    for d in rows_of(spark, odd[0], "documents"):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 0]
        first = len(ids) - 2048 * (math.ceil(len(ids) / 2048) - 1)
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            expected[d["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert got == expected
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= 2048


def fewest(lengths, capacity):
    """The least number of bins, by trying every partition of a few lengths."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


def test_op4_reduction_keeps_the_optimum():
    rng = np.random.default_rng(2)
    over = 0
    for _ in range(400):
        capacity = int(rng.integers(6, 30))
        lengths = sorted(rng.integers(1, capacity + 1, rng.integers(1, 9)).tolist(), reverse=True)
        plan = packing.Plan(Counter(lengths), capacity)
        exact = fewest(lengths, capacity)
        fixed = Counter()
        for length, a, b, first, _, _ in plan.rows:
            if first < plan.reduced:
                fixed[length] += b - a
        rest = sorted((Counter(lengths) - fixed).elements(), reverse=True)
        assert plan.reduced + fewest(rest, capacity) == exact
        over += plan.sequences - exact
    assert over <= 4


def test_op4_places_alike_when_the_plan_is_not_broadcast(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).alias("start"), (F.col("id") % 7 + 1).alias("length"), F.lit("x").alias("_length"), F.lit("y").alias("rank"))
    a, b = (sorted(map(tuple, packing.packed(d, 10, broadcast_rows=n).collect())) for n in (0, 1000))
    assert a == b and len(a) == 3000


def test_op5(spark, odd):
    out = QUERIES["op5_quality_rules"](spark, odd[0]).collect()
    expected = []
    for d in rows_of(spark, odd[0], "documents"):
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = len({k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)})
        expected.append((d["doc_id"] or -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), again, len(w) < 10 or 100 * again > 20 * len(w)))
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == sorted(expected)
    assert not any(r.kept and r.base_failed for r in out)


def test_op5_verdict_is_the_ordered_list(spark):
    rules = [(quality.Condition("words", True, 3.0), quality.Condition("upper_share", False, 0.5)), (quality.Condition("marks_per_word", True, 0.0),)]
    stats = [dict(zip(quality.STATS, x, strict=True)) for x in itertools.product((2, 5), (9,), (0,), (0,), (0,), (0, 8), (0, 3), (10,))]
    d = spark.createDataFrame([tuple(s.values()) for s in stats], ", ".join(f"{s} long" for s in quality.STATS))
    for r in d.withColumn("rule", quality.verdict(rules)).collect():
        assert r.rule == (1 if r.n_words > 3 and r.n_upper / r.n_chars <= 0.5 else 2 if r.n_marks > 0 else 0)


def test_op6(spark, odd):
    out = QUERIES["op6_html_extraction"](spark, odd[0]).collect()
    assert Counter(r.page_id for r in out) == Counter(r["page_id"] for r in rows_of(spark, odd[0], "pages"))
    assert all(r.n_chars == len(r.text) for r in out) and {r.url for r in out if r.page_id == 40} == {None}
    assert [r.text for r in out if r.page_id == 10] == [LONG]


def test_op7(spark, odd):
    out = {r.conv_id: r for r in QUERIES["op7_chat_formatting"](spark, odd[0]).collect()}
    rows = rows_of(spark, odd[0], "conversations") + [{"conv_id": -1, "turn": k, "role": role, "text": "</s>[INST] ok [/INST]"} for k, role in enumerate(("user", "assistant"))]
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert out[c].n_turns == len(turns) and out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()


def test_op8(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = QUERIES["op8_bpe"](spark, odd[0]).collect()
    expected = []
    for d in rows_of(spark, odd[0], "documents"):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        expected.append((d["doc_id"] or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(expected)


def test_op9(spark, odd):
    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        found = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    docs = rows_of(spark, odd[0], "documents")
    fps = [(d["doc_id"], fingerprint(d["text"])) for d in docs]
    root = {i: i for i, _ in fps if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in fps if x[0] is not None], 2):
        if (a ^ b).bit_count() <= 3:
            p, q = sorted((find(i), find(j)))
            root[q] = p
    out = QUERIES["op9_simhash"](spark, odd[0]).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in out) == Counter((i, f"{f:016x}") for i, f in fps)
    assert all(r.component_id == (None if r.doc_id is None else find(r.doc_id)) for r in out if r.doc_id not in (3, 4))


def test_op10(spark, odd):
    out = QUERIES["op10_token_counts"](spark, odd[0]).collect()
    docs = rows_of(spark, odd[0], "documents")
    assert Counter(r.doc_id for r in out) == Counter(d["doc_id"] for d in docs)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.n_tokens)
    assert by[0] == by[1] == {0} and len(by[None]) == 1 and max(by[10]) > 10_000


def test_pipeline_over_odd_tables(spark, odd):
    import corpus_pipeline

    docs = table(spark, odd[0], "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd[0])
        assert set(out.columns) == set(docs.columns), name
        assert 0 < out.count() < docs.count() or name == "toxicity"
    assert corpus_pipeline.run(spark, odd[0]).count() > 0
    assert corpus_pipeline.run(spark, odd[1]).count() == 0
