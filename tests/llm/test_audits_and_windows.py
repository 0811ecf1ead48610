"""Source divergence, window packing and the audit of filters: against plain Python, the tokenizers library and enumeration."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emberline.llm import divergence, filter_audit, window_packing
from emberline.llm.common import written

LONG = " ".join(f"Word{k % 977} of the long text number {k % 31}." for k in range(6_000))
TEXTS = [None, "", " \n\t", "a", "a", "Hello hello, WORLD!!", "<|endoftext|> x </s>", "é ÉÉ ΟΔΟΣ İ 𝄞 日本 語", LONG, LONG + " End", "wörd " * 900, "#* $% & |<>", "z" * 5000, "x\x1cy \x0b z\x01w it's o'clock", "A b " * 150, *("the same words of all the texts here " * (k % 4 + 1) + "x" * k for k in range(40))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, [None, "en", "en", "de", ""][k % 5], [None, "a", "b", "c", "d", "e", "f"][k % 7], "clash", 1) for k, t in enumerate(TEXTS)]
    rows += [(4, "a", "en", "a", "clash", 1), (3, "another text", "en", "a", "clash", 1), (None, "no id", None, None, "clash", 1), (None, "no id", None, None, "clash", 1), (900, "1 2 3", "xx", "only", "clash", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part string, n int").repartition(5)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow_divergence(rows, least=10, top=10):
    """The contract of op11, dense and one pair after the other."""
    terms = lambda r: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", low(r["text"]))
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        g = (r["lang"] or "", r["source"] or "")
        groups.add(g)
        df[g[0]].update(set(terms(r)))
        counts[g].update(terms(r))
    out = []
    for lang in {g[0] for g in groups}:
        kept, mine = [t for t, n in df[lang].items() if n >= least], sorted(g for g in groups if g[0] == lang)

        def figures(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = {g: figures(counts[g]) for g in mine}
        q = figures(sum((counts[g] for g in mine), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in mine:
            pairs = [(sum(f(p[g][t], p[h][t]) for t in kept), h[1]) for h in mine if h != g]
            own = [(f(p[g][t], q[t]), t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found in (("pair", pairs), ("term", own)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(*g, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return Counter(out)


def test_divergence(spark, docs, monkeypatch):
    expected = slow_divergence([r.asDict() for r in docs.collect()])
    assert Counter(map(tuple, divergence.audited(docs).collect())) == expected and sum(expected.values()) > 50
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    assert Counter(map(tuple, divergence.audited(docs).collect())) == expected
    assert divergence.audited(docs.limit(0)).count() == 0


def test_divergence_whole_numbers_beyond_64_bits(spark):
    d = spark.createDataFrame([(30_000_000_000, 50_000_000_000, 7)], "c long, n long, v long")
    assert d.select(divergence.per_billion(d.c, d.n, d.v)).first()[0] == 1 + 1_000_000_000 * 30_000_000_002 // 50_000_000_014


def test_sketch_never_underestimates(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(-(2**62), 2**62, 4000), rng.integers(1, 4, 4000), strict=True)]
    rows += [(k, n) for k, _ in rows[:800] for n in (3, 3, 2, 4)]
    total = Counter()
    for k, n in rows:
        total[k] += n
    for width in (1 << 10, 1 << 16):
        bits = np.unpackbits(divergence.sketched(spark.createDataFrame(rows, "key long, documents long").repartition(6), 10, 3, width, 256))
        keys = np.array([*total], np.int64)
        may = np.logical_and.reduce([bits[at] == 1 for at in divergence.cells(keys, 3, width)])
        true = np.array([*total.values()]) >= 10
        assert may[true].all()
        assert width == 1 << 10 or (may & ~true).sum() < 40


def checked_packing(out, expected, capacity, ids_of=None):
    """Each token lies in exactly one piece, each place of a sequence is taken once; the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append(r)
    found = Counter((i, n) for (i, n), rows in by_doc.items() for _ in range(sum(r.start == 0 for r in rows)))
    assert found == expected
    for (_, n), rows in by_doc.items():
        covered = Counter(k for r in rows for k in range(r.start, r.start + r.length))
        assert set(covered) == set(range(n)) and set(covered.values()) == {sum(r.start == 0 for r in rows)}
        if rows[0].id in (ids_of or {}):
            assert b"".join(bytes(r.value) for r in sorted(rows, key=lambda r: r.start)) == ids_of[rows[0].id]
    padding = 0
    for rows in by_sequence.values():
        places = sorted((r.offset, r.length) for r in rows)
        assert [a for a, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1]
        total = sum(n for _, n in places)
        assert 0 < total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_window_packing(spark, docs, broadcast):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = window_packing.pieces(docs, path)
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for r in docs.collect()}
    expected = Counter((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    out = window_packing.packed(rows, broadcast_rows=broadcast).collect()
    assert checked_packing(out, expected, 2048, {k: v for k, v in ids.items() if k not in (3, 4, None)}) == 0
    digests = window_packing.packed(rows, value=F.crc32).collect()
    assert Counter((r.id, r.start, r.length, zlib.crc32(r.value)) for r in out) == Counter((r.id, r.start, r.length, r.value) for r in digests)
    assert window_packing.packed(window_packing.pieces(docs.limit(0), path)).count() == 0


def test_words_encode_as_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    words, library = window_packing.Words(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    letters = [*"abcdefgzéßñüÀΣσ0159.,'-#\x01<|>", "'s", "'ll", "日", "é", "the", "ing"]
    made = [" ".join("".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(200)) for _ in range(20)]
    for text in [*made, "y" * 300_000, " " * 200_000, "\n \t" * 50_000, "ab1," * 50_000, *(t or "" for t in TEXTS)]:
        assert words.encode([text])[0] == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    whole = window_packing.Words(public_tokenizers.path("byte_bpe_50k.json"))
    assert not whole.by_word and len(whole.encode(["two words"])[0]) == 8


def test_words_encode_alike_when_the_cache_turns_over(monkeypatch):
    words = window_packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"word{k} again," for k in range(i, i + 30)) for i in range(0, 200, 10)]
    expected = [words.encode([t])[0] for t in texts]
    monkeypatch.setattr(window_packing, "CACHE_WORDS", 7)
    assert [words.encode([t])[0] for t in texts] == expected


def test_combinations_are_all_of_them():
    rng = np.random.default_rng(1)
    for capacity in (1, 2, 7, 12, 24):
        lengths = np.flatnonzero(rng.random(capacity + 1) < 0.7)
        lengths = lengths[lengths > 0]
        found = [tuple(c) for c in window_packing.combinations(lengths, capacity).tolist()]
        every = {tuple(sorted((*c, *[0] * (3 - len(c))), reverse=True)) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths.tolist(), n) if sum(c) == capacity}
        assert len(found) == len(set(found)) and set(found) == every


def test_repeats_are_the_least_squares(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        capacity = int(rng.integers(6, 40))
        target = rng.integers(0, 50, capacity + 1)
        target[0] = 0
        columns = window_packing.combinations(np.flatnonzero(target), capacity)
        if not len(columns):
            continue
        found = window_packing.Repeats(columns, target, rounds=200, steps=3000, tolerance=1e-9)
        rest = target - found._used(found.columns, found.x, capacity + 1)
        gain = found._gain(columns, rest)
        # the conditions of an optimum: no column would gain, and those in use are balanced
        assert gain.max() <= 1e-2 * target.max() and np.abs(found._gain(found.columns, rest)).max(initial=0) <= 1e-2 * target.max()
        dense = np.zeros((capacity + 1, len(columns)))
        for j, c in enumerate(columns.tolist()):
            for x in c:
                dense[x, j] += x > 0
        x = np.zeros(len(columns))
        step = 1 / np.linalg.norm(dense, 2) ** 2
        for _ in range(20_000):
            x = np.maximum(0, x + step * dense.T @ (target - dense @ x))
        assert (rest**2).sum() <= ((target - dense @ x) ** 2).sum() * 1.001 + 1e-3


def test_plans_leave_no_padding_and_cut_little():
    rng = np.random.default_rng(6)
    for capacity in (8, 16, 64):
        for n in (0, 1, 5, 400):
            lengths = rng.integers(1, capacity + 1, n).tolist()
            plan = window_packing.Plan(Counter(lengths), capacity)
            total = sum(lengths)
            assert sum((b - a) * x for x, a, b, *_ in plan.rows) + sum((b - a) * x for x, a, b, _ in plan.stream) == total
            left = total % capacity
            assert plan.sequences == total // capacity + left.bit_count()
            assert plan.cuts <= total // capacity + capacity.bit_length()
    even = window_packing.Plan(Counter({5: 300, 3: 300, 8: 7, 4: 100, 2: 100}), 8)
    assert not even.cuts and not even.stream


def slow_audit(rows, labels):
    """The contract of op13, order by order and document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = r["doc_id"] is not None and any(x["doc_id"] is not None and x["doc_id"] < r["doc_id"] and (x["text"] or "") == t for x in rows)
        docs.append((r["lang"] or "", fails, r["doc_id"] in good, r["doc_id"] in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                shapley[x] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(d[1][x] for d in own) - len(gone), sum(d[1][x] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), x]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark, docs):
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 40, 3)] + [(None, 1, 1), (1, None, None), (3, 1, 0), (3, 0, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    expected = slow_audit([r.asDict() for r in docs.collect()], labels)
    out = filter_audit.audited(docs, known).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out} == expected and len(out) == len(expected)
    assert filter_audit.audited(docs.limit(0), known.limit(0)).count() == 0


def test_audit_counts_each_edge_once(spark, docs):
    flags = written(filter_audit.flagged(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    found = filter_audit.edges(flags)
    by_part = Counter(r.part for r in found.where("state = ''").collect())
    assert set(by_part.values()) == {5} and found.select("part", "state", "letter").distinct().count() == found.count()
    assert found.select("state", "letter").distinct().count() <= 80 and found.where("length(state) = 2").select("state").distinct().count() <= 10
    assert not spark.sparkContext._jsc.getPersistentRDDs()
