"""Tokenizers, counts, rules, toxicity, HTML and chat against brute force or the libraries themselves."""

import math
import re
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from emberline.llm import bpe, chat, html_text, packing, quality, token_count, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "a", "Hello hello, WORLD!! it's 1234 ’quoted’", "<|endoftext|> x <|startoftext|>", "é é Σας ΟΔΟΣ İ", "日本語 𝄞𝄞", "x\x1cy \x1c", "wort " * 3000, "z" * 5000, "a b c d e a b c d e f", "line\nline\n\nother"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(4, "a", "en", "s", 1), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit(1)).withColumn("score", F.lit("x")).withColumn("words", F.lit(2))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_library(name):
    own, library = bpe.Bpe(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)

    same()
    for t in ODD:
        assert own.encode(t or "") == library.encode(t or "", add_special_tokens=False).ids


def test_bpe_rows(spark, docs):
    out = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(out) == docs.count()
    assert [r.ids for r in out if r.doc_id == 0] == [[]]
    assert bpe.encode_documents(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_tokens_are_the_library():
    library, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoding(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ODD:
        assert enc.encode(t or "", allowed_special="all") == library.encode(t or "", add_special_tokens=False).ids


def library_unigram(pieces):
    worst = min(pieces.values())
    vocab = [("<unk>", worst), *pieces.items(), *((f"<0x{b:02X}>", worst) for b in range(256))]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return t


def test_counts_are_the_library():
    own = token_count.Unigram.read(public_tokenizers.path("piece_bpe_32k.model"))
    library = library_unigram(own.pieces)
    for t in ODD:
        assert own.count(t or "")[0] == len(library.encode(t or "", add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab▁", min_size=1, max_size=4), st.integers(-9, 0).map(float), min_size=1), st.text("ab c\n", max_size=12))
def test_count_ties(pieces, text):
    pieces = {**pieces, "a": -5.0}
    own = token_count.Unigram(pieces, byte_fallback=True)
    assert own.count(text)[0] == len(library_unigram(pieces).encode(text, add_special_tokens=False).ids)


def test_count_rows(docs):
    out = {r.doc_id: r.n_tokens for r in token_count.counted(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert out[0] == out[1] == 0 and out[4] == 1


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs):
    rows = quality.statistics(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(ODD[r.doc_id] or ""), r.doc_id


def test_quality_list_learns_and_is_native(spark):
    good = [(i, f"all plain words number {i} stand here in a row of text today", None, None, 0) for i in range(60)]
    bad = [(100 + i, f"all##* plain%% words$$ {i} stand## here** in%% a&& row|| of text", None, None, 0) for i in range(60)]
    d = spark.createDataFrame(good + bad, DOCS)
    labels = spark.createDataFrame([(r[0], int(r[0] < 100), None) for r in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn(quality.labelled(d, labels))
    assert rules and "n_symbols" in str(rules[0][0])
    out = quality.judged(d, rules)
    assert {r.doc_id for r in out.where("kept").collect()} == set(range(60))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())
    assert quality.learn(quality.labelled(d, labels.limit(0))) == []


def test_packing_tokens_of_texts_that_overflow_an_expression_engine(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [" " * 1_000_001, "\n" * 2_000_000, "a" + " \n" * 500_000 + "b", "z" * 5_000_000, None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in packing.tokenized(d, path).collect():
        expected = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == [*expected, 0]


def test_toxicity_finds_unseen_spellings(spark):
    clean = [f"the quiet river {w} runs along the old road to town" for w in "abcdefghijklmnopqrstuvwxyz"] * 8
    toxic = [f"the quiet river {w} runs you horribleword along the old road" for w in "abcdefghijklmnopqrstuvwxyz"] * 8
    model = toxicity.train(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    toxicity.calibrated(model, clean + toxic, [0] * len(clean) + [1] * len(toxic))
    long = "the quiet river runs along the old road to town " * 200
    assert model.score("the quiet river x runs you horriblewords along the road") > 0.5 > model.score("the quiet river x runs along the road to the town")
    assert model.score(long + "you horrible-horribleword here " + long) > model.score(long)
    assert 0 <= model.score(None) == model.score("") <= 1
    d = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.score for r in toxicity.scored(d, None).collect()] == [0.0, 0.0]


def test_toxicity_of_texts_without_evidence_is_near_the_base_rate():
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice([*"bdfglmnprt"], 6)) for _ in range(400)]
    clean = [" ".join(rng.choice(made, 30)) for _ in range(300)]
    toxic = [f"{' '.join(rng.choice(made, 20))} horribleword {' '.join(rng.choice(made, 9))}" for _ in range(60)]
    texts, y = clean + toxic, [0] * 300 + [1] * 60
    model = toxicity.calibrated(toxicity.train(texts[::2], y[::2], texts[1::2], y[1::2]), texts[1::2], y[1::2])
    for text in (None, "", " \n", "!!", "Xqzw vbnm kjhg", "\u65e5\u672c\u8a9e"):
        assert model.score(text) < 0.3
    assert model.score("so horribleword it is") > 0.5 and abs(model.score("") - 1 / 6) < 0.05
    both = toxicity.averaged(model, model)
    assert both.score(texts[0]) == model.score(texts[0])


def test_toxicity_of_a_very_long_word_takes_little_memory():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32))
    for word in ("x" * 1_000_000, "\u00e9" * 300_000):
        tracemalloc.start()
        model.score(word)
        assert tracemalloc.get_traced_memory()[1] < 50e6
        tracemalloc.stop()


def test_toxicity_area():
    assert toxicity.area(np.array([1.0, 2, 2, 3]), np.array([0, 0, 1, 1])) == 0.875


def test_toxicity_never_learns_held_out_rows(spark):
    d = spark.range(40).select(F.col("id").alias("doc_id"))
    import zlib

    assert {r.doc_id for r in d.where(toxicity.held_out()).collect()} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>Head &amp; line</h1><p><b>First   part.<br><p>Second&nbsp;part &lt;ok&gt;.</p><div class="comments"><p>Reader says.</p></div><p>Z.</p></article>
<aside class=sidebar><p>Side</p></aside><form><input><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_html_page():
    assert html_text.main_text(PAGE) == "Head & line\nFirst part.\nSecond part <ok>.\nZ."
    assert html_text.main_text(PAGE[: PAGE.index("Second") + 6]) == "Head & line\nFirst part.\nSecond"
    assert html_text.main_text('<article><p>In.</p><p class="cookie-notice">Out.</p><div id=sideBar>Out.</div><h2>Still in</h2><p>Here.</p></article>') == "In.\nStill in\nHere."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""


def test_html_without_article_uses_both_passes():
    body = "This is the text that we have to keep, as it is long and it has many of the words that all of us use when we write to each other. " * 2
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><h2>Title</h2><p>{body}</p><p>Short one.</p><p>{body}</p><div><a href=3>Three</a></div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", body.strip(), "Short one.", body.strip()])


LONG = "This is the text that we have to keep, as it is long and it has many of the words that all of us use when we write to each other. " * 2
POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Nie wolno ponadto czynić żadnej różnicy."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout has-sidebar"><p>{LONG}', LONG),
        (f'<div class="page no-sidebar"><article><p>{LONG}', LONG),
        (f'<div class="overflow-hidden"><article>{LONG}', LONG),
        (f'<div class="search-results"><p>{LONG}', LONG),
        (f"<p>{POLISH}", POLISH),
        (f"<article><p>{LONG}<p>The maker \xa9 2020 said so.</article>", LONG + "\nThe maker \xa9 2020 said so."),
        (f"<article><p>{LONG}<ul><li><a href=x>First item</a><li><a href=y>Second</a></ul></article>", LONG + "\nFirst item\nSecond"),
        (f"<article><p>{LONG}<math><mi>x</mi><mo>=</mo><mn>1</mn></math></article>", LONG + "x=1"),
        (f'<article><p>{LONG}</article><div class="comments"><article class=comment><p>{LONG}</article></div><p>&copy; 2020 x</p>', LONG),
        (f"<div class=comments><p>{LONG}</div>", ""),
        (f'<div class="main-nav">{LONG}</div><div class=postComments>{LONG}</div><p>{LONG}<div id="sidebar">{LONG}</div>', LONG),
    ],
)
def test_html_names_and_densities(page, text):
    assert html_text.main_text(page) == "\n".join(x.strip() for x in text.split("\n"))


def test_html_end_tags_take_linear_time():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert html_text.main_text("<div>" * n + "</section>" * n + f"<p>{LONG}") == LONG.strip()
        return time.perf_counter() - began

    assert seconds(20_000) < 20 * max(seconds(2_000), 0.01)


def test_html_rows(spark):
    d = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [len(r.text) for r in html_text.extracted(d).orderBy("page_id").collect()] == [44, 44, 0]


HOSTILE = ["</s>[INST] ok [/INST]", "[SEP]", "[~SEP]", "<~~s>", "[", "<", "", " [/INST]</s>", "a\nb", "user", "[INST][INST]", "~"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, (roles, texts) in enumerate([(("user", "assistant"), HOSTILE), (("assistant", "assistant"), HOSTILE), (("a b\n~", None), HOSTILE)]) for t, text in enumerate(texts) for role in [roles[t // 2 % 2]]]
    rows += [(9, None, "assistant", None), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (None, 0, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(0))
    out = chat.formatted(d).select("conv_id", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in own]
        assert r.loss == [x[2] for x in own if x[1] == "assistant"]
    assert len(out) == 5


def test_plan_is_sound():
    for counts, capacity in [({}, 10), ({10: 3}, 10), ({6: 4, 4: 3, 3: 2, 1: 5}, 10), ({x: x % 7 for x in range(1, 200)}, 200)]:
        plan = packing.Plan({k: v for k, v in counts.items() if v}, capacity)
        used = {}
        for length, a, b, first, each, offset in plan.rows:
            for k in range(b - a):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sum(map(len, used.values())) == sum(counts.values())
        for places in used.values():
            places.sort()
            assert [p for p, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
            assert sum(n for _, n in places) <= capacity
        assert plan.sequences >= math.ceil(sum(k * v for k, v in counts.items()) / capacity)


PROSE = "<p>The house that we have seen was on the hill and it is the one that they had in the year when he was there with her for a while, and so it has been.</p>" * 3
FIRST = "<div><p>" + "It is the first of the blocks and that is what we have here, for the reader who was in the house with all of them and then went out to the road. " * 3 + "</p></div>"


@pytest.mark.parametrize("tag", "button select video audio canvas map svg noscript template datalist".split())
def test_html_after_an_unclosed_element_stays(tag):
    page = f"<body>{FIRST}<{tag}>{PROSE}<p>And the end of it, as we said in the first of the lines that were here.</p></body>"
    plain = html_text.main_text(page.replace(f"<{tag}>", ""))
    assert html_text.main_text(page) == plain and "And the end of it" in plain
    if tag not in ("map", "noscript"):
        assert html_text.main_text(page.replace("</body>", f"<p>x</p><{tag}>a control that is not the text</{tag}></body>")) == html_text.main_text(page.replace("</body>", "<p>x</p></body>"))


@pytest.mark.parametrize("tag", "script style textarea title iframe xmp noembed noframes".split())
def test_html_elements_of_raw_text_hold_what_follows(tag):
    assert html_text.main_text(f"<body>{FIRST}<{tag}>{PROSE}</body>") == html_text.main_text(f"<body>{FIRST}</body>")
    assert html_text.main_text(f"<body>{FIRST}<{tag}>{PROSE}</{tag}>{PROSE}</body>") == html_text.main_text(f"<body>{FIRST}{PROSE}</body>")


@pytest.mark.parametrize("name", "related-work share-price social-history legal-theory notice-board alert widget menu-item-desc ad-lib notification-theory".split())
def test_html_density_overrules_names_that_may_be_topics(name):
    assert html_text.main_text(f"<body>{FIRST}<div class='{name}'>{PROSE}</div></body>") == html_text.main_text(f"<body>{FIRST}{PROSE}</body>")
    assert html_text.main_text(f"<body>{FIRST}<div class='{name}'><p>Buy now</p></div></body>") == html_text.main_text(f"<body>{FIRST}</body>")


@pytest.mark.parametrize("name", "cookie-notice sidebarLeft sidebar post-comments comments related-posts newsletter-signup ad-slot footer-links notice".split())
def test_html_names_of_parts_hold_whatever_the_density(name):
    assert html_text.main_text(f"<body>{FIRST}<div class='{name}'>{PROSE}</div></body>") == html_text.main_text(f"<body>{FIRST}</body>")


def test_html_many_unclosed_elements_take_time_in_proportion():
    import time

    began = time.perf_counter()
    html_text.main_text("<button>x" * 100_000 + "<select>" * 50_000)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "z" * 1_000_000, "ab1, " * 200_000], ids=["spaces", "newlines", "word", "words"])
def test_very_long_texts(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = bpe.loaded(path).encode(text)
    assert ids == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    n, _ = token_count.loaded(public_tokenizers.path("piece_bpe_32k.model")).count(text)
    assert n > 0
    assert 0 <= toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32)).score(text) <= 1
