"""Code operators: keys, funnel, variants, splicing, sandbox."""

import ast

import pytest

from emberline.operators import codeops, rewrites, sandbox
from emberline.sources.files import read_jsonl, write_jsonl

INPUTS = {"shared": "[[[3, 1, 2], [1, 2]], [[5], []]]", "looked_up": "[[[[1, 2], [1, 3], [4, 5]], [1, 4, 9]], [[], []]]", "listed": '[[["a", "b"]], [[]]]'}
GOOD = "def total(xs):\n    out = 0\n    for x in xs:\n        out += x\n    return out\n"


def key(source):
    return codeops.structural_key(ast.parse(source).body[0])


def test_key_ignores_names_and_docstrings():
    other = 'def summed(values: list) -> int:\n    """Doc."""\n    acc = 0\n    for v in values:\n        acc += v\n    return acc\n'
    assert key(GOOD) == key(other) != key(GOOD.replace("+=", "-=")) and key(GOOD) != key(GOOD.replace("0", "1"))


@pytest.mark.parametrize(
    ("source", "reason"),
    [
        (GOOD, None),
        (GOOD.replace("0", "LIMIT"), "module_name"),
        (GOOD.replace("out += x", "print(open(x))"), "forbidden_name"),
        (GOOD.replace("return out", "yield out"), "statements"),
        ("def f(x):\n    a = 1\n    b = 2\n    return a + b\n", "no_loop"),
        ("def f(x):\n    return x\n", "length"),
        ("import os\n" + GOOD.replace("out += x", "out += os.x(x)"), "module_name"),
        ("def f(*xs):\n" + GOOD.partition("\n")[2], "parameters"),
    ],
)
def test_funnel(source, reason):
    rows = list(codeops.candidates(source))
    assert [r[4] for r in rows] == [reason]
    assert list(codeops.candidates("def broken(")) == list(codeops.candidates(None)) == []


def test_imports_are_carried():
    source = "import math\n" + GOOD.replace("out += x", "out += math.sqrt(x)")
    (row,) = codeops.candidates(source)
    assert row[1].startswith("import math\ndef total")


def test_variants_are_undone_and_behave(spark):
    rows = codeops.snippets(spark).collect()
    families = set()
    for name, source in rows:
        for family, variant, _ in codeops.variants(source, codeops.SLOWER):
            families.add(family)
            inputs = INPUTS.get(name, "[[[3, 1, 2]], [[5, 5]]]")
            assert sandbox.evaluate(source, variant, name, inputs)["status"] == "ok", (family, variant)
    assert families == set(codeops.SLOWER)
    for family, source in [("worse_builtins", rows[0][1]), ("materialize", rows[1][1]), ("append_to_concat", rows[3][1])]:
        slow = next(v for f, v, _ in codeops.variants(source, codeops.SLOWER) if f == family)
        assert ast.unparse(ast.parse(source)) + "\n" in [v for _, v, _ in codeops.variants(slow, codeops.FASTER)]


@pytest.mark.parametrize(
    ("candidate", "status"),
    [
        (GOOD, "ok"),
        (GOOD.replace("+=", "-="), "incorrect"),
        (GOOD.replace("return out", "return float(out)"), "incorrect"),
        ("def total(", "syntax_error"),
        ("import os\n" + GOOD, "static_error"),
        ("x = 1 / 0\n" + GOOD, "load_error"),
        ("while True:\n    break\n" + GOOD, "static_error"),
        (GOOD.replace("out = 0", "out = 0 if getattr(xs, '_a', 0) else 0"), "static_error"),
        (GOOD.replace("out = 0", "out = getattr(xs, 'nothing', 0)"), "ok"),
        (GOOD.replace("out = 0", "out = 0 * len(xs.__class__.__name__)"), "static_error"),
        (GOOD.replace("out = 0", "out = type(xs) and 0"), "static_error"),
        (GOOD.replace("out = 0", "print(xs)\n    out = 0"), "incorrect"),
        (GOOD.replace("out = 0", "xs.append(0)\n    out = 0"), "incorrect"),
        (GOOD.replace("out = 0", "out = [0] * 10 ** 9"), "incorrect"),
        (GOOD.replace("out = 0", "while True: pass"), "timeout"),
    ],
)
def test_sandbox(candidate, status):
    found = sandbox.evaluate(GOOD, candidate, "total", "[[[1, 2, 3]], [[]]]", timeout_s=3)
    assert found["status"] == status or (status == "timeout" and found["status"] == "resource")


def test_splice():
    base = "def a(x):\n    return x\n\ndef b(x):\n    return a(x)\n"
    out = codeops.functions_of(codeops.spliced(base, "import math\ndef b(x):\n    return 2\ndef c(x):\n    return 3\n"))
    assert [*out] == ["a", "b", "c"] and out["b"].endswith("return 2")
    assert codeops.spliced(base, "x = 1") is None


def test_jsonl_limit_counts_blank_lines(spark, tmp_path):
    file = tmp_path / "x.jsonl"
    file.write_text('{"a": 1, "b": NaN}\n\n{"a": 2, "b": Infinity}\n{"a": 3}\n')
    assert [r.a for r in read_jsonl(spark, str(file), "a int, b double", limit=3).collect()] == [1, 2]
    assert len([r for r in read_jsonl(spark, str(file), "a int, b double").collect() if r.a]) == 3
    write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert read_jsonl(spark, str(tmp_path / "out"), "a int, b string").collect() == [(1, None)]


def test_static_rules():
    told = codeops.static_error
    assert told("import re\n" + GOOD, "total") is None and told("import re\n" + GOOD, "total", codeops.MINED_MODULES) == "import"
    assert told("import array\n" + GOOD, "total") is None and told("import random\n" + GOOD, "total") == "import"
    assert told("from . import x\n" + GOOD, "total") == "import" and told(GOOD, "other") == "no_target"
    assert told("'doc'\nx: int = 1\n" + GOOD, "total") is None and told("if 1:\n    pass\n" + GOOD, "total") == "top_level"
    assert told(GOOD.replace("out += x", "hasattr(x, '_a')"), "total") == "reflection"


def test_values_cross_the_boundary():
    for v in [1, True, None, "é", 1.5, float("inf"), (1, [2, {3: {4}}]), frozenset({1}), b"x", bytearray(b"y"), 1 + 2j, {}, {"f": 1}, [(), set()]]:
        assert sandbox.unpack(sandbox.pack(v)) == v and type(sandbox.unpack(sandbox.pack(v))) is type(v)


def test_baseline_and_groups():
    driven = "def a(x):\n    return x\n\n\ndef b(x):\n    return sum(range(x))\n\n\ndef run_entry(k, *args):\n    return (a, b)[k](*args)\n"
    got = sandbox.baseline(driven, "run_entry", "[[0, 3], [1, 2000]]", by_group=True, repeats=3)
    assert got["status"] == "ok" and [e["value"] for e in got["expected"]] == [3, 1999000] and got["group_ns"]["1"] > got["group_ns"]["0"]
    same = sandbox.evaluate(driven, driven, "run_entry", "[[0, 3], [1, 2000]]", expected=got["expected"], repeats=3)
    assert same["status"] == "ok" and same["n_pass"] == 2
    cached = "cache = {}\ndef f(x):\n    if x in cache:\n        return cache[x]\n    cache[x] = sum(range(x))\n    return cache[x]\n"
    plain = "def f(x):\n    return sum(range(x))\n"
    assert sandbox.evaluate(plain, cached, "f", "[[200000]]", repeats=3)["ratio"] > 0.5, "a cache outlived a repeat"


def test_every_family_has_an_inverse():
    assert set(rewrites.INVERSE) == set(rewrites.SLOWER) and set(rewrites.INVERSE.values()) == set(rewrites.FASTER)


def test_undoing_gives_the_source_back(spark):
    def plain(text):
        return codeops.structural_key(ast.parse(text).body[0])

    exact, tried = set(), set()
    for name, source in codeops.snippets(spark).collect():
        for family, variant, _ in rewrites.variants(source, rewrites.SLOWER):
            tried.add(family)
            proposals = list(rewrites.variants(variant, rewrites.FASTER, 6))
            assert any(f == rewrites.INVERSE[family] for f, _, _ in proposals), (name, family, variant)
            if any(plain(p) == plain(source) for _, p, _ in proposals):
                exact.add(family)
            for _, p, _ in proposals:
                compile(p, "p", "exec")
    assert tried == set(rewrites.SLOWER) and len(exact) >= 8


@pytest.mark.parametrize(
    ("family", "source"),
    [
        ("minmax", "def f(xs):\n    return sorted(xs, reverse=True)[0]\n"),
        ("setdefault", "def f(d, k, v):\n    if k not in d:\n        d[k] = [v]\n    else:\n        d[k] = d[k] + [v]\n    return d\n"),
        ("join", "def f(ws):\n    out = ''\n    for w in ws:\n        out = out + w\n    return out\n"),
        ("dict_lookup", "def f(ps, k):\n    return next((v for a, v in reversed(ps) if a == k), None)\n"),
        ("set_membership", "def f(xs, ys):\n    n = 0\n    for x in xs:\n        n += x in ys\n    return n\n"),
        ("append", "def f(xs):\n    out = []\n    for x in xs:\n        out += [x]\n    return out\n"),
    ],
)
def test_faster_families(family, source):
    assert family in [f for f, _, _ in rewrites.variants(source, rewrites.FASTER)]


@pytest.mark.parametrize(
    "source",
    [
        "def f(xs):\n    m = max(xs)\n    for x in xs:\n        xs = xs + [m]\n    return xs\n",
        "def f(xs):\n    m = [0]\n    for x in xs:\n        m.append(x)\n    return m\n",
        "def f(xs, ys):\n    s = set(ys)\n    ys.append(1)\n    return [x in s for x in xs]\n",
    ],
)
def test_what_changes_is_not_inlined(source):
    assert not any(f.startswith("unhoist") or f == "set_to_list_membership" for f, _, _ in rewrites.variants(source, rewrites.SLOWER))
