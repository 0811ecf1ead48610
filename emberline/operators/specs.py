"""Argument specs: what a parameter may be, guessed from its use, and values of a spec. Draws are by hash of a seed."""

from __future__ import annotations

import ast
import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import product

from emberline.operators.codeops import parsed
from emberline.operators.sandbox import pack

# The specs in their order, the methods that tell a kind, and the sizes of inputs.
SPECS = ("list_int", "list_str", "str", "int_size", "int_small", "list_float", "float", "list_pair_int", "list_list_int", "dict_str_int", "dict_int_int", "set_int", "bool")
LIST_METHODS = frozenset("append extend pop insert sort reverse index remove copy clear".split())
STR_METHODS = frozenset("split strip lstrip rstrip lower upper startswith endswith replace find rfind isdigit isalpha isspace isupper islower title capitalize encode splitlines partition".split())
DICT_METHODS = frozenset("items keys values get setdefault update".split())
SET_METHODS = frozenset("add discard union intersection difference issubset issuperset".split())
SEQUENCE_CALLS = frozenset("sum max min sorted set list tuple any all enumerate reversed".split())
SIZES = (1, 2, 3, 5, 8, 13, 21, 34, 60, 120)
ACCEPTANCE_SIZES = (0, 1, 2, 3, 5, 8, 13, 21, 34)
#: Points that every parameter starts with.
PRIOR = {"list_int": 0.3, "int_size": 0.2, "str": 0.2, "list_str": 0.1}


def draw(*key: object) -> float:
    """A number from 0 to 1, fixed by the key."""
    return int(hashlib.sha1("|".join(map(str, key)).encode()).hexdigest()[:15], 16) / 16**15


def between(low: int, high: int, *key: object) -> int:
    return low + int(draw(*key) * (high - low + 1))


def ints(n: int, seed: object, low: int | None = None, high: int | None = None) -> list[int]:
    low, high = (-n - 5, n + 5) if low is None else (low, high)
    return [between(low, high, seed, "int", i) for i in range(n)]


def floats(n: int, seed: object, low: float = -100.0, high: float = 100.0) -> list[float]:
    return [low + (high - low) * draw(seed, "float", i) for i in range(n)]


def word(seed: object, most: int = 5) -> str:
    return "".join(chr(97 + between(0, 25, seed, "letter", i)) for i in range(between(1, most, seed, "length")))


def words(n: int, seed: object, vocabulary: int = 200, most: int = 6) -> list[str]:
    return [word((seed, between(1, max(1, vocabulary), seed, "word", i)), most) for i in range(n)]


def text(n: int, seed: object, spaces: int = 3) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz" + " " * spaces
    return "".join(letters[between(0, len(letters) - 1, seed, "text", i)] for i in range(n))


def pairs(n: int, seed: object) -> list[tuple[int, int]]:
    return [(between(0, n + 3, seed, "a", i), between(0, n + 3, seed, "b", i)) for i in range(n)]


def int_pairs(n: int, seed: object) -> tuple[list[int], list[int]]:
    return ints(n, (seed, 0)), ints(n, (seed, 1))


def lists_of_ints(n: int, seed: object, most: int = 6) -> list[list[int]]:
    return [ints(between(0, most, seed, "size", i), (seed, i)) for i in range(n)]


def sentence(n: int, seed: object) -> str:
    return " ".join(words(n, seed))


def generated(spec: str, n: int, seed: object) -> object:
    """A value of the spec with about n elements."""
    match spec:
        case "list_int":
            return ints(n, seed)
        case "list_str":
            return words(n, seed)
        case "str":
            return text(n, seed, 2)
        case "int_size":
            return between(n // 2, n, seed, "n") if n > 0 else between(0, 1, seed, "n")
        case "int_small":
            return between(-3, 12, seed, "n")
        case "list_float":
            return [round(x, 3) for x in floats(n, seed)]
        case "float":
            return round(floats(1, seed)[0], 3)
        case "list_pair_int":
            return pairs(n, seed)
        case "list_list_int":
            return lists_of_ints(n, seed)
        case "dict_str_int":
            return {w: between(-50, 50, seed, "value", i) for i, w in enumerate(words(n, seed))}
        case "dict_int_int":
            return {k: between(-50, 50, seed, "value", i) for i, k in enumerate(ints(n, seed))}
        case "set_int":
            return {*ints(n, seed)}
        case "bool":
            return draw(seed, "bool") < 0.5
    raise ValueError(spec)


def arguments(specs: tuple[str, ...], n: int, seed: object) -> tuple:
    return tuple(generated(s, n, (seed, k)) for k, s in enumerate(specs))


def packed(inputs: list) -> str:
    """Argument lists as the sandbox reads them."""
    return json.dumps([[pack(x) for x in args] for args in inputs])


def make_inputs(specs: tuple[str, ...], seed: object, perf_scale: int, n_correct: int = 10, n_perf: int = 3, edges: list[tuple] = (), least: int = 0) -> tuple[list[tuple], list[tuple]]:
    """(correctness inputs: the edge cases and one of each size; workloads of about perf_scale, each by a factor of 0.7 to 1.3)."""
    correct = [*edges, *(arguments(specs, max(least, n), (seed, "correct", n)) for n in SIZES[:n_correct])]
    perf = [arguments(specs, max(least, int(perf_scale * (0.7 + 0.6 * draw(seed, "scale", k)))), (seed, "perf", k)) for k in range(n_perf)]
    return correct, perf


def _number(n: ast.AST) -> bool:
    return isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool)


def _string(n: ast.AST) -> bool:
    return isinstance(n, ast.Constant) and isinstance(n.value, str)


def _told(n: ast.AST, name: str) -> Iterator[tuple[str, float]]:
    """What one node says about the parameter `name`: (spec, points)."""
    is_it = lambda x: isinstance(x, ast.Name) and x.id == name
    match n:
        case ast.Call(func=ast.Attribute(value=ast.Name(id=of), attr=attr)) if of == name:
            for methods, points in ((LIST_METHODS, {"list_int": 2, "list_str": 1.5}), (STR_METHODS, {"str": 3}), (DICT_METHODS, {"dict_str_int": 3, "dict_int_int": 2}), (SET_METHODS, {"set_int": 3}), ({"count"}, {"list_int": 1, "str": 1})):
                if attr in methods:
                    yield from points.items()
        case ast.Call(func=ast.Name(id="range"), args=args) if any(map(is_it, args)):
            yield "int_size", 4
        case ast.Call(func=ast.Name(id="len"), args=[x, *_]) if is_it(x):
            yield from {"list_int": 1, "str": 1, "list_str": 0.5}.items()
        case ast.Call(func=ast.Name(id=f), args=[x, *_]) if f in SEQUENCE_CALLS and is_it(x):
            yield from {"list_int": 1.5, "list_float": 0.5}.items()
        case ast.Call(func=ast.Attribute(value=ast.Constant(), attr="join"), args=[x, *_]) if is_it(x):
            yield "list_str", 4
        case ast.Subscript(value=x, slice=at) if is_it(x):
            yield from ({"dict_str_int": 3} if _string(at) else {"list_int": 1, "str": 0.5, "list_list_int": 0.3}).items()
        case ast.For(target=target, iter=x) | ast.comprehension(target=target, iter=x) if is_it(x):
            yield from {"list_int": 1, "list_str": 0.8, "str": 0.5}.items()
            if isinstance(target, ast.Tuple) and len(target.elts) == 2:
                yield "list_pair_int", 4
            elif isinstance(target, ast.Name) and isinstance(n, ast.For):
                for s in (*n.body, *n.orelse):
                    for inner in ast.walk(s):
                        yield from _told_of_element(inner, target.id)
        case ast.BinOp(left=a, op=op, right=b) if is_it(a) or is_it(b):
            other = b if is_it(a) else a
            if _number(other) or isinstance(op, ast.Mod | ast.FloorDiv):
                yield from {"int_small": 2, "float": 1}.items()
            elif _string(other):
                yield "str", 2
        case ast.Compare(left=a, ops=ops, comparators=others):
            if is_it(a) and any(map(_number, others)):
                yield from {"int_small": 1.5, "float": 0.5}.items()
            if any(isinstance(op, ast.In | ast.NotIn) for op in ops) and any(map(is_it, others)):
                yield from {"list_int": 1, "set_int": 1, "str": 0.5, "dict_str_int": 0.5}.items()
        case ast.If(test=x) | ast.While(test=x) if is_it(x):
            yield "bool", 1


def _told_of_element(n: ast.AST, name: str) -> Iterator[tuple[str, float]]:
    """What a node says about a parameter whose elements are called `name`."""
    is_it = lambda x: isinstance(x, ast.Name) and x.id == name
    match n:
        case ast.BinOp(left=a, right=b) | ast.AugAssign(target=a, value=b) if is_it(a) or is_it(b):
            yield from {"list_int": 2, "list_float": 1}.items()
        case ast.Compare(left=a, comparators=others) if any(map(is_it, (a, *others))):
            if any(map(_number, (a, *others))):
                yield "list_int", 1.5
            if any(map(_string, (a, *others))):
                yield from {"str": 2.5, "list_str": 1}.items()
        case ast.Call(func=ast.Attribute(value=x, attr=attr)) if is_it(x):
            if attr in STR_METHODS:
                yield "list_str", 3
        case ast.For(iter=x) | ast.comprehension(iter=x) if is_it(x):
            yield "list_list_int", 3
        case ast.Subscript(value=x) if is_it(x):
            yield from {"list_list_int": 1.5, "list_pair_int": 1.5}.items()
        case ast.Call(func=ast.Name(id="len"), args=[x, *_]) if is_it(x):
            yield from {"list_str": 1, "list_list_int": 1}.items()


def guessed_specs(source: str | None, most: int = 4) -> list[list[tuple[str, float]]]:
    """For each parameter of the first function its likely specs with their points, best first; ties in the order in which they were told."""
    tree = parsed(source)
    fn = next((n for n in tree.body if isinstance(n, ast.FunctionDef)), None) if tree else None
    if fn is None:
        return []
    out = []
    for a in (*fn.args.posonlyargs, *fn.args.args):
        points: Counter[str] = Counter(PRIOR)
        for n in ast.walk(fn):
            for spec, more in _told(n, a.arg):
                points[spec] += more
        out.append(sorted(points.items(), key=lambda kv: -kv[1])[:most])
    return out


def combos(source: str | None, cap: int = 16) -> list[tuple[str, ...]]:
    """Spec combinations over all parameters, by the sum of their ranks, at most `cap`."""
    ranked = [[s for s, _ in x] for x in guessed_specs(source)]
    every = sorted(product(*(range(len(r)) for r in ranked)), key=sum)[:cap]
    return [tuple(r[i] for r, i in zip(ranked, pick, strict=True)) for pick in every]
