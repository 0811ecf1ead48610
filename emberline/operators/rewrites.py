"""Slower and faster variants of Python functions: each family is a generator of edits over the facts of one function.

A family looks at the function once and yields, for every place where it applies, a dict from nodes to what stands in their stead: an
expression, a list of statements, or None to drop them. variants() builds a new tree from each and never changes the one it read. Nothing
here runs code: a variant is a proposal, which the sandbox judges.
"""

from __future__ import annotations

import ast
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

Edit = dict[ast.AST, "ast.AST | list[ast.stmt] | None"]
COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
# Methods that change their receiver, functions that change their first argument, and functions without effects.
CHANGING = frozenset("append extend insert remove pop clear sort reverse add discard update setdefault popitem appendleft popleft extendleft rotate intersection_update difference_update symmetric_difference_update".split())
CHANGING_FIRST = frozenset("heappush heappop heapify heapreplace heappushpop insort insort_left insort_right shuffle".split())
PURE = frozenset("len sum max min abs round sorted set list tuple dict frozenset str int float bool range reversed enumerate zip any all ord chr divmod pow repr".split())
KINDS = {
    "unhoist_sort": {"sorted"},
    "unhoist_convert": {"set", "list", "tuple", "dict", "frozenset", "str", "int", "float"},
    "unhoist_call": {"len", "sum", "max", "min", "abs", "round"},
}


def load(name: str) -> ast.Name:
    return ast.Name(name, ast.Load())


def store(name: str) -> ast.Name:
    return ast.Name(name, ast.Store())


def call(name: str, *args: ast.expr, **keywords: ast.expr) -> ast.Call:
    return ast.Call(load(name), list(args), [ast.keyword(k, v) for k, v in keywords.items()])


def method(of: ast.expr, name: str, *args: ast.expr) -> ast.Call:
    return ast.Call(ast.Attribute(of, name, ast.Load()), list(args), [])


def assign(name: str, value: ast.expr) -> ast.Assign:
    return ast.Assign([store(name)], value)


def same(a: ast.AST, b: ast.AST) -> bool:
    return ast.dump(a) == ast.dump(b)


class Facts:
    """What can be told of a function without running it."""

    def __init__(self, fn: ast.FunctionDef):
        self.fn = fn
        self.nodes = list(ast.walk(fn))
        self.parent = {child: p for p in self.nodes for child in ast.iter_child_nodes(p)}
        self.params = [a.arg for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs, *filter(None, (fn.args.vararg, fn.args.kwarg)))]
        self.stores: Counter[str] = Counter(self.params)
        self.loads: dict[str, list[ast.Name]] = defaultdict(list)
        self.changed: set[str] = set()
        for n in self.nodes:
            match n:
                case ast.Name(id=name, ctx=ast.Load()):
                    self.loads[name].append(n)
                case ast.Name(id=name):
                    self.stores[name] += 1
                case ast.ExceptHandler(name=str(name)):
                    self.stores[name] += 1
            match n:
                case ast.Subscript(value=ast.Name(id=name), ctx=ast.Store() | ast.Del()) | ast.Attribute(value=ast.Name(id=name), ctx=ast.Store() | ast.Del()) | ast.AugAssign(target=ast.Name(id=name)):
                    self.changed.add(name)
                case ast.AugAssign(target=ast.Subscript(value=ast.Name(id=name))):
                    self.changed.add(name)
                case ast.Call(func=ast.Attribute(value=ast.Name(id=name), attr=attr)) if attr in CHANGING:
                    self.changed.add(name)
                case ast.Call(func=ast.Name(id=f) | ast.Attribute(attr=f), args=[ast.Name(id=name), *_]) if f in CHANGING_FIRST:
                    self.changed.add(name)

    def fresh(self, base: str) -> str:
        taken = {*self.stores, *self.loads}
        return next(x for x in (base, *(f"{base}_{k}" for k in range(2, 1000))) if x not in taken)

    def bodies(self) -> Iterator[list[ast.stmt]]:
        for n in self.nodes:
            for field in ("body", "orelse", "finalbody"):
                if isinstance(value := getattr(n, field, None), list) and value and isinstance(value[0], ast.stmt):
                    yield value

    def bound_in(self, node: ast.AST) -> set[str]:
        return {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load)}

    def changed_in(self, node: ast.AST) -> set[str]:
        """Names that the node binds or changes in place."""
        inside = Facts(ast.FunctionDef("_", ast.arguments([], [], None, [], [], None, []), [node] if isinstance(node, ast.stmt) else [ast.Expr(node)], [], None, None, []))
        return {*inside.stores} | inside.changed

    def loops(self, node: ast.AST) -> Iterator[ast.AST]:
        """The loops and comprehensions that evaluate the node again and again, the innermost first."""
        child, p = node, self.parent.get(node)
        while p is not None and p is not self.fn:
            match p:
                case ast.For() if child is not p.iter and child is not p.target:
                    yield p
                case ast.While():
                    yield p
                case ast.comprehension():
                    whole = self.parent[p]
                    if child in p.ifs or (child is p.iter and p is not whole.generators[0]):
                        yield whole
                case ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp() if not isinstance(child, ast.comprehension):
                    yield p
            child, p = p, self.parent.get(p)

    def hot(self, node: ast.AST) -> bool:
        return next(self.loops(node), None) is not None

    def statement(self, node: ast.AST) -> ast.stmt:
        while not isinstance(node, ast.stmt):
            node = self.parent[node]
        return node

    def tests_of(self, name: str) -> list[ast.Compare]:
        """The tests `x in name` and `x not in name`."""
        return [p for n in self.loads[name] if isinstance(p := self.parent[n], ast.Compare) and len(p.ops) == 1 and isinstance(p.ops[0], ast.In | ast.NotIn) and p.comparators[0] is n]

    def calls_of(self, name: str, attr: str) -> list[ast.Call]:
        return [c for n in self.loads[name] if isinstance(a := self.parent[n], ast.Attribute) and a.attr == attr and isinstance(c := self.parent[a], ast.Call) and c.func is a]


def pure(e: ast.AST, known: set[str]) -> bool:
    """Whether e has no effects and reads only known names."""
    match e:
        case ast.Constant():
            return True
        case ast.Name(id=name, ctx=ast.Load()):
            return name in known
        case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in PURE and f not in known:
            return all(pure(a, known) for a in args)
        case ast.Call(func=ast.Attribute(value=ast.Name(id="math")), args=args, keywords=[]) if "math" not in known:
            return all(pure(a, known) for a in args)
        case ast.Attribute(value=ast.Name(id="math")):
            return "math" not in known
        case ast.BinOp() | ast.UnaryOp() | ast.BoolOp() | ast.Compare() | ast.Subscript() | ast.Slice() | ast.Tuple() | ast.List() | ast.Set() | ast.Dict() | ast.IfExp():
            return all(pure(c, known) for c in ast.iter_child_nodes(e) if not isinstance(c, ast.operator | ast.unaryop | ast.boolop | ast.cmpop | ast.expr_context))
    return False


def assigned(s: ast.stmt) -> tuple[str, ast.expr] | None:
    match s:
        case ast.Assign(targets=[ast.Name(id=name)], value=value):
            return name, value
    return None


# Slower families.


def set_to_list(f: Facts) -> Iterator[Edit]:
    for s in (s for body in f.bodies() for s in body):
        match s:
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.Call(func=ast.Name(id="set"), args=args, keywords=[])) if f.stores[name] == 1:
                tests, adds = f.tests_of(name), f.calls_of(name, "add")
                if len(tests) + len(adds) < len(f.loads[name]) or not tests:
                    continue
                if not args and adds:
                    yield {s.value: ast.List([], ast.Load())} | {c.func: ast.Attribute(load(name), "append", ast.Load()) for c in adds}
                elif args and not adds:
                    match args[0]:
                        case ast.GeneratorExp(elt=e, generators=g):
                            value: ast.expr = ast.ListComp(e, g)
                        case ast.Constant(value=str()):
                            value = call("list", args[0])
                        case ast.Name(id=other) if other in f.changed or f.stores[other] != 1:
                            continue
                        case ast.Name() | ast.ListComp() | ast.Call() | ast.Subscript() | ast.Attribute():
                            value = args[0]
                        case _:
                            continue
                    yield {s: None} | {t.comparators[0]: value for t in tests}


def kind_of(e: ast.expr) -> str | None:
    match e:
        case ast.Call(func=ast.Name(id=name)):
            return next((k for k, names in KINDS.items() if name in names), None)
        case ast.List() | ast.Tuple() | ast.Dict() | ast.BinOp(op=ast.Mult(), left=ast.List()):
            return "unhoist_alloc"
        case ast.BinOp() | ast.UnaryOp() | ast.Subscript() | ast.Compare() | ast.BoolOp():
            return "unhoist_arith"
    return None


def unhoisted(kind: str) -> Callable[[Facts], Iterator[Edit]]:
    def family(f: Facts) -> Iterator[Edit]:
        for k, s in enumerate(f.fn.body):
            if not (a := assigned(s)) or kind_of(a[1]) != kind:
                continue
            name, value = a
            later = set().union(*(f.changed_in(x) for x in f.fn.body[k + 1 :]))
            known = ({*f.params} | set().union(*(f.bound_in(x) for x in f.fn.body[:k]))) - later
            if f.stores[name] == 1 and name not in f.changed and pure(value, known) and any(map(f.hot, f.loads[name])):
                yield {s: None} | dict.fromkeys(f.loads[name], value)

    return family


def linear_search(f: Facts) -> Iterator[Edit]:
    for k, s in enumerate(f.fn.body):
        match s:
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.Call(func=ast.Name(id="dict"), args=[ast.Name(id=pairs)], keywords=[])):
                pass
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.DictComp(key=ast.Name(id=a), value=ast.Name(id=b), generators=[ast.comprehension(target=ast.Tuple(elts=[ast.Name(id=c), ast.Name(id=d)]), iter=ast.Name(id=pairs), ifs=[])])) if (a, b) == (c, d):
                pass
            case _:
                continue
        gets = [c for c in f.calls_of(name, "get") if 1 <= len(c.args) <= 2 and not c.keywords]
        tests = f.tests_of(name)
        later = set().union(*(f.changed_in(x) for x in f.fn.body[k + 1 :]))
        if f.stores[name] != 1 or name in f.changed or pairs in later or not gets + tests or len(gets) + len(tests) < len(f.loads[name]):
            continue
        key, value = f.fresh("key"), f.fresh("value")
        both = lambda v: ast.Tuple([store(key), store(v)], ast.Store())  # noqa: B023, E731
        edit: Edit = {s: None}
        for c in gets:
            found = ast.GeneratorExp(load(value), [ast.comprehension(both(value), call("reversed", load(pairs)), [ast.Compare(load(key), [ast.Eq()], [c.args[0]])], 0)])
            edit[c] = call("next", found, c.args[1] if len(c.args) > 1 else ast.Constant(None))
        for t in tests:
            any_ = call("any", ast.GeneratorExp(ast.Compare(load(key), [ast.Eq()], [t.left]), [ast.comprehension(both("_"), load(pairs), [], 0)]))
            edit[t] = any_ if isinstance(t.ops[0], ast.In) else ast.UnaryOp(ast.Not(), any_)
        yield edit


def concatenating_join(f: Facts) -> Iterator[Edit]:
    for s in (s for body in f.bodies() for s in body):
        match s:
            case ast.Return(value=ast.Call() as c):
                end = lambda acc: ast.Return(load(acc))
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.Call() as c):
                end = lambda acc, name=name: assign(name, load(acc))
            case _:
                continue
        match c:
            case ast.Call(func=ast.Attribute(value=ast.Constant(value=str(sep)), attr="join"), args=[parts], keywords=[]):
                acc, part, first = f.fresh("result"), f.fresh("part"), f.fresh("first")
                grow = lambda e: ast.AugAssign(store(acc), ast.Add(), e)  # noqa: B023, E731
                body: list[ast.stmt] = [grow(load(part))]
                begin: list[ast.stmt] = [assign(acc, ast.Constant(""))]
                if sep:
                    body.insert(0, ast.If(load(first), [assign(first, ast.Constant(False))], [grow(ast.Constant(sep))]))
                    begin.append(assign(first, ast.Constant(True)))
                yield {s: [*begin, ast.For(store(part), parts, body, []), end(acc)]}


def sorted_ends(f: Facts) -> Iterator[Edit]:
    for n in f.nodes:
        match n:
            case ast.Call(func=ast.Name(id="max" | "min" as which), args=[x], keywords=[]) if not isinstance(x, ast.Starred):
                at = ast.Constant(0) if which == "min" else ast.UnaryOp(ast.USub(), ast.Constant(1))
                yield {n: ast.Subscript(call("sorted", x), at, ast.Load())}


def materialized(f: Facts) -> Iterator[Edit]:
    for n in f.nodes:
        match n:
            case ast.Call(func=ast.Name(id="any"), args=[ast.GeneratorExp(elt=e, generators=[*_, ast.comprehension() as last] as g)], keywords=[]):
                held = ast.comprehension(last.target, last.iter, [*last.ifs, e], last.is_async)
                yield {n: ast.Compare(call("len", ast.ListComp(ast.Constant(1), [*g[:-1], held])), [ast.Gt()], [ast.Constant(0)])}
            case ast.Call(func=ast.Name(id="all"), args=[ast.GeneratorExp(elt=e, generators=[*_, ast.comprehension() as last] as g)], keywords=[]):
                held = ast.comprehension(last.target, last.iter, [*last.ifs, negated(e)], last.is_async)
                yield {n: ast.Compare(call("len", ast.ListComp(ast.Constant(1), [*g[:-1], held])), [ast.Eq()], [ast.Constant(0)])}
            case ast.Call(func=ast.Name(id="sum"), args=[ast.GeneratorExp(elt=e, generators=g)], keywords=[]):
                yield {n: call("sum", ast.ListComp(e, g))}
            case ast.Call(func=ast.Name(id="next"), args=[ast.GeneratorExp(elt=e, generators=g), default], keywords=[]):
                yield {n: ast.Subscript(ast.BinOp(ast.ListComp(e, g), ast.Add(), ast.List([default], ast.Load())), ast.Constant(0), ast.Load())}


def negated(e: ast.expr) -> ast.expr:
    match e:
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return x
    return ast.UnaryOp(ast.Not(), e)


def appending_loop(f: Facts) -> Iterator[Edit]:
    for s in (s for body in f.bodies() for s in body):
        match s:
            case ast.Assign(targets=[ast.Name(id=acc)], value=ast.ListComp(elt=e, generators=[ast.comprehension(is_async=0) as g])) if acc not in {n.id for n in ast.walk(s.value) if isinstance(n, ast.Name)}:
                end: list[ast.stmt] = []
            case ast.Return(value=ast.ListComp(elt=e, generators=[ast.comprehension(is_async=0) as g])):
                acc = f.fresh("result")
                end = [ast.Return(load(acc))]
            case _:
                continue
        if {n.id for n in ast.walk(g.target) if isinstance(n, ast.Name)} & {x for x, n in f.stores.items() if n > 1 or x in f.params}:
            continue  # the loop's variable would outlive the comprehension's
        body: ast.stmt = ast.Expr(method(load(acc), "append", e))
        for test in reversed(g.ifs):
            body = ast.If(test, [body], [])
        yield {s: [assign(acc, ast.List([], ast.Load())), ast.For(g.target, g.iter, [body], []), *end]}


def own_lists(f: Facts) -> Iterator[str]:
    """Local names whose every plain assignment gives them a new list."""
    values = defaultdict(list)
    for s in f.nodes:
        if isinstance(s, ast.stmt) and (a := assigned(s)):
            values[a[0]].append(a[1])
    for name, given in values.items():
        new = [v for v in given if isinstance(v, ast.List | ast.ListComp) or (isinstance(v, ast.Call) and isinstance(v.func, ast.Name) and v.func.id in ("list", "sorted"))]
        if new and name not in f.params:
            yield name


def concatenating(f: Facts) -> Iterator[Edit]:
    for name in own_lists(f):
        calls = [c for c in f.calls_of(name, "append") if len(c.args) == 1 and not c.keywords and isinstance(f.parent[c], ast.Expr)]
        others = [n for n in f.loads[name] if not any(c.func.value is n for c in calls)]
        aliased = any(isinstance(p := f.parent[n], ast.Assign | ast.List | ast.Tuple | ast.Dict) or (isinstance(p, ast.Call) and isinstance(p.func, ast.Attribute) and n in p.args) for n in others)
        if calls and not aliased:
            yield {f.parent[c]: [assign(name, ast.BinOp(load(name), ast.Add(), ast.List([c.args[0]], ast.Load())))] for c in calls}


def copying_store(f: Facts) -> Iterator[Edit]:
    for s in f.nodes:
        match s:
            case ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Call(func=ast.Attribute(value=ast.Name(id=d), attr="setdefault"), args=[key, ast.List(elts=[])]), attr="append"), args=[x], keywords=[])):
                one, at = ast.List([x], ast.Load()), lambda ctx: ast.Subscript(load(d), key, ctx)  # noqa: B023
                yield {s: [ast.If(ast.Compare(key, [ast.In()], [load(d)]), [ast.Assign([at(ast.Store())], ast.BinOp(at(ast.Load()), ast.Add(), one))], [ast.Assign([at(ast.Store())], one)])]}


def counted_stores(f: Facts) -> Iterator[tuple[ast.Assign, str, str, str]]:
    """(statement, loop's variable, sequence, dict) of each dict[t] = ... in a loop `for t in sequence`."""
    for loop in f.nodes:
        match loop:
            case ast.For(target=ast.Name(id=t), iter=ast.Name(id=seq)):
                for s in loop.body:
                    match s:
                        case ast.Assign(targets=[ast.Subscript(value=ast.Name(id=d), slice=ast.Name(id=k))]) if k == t:
                            yield s, t, seq, d


def scanning_count(f: Facts) -> Iterator[Edit]:
    for s, t, seq, d in counted_stores(f):
        match s.value:
            case ast.BinOp(left=ast.Call(func=ast.Attribute(value=ast.Name(id=d2), attr="get"), args=[ast.Name(id=k), ast.Constant(value=0)]), op=ast.Add(), right=ast.Constant(value=1)) if (d2, k) == (d, t) and seq not in f.changed:
                yield {s.value: method(load(seq), "count", load(t))}


# Faster families.


def hoisted(f: Facts) -> Iterator[Edit]:
    seen = set()
    for n in f.nodes:
        if not isinstance(n, ast.Call | ast.BinOp | ast.Subscript | ast.Compare | ast.List | ast.Dict) or isinstance(getattr(n, "ctx", ast.Load()), ast.Store | ast.Del) or ast.dump(n) in seen:
            continue
        p = f.parent[n]
        if isinstance(n, ast.List | ast.Dict):
            if not (isinstance(p, ast.Subscript) and p.value is n) and not (isinstance(p, ast.Compare) and n in p.comparators):
                continue  # elsewhere a new one may be needed each time
        elif not {x.id for x in ast.walk(n) if isinstance(x, ast.Name)} & {*f.stores}:
            continue
        out = None
        for loop in f.loops(n):
            inside = f.changed_in(loop)
            if not pure(n, {*f.stores} - inside):
                break
            out = loop
        # only the largest invariant expression moves, and none of an iterator, which one loop would use up
        if out is None or (isinstance(p, ast.expr) and any(pure(p, {*f.stores} - f.changed_in(x)) for x in f.loops(p))):
            continue
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in ("reversed", "enumerate", "zip"):
            continue
        seen.add(ast.dump(n))
        place = f.statement(out)
        match n:
            case ast.Call(func=ast.Name(id=name), args=[ast.Name(id=arg), *_]):
                new = f.fresh(f"{name}_{arg}")
            case ast.Call(func=ast.Name(id=name)):
                new = f.fresh(f"{name}_val")
            case _:
                new = f.fresh("tmp")
        uses = [x for x in ast.walk(place) if isinstance(x, ast.expr) and same(x, n)]
        yield {place: [assign(new, n), _rebuilt(place, dict.fromkeys(uses, load(new)))]}


def set_membership(f: Facts) -> Iterator[Edit]:
    for name in sorted({n.comparators[0].id for n in f.nodes if isinstance(n, ast.Compare) and len(n.ops) == 1 and isinstance(n.ops[0], ast.In | ast.NotIn) and isinstance(n.comparators[0], ast.Name)}):
        tests = f.tests_of(name)
        if not any(map(f.hot, tests)):
            continue
        given = [s for s in f.nodes if isinstance(s, ast.Assign) and (a := assigned(s)) and a[0] == name]
        appends = [c for c in f.calls_of(name, "append") if len(c.args) == 1]
        value = given[0].value if len(given) == 1 and f.stores[name] == 1 else None
        if isinstance(value, ast.List) and not value.elts and len(tests) + len(appends) == len(f.loads[name]):
            yield {value: call("set")} | {c.func: ast.Attribute(load(name), "add", ast.Load()) for c in appends}
        elif value is not None and name not in f.changed and len(tests) == len(f.loads[name]):
            match value:
                case ast.ListComp(elt=e, generators=g):
                    yield {value: ast.SetComp(e, g)}
                case ast.Call(func=ast.Name(id="list" | "sorted" | "tuple"), args=[x], keywords=[]):
                    yield {value: call("set", x)}
                case ast.List(elts=elts) | ast.Tuple(elts=elts) if elts:
                    yield {value: ast.Set(elts)}
                case ast.Call(func=ast.Name(id="set" | "frozenset" | "dict")):
                    pass
                case ast.Name() | ast.Call() | ast.Subscript() | ast.Attribute() | ast.BinOp():
                    yield {value: call("set", value)}
        elif name not in f.changed and f.stores[name] == 1:
            hot = [t for t in tests if f.hot(t)]
            place = next((s for s in f.fn.body if any(x is hot[0] for x in ast.walk(s))), None)
            ready = name in f.params or any(s in given for s in f.fn.body[: f.fn.body.index(place)]) if place is not None else False
            if ready:
                new = f.fresh(f"{name}_set")
                inside = {t.comparators[0] for t in tests if any(x is t for x in ast.walk(place))}
                yield {place: [assign(new, call("set", load(name))), _rebuilt(place, dict.fromkeys(inside, load(new)))]}


def sorted_ends_undone(f: Facts) -> Iterator[Edit]:
    for n in f.nodes:
        match n:
            case ast.Subscript(value=ast.Call(func=ast.Name(id="sorted"), args=[x], keywords=keywords), slice=at):
                first = isinstance(at, ast.Constant) and at.value == 0 and type(at.value) is int
                last = isinstance(at, ast.UnaryOp) and isinstance(at.op, ast.USub) and isinstance(at.operand, ast.Constant) and at.operand.value == 1
                named = {k.arg: k.value for k in keywords}
                back = named.pop("reverse", ast.Constant(False))
                if not (first or last) or not {*named} <= {"key"} or not isinstance(back, ast.Constant) or (back.value and "key" in named):
                    continue  # ties of a reversed order with a key would give another element
                x = ast.GeneratorExp(x.elt, x.generators) if isinstance(x, ast.ListComp) else x
                if last and "key" in named:
                    continue
                yield {n: call("min" if first != bool(back.value) else "max", x, **named)}


def dematerialized(f: Facts) -> Iterator[Edit]:
    for n in f.nodes:
        match n:
            case ast.Compare(left=ast.Call(func=ast.Name(id="len"), args=[ast.ListComp(elt=e, generators=[*before, ast.comprehension() as last])], keywords=[]), ops=[op], comparators=[ast.Constant(value=0)]) if isinstance(op, ast.Gt | ast.NotEq | ast.Eq):
                some = not isinstance(op, ast.Eq)
                test = last.ifs[-1] if last.ifs else ast.Constant(True)
                g = [*before, ast.comprehension(last.target, last.iter, last.ifs[:-1], last.is_async)]
                yield {n: call("any" if some else "all", ast.GeneratorExp(test if some else negated(test), g))}
            case ast.Call(func=ast.Name(id="len"), args=[ast.ListComp(elt=ast.Constant(value=1) as e, generators=g)], keywords=[]) if not isinstance(f.parent[n], ast.Compare):
                yield {n: call("sum", ast.GeneratorExp(e, g))}
            case ast.Call(func=ast.Name(id="sum" | "max" | "min" | "any" | "all" as which), args=[ast.ListComp(elt=e, generators=g)], keywords=keywords):
                yield {n: ast.Call(load(which), [ast.GeneratorExp(e, g)], keywords)}
            case ast.Subscript(value=ast.BinOp(left=ast.ListComp(elt=e, generators=g), op=ast.Add(), right=ast.List(elts=[default])), slice=ast.Constant(value=0)):
                yield {n: call("next", ast.GeneratorExp(e, g), default)}


def comprehended(f: Facts) -> Iterator[Edit]:
    for body in f.bodies():
        for first, loop, *rest in (body[k : k + 3] for k in range(len(body) - 1)):
            if not isinstance(loop, ast.For) or loop.orelse or not (a := assigned(first)) or not (isinstance(a[1], ast.List) and not a[1].elts):
                continue
            tests, inner = [], loop.body
            while len(inner) == 1 and isinstance(inner[0], ast.If) and not inner[0].orelse:
                tests.append(inner[0].test)
                inner = inner[0].body
            match inner:
                case [ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id=acc), attr="append"), args=[e], keywords=[]))] if acc == a[0]:
                    pass
                case _:
                    continue
            if any(isinstance(x, ast.Name) and x.id == acc for y in (e, loop.iter, *tests) for x in ast.walk(y)):
                continue
            new = ast.ListComp(e, [ast.comprehension(loop.target, loop.iter, tests, 0)])
            match rest:
                case [ast.Return(value=ast.Name(id=name))] if name == acc and len(f.loads[acc]) == 2:
                    yield {first: None, loop: None, rest[0]: [ast.Return(new)]}
                case _:
                    yield {first: None, loop: [assign(acc, new)]}


def appending(f: Facts) -> Iterator[Edit]:
    for name in own_lists(f):
        edit: Edit = {}
        for s in f.nodes:
            match s:
                case ast.Assign(targets=[ast.Name(id=a)], value=ast.BinOp(left=ast.Name(id=b), op=ast.Add(), right=ast.List(elts=[x]))) if a == b == name:
                    edit[s] = [ast.Expr(method(load(name), "append", x))]
                case ast.AugAssign(target=ast.Name(id=a), op=ast.Add(), value=ast.List(elts=[x])) if a == name:
                    edit[s] = [ast.Expr(method(load(name), "append", x))]
        if edit:
            yield edit


def setdefault(f: Facts) -> Iterator[Edit]:
    for s in f.nodes:
        match s:
            case ast.If(test=ast.Compare(left=key, ops=[ast.In() | ast.NotIn() as op], comparators=[ast.Name(id=d)]), body=[one], orelse=[two]):
                there, missing = (one, two) if isinstance(op, ast.In) else (two, one)
                at = ast.Subscript(load(d), key, ast.Load())
                match there, missing:
                    case ast.Assign(targets=[t1], value=ast.BinOp(left=old, op=ast.Add(), right=ast.List(elts=[x]))), ast.Assign(targets=[t2], value=ast.List(elts=[y])) if same(x, y) and same(old, at) and all(same(t, ast.Subscript(load(d), key, ast.Store())) for t in (t1, t2)):
                        yield {s: [ast.Expr(method(method(load(d), "setdefault", key, ast.List([], ast.Load())), "append", x))]}


def running_count(f: Facts) -> Iterator[Edit]:
    for s, t, seq, d in counted_stores(f):
        match s.value:
            case ast.Call(func=ast.Attribute(value=ast.Name(id=of), attr="count"), args=[ast.Name(id=k)]) if (of, k) == (seq, t):
                yield {s.value: ast.BinOp(method(load(d), "get", load(t), ast.Constant(0)), ast.Add(), ast.Constant(1))}


def joined(f: Facts) -> Iterator[Edit]:
    for body in f.bodies():
        for k, first in enumerate(body):
            match body[k : k + 4]:
                case [ast.Assign(targets=[ast.Name(id=acc)], value=ast.Constant(value="")), ast.Assign(targets=[ast.Name(id=flag)], value=ast.Constant(value=True)) as told, ast.For(body=[ast.If(test=ast.Name(id=f2), body=[ast.Assign(targets=[ast.Name(id=f3)], value=ast.Constant(value=False))], orelse=[ast.AugAssign(target=ast.Name(id=a2), op=ast.Add(), value=ast.Constant(value=str(sep)))]), grow], orelse=[]) as loop, *rest] if f2 == f3 == flag and a2 == acc:
                    gone = [first, told]
                case [ast.Assign(targets=[ast.Name(id=acc)], value=ast.Constant(value="")), ast.For(body=[grow], orelse=[]) as loop, *rest]:
                    sep, gone = "", [first]
                case _:
                    continue
            match grow:
                case ast.AugAssign(target=ast.Name(id=a), op=ast.Add(), value=piece) | ast.Assign(targets=[ast.Name(id=a)], value=ast.BinOp(left=ast.Name(), op=ast.Add(), right=piece)) if a == acc:
                    pass
                case _:
                    continue
            if isinstance(grow, ast.Assign) and grow.value.left.id != acc or any(isinstance(x, ast.Name) and x.id == acc for y in (piece, loop.iter) for x in ast.walk(y)):
                continue
            plain = isinstance(piece, ast.Name) and isinstance(loop.target, ast.Name) and piece.id == loop.target.id
            new = method(ast.Constant(sep), "join", loop.iter if plain else ast.GeneratorExp(piece, [ast.comprehension(loop.target, loop.iter, [], 0)]))
            edit: Edit = dict.fromkeys(gone)
            match rest:
                case [ast.Return(value=ast.Name(id=name)), *_] if name == acc:
                    yield edit | {loop: None, rest[0]: [ast.Return(new)]}
                case [ast.Assign(targets=[ast.Name(id=given)], value=ast.Name(id=name)), *_] if name == acc and acc in ("result", "result_2"):
                    yield edit | {loop: None, rest[0]: [assign(given, new)]}
                case _:
                    yield edit | {loop: [assign(acc, new)]}


def dict_lookup(f: Facts) -> Iterator[Edit]:
    sites: dict[str, dict[ast.AST, Callable[[str], ast.expr]]] = defaultdict(dict)
    for n in f.nodes:
        match n:
            case ast.Call(func=ast.Name(id="next"), args=[ast.GeneratorExp(elt=ast.Name(id=v), generators=[ast.comprehension(target=ast.Tuple(elts=[ast.Name(id=k), ast.Name(id=v2)]), iter=it, ifs=[ast.Compare(left=ast.Name(id=k2), ops=[ast.Eq()], comparators=[key])])]), default]) if (k, v) == (k2, v2):
                match it:
                    case ast.Call(func=ast.Name(id="reversed"), args=[ast.Name(id=pairs)]) | ast.Name(id=pairs):
                        sites[pairs][n] = lambda d, key=key, default=default: method(load(d), "get", key, default)
            case ast.Call(func=ast.Name(id="any"), args=[ast.GeneratorExp(elt=ast.Compare(left=ast.Name(id=k2), ops=[ast.Eq()], comparators=[key]), generators=[ast.comprehension(target=ast.Tuple(elts=[ast.Name(id=k), ast.Name()]), iter=ast.Name(id=pairs), ifs=[])])]) if k == k2:
                no = f.parent[n] if isinstance(p := f.parent[n], ast.UnaryOp) and isinstance(p.op, ast.Not) else None
                sites[pairs][no or n] = lambda d, key=key, no=no: ast.Compare(key, [ast.NotIn() if no else ast.In()], [load(d)])
    for pairs, uses in sorted(sites.items()):
        place = 0 if pairs in f.params else next((k + 1 for k, s in enumerate(f.fn.body) if pairs in f.bound_in(s)), None)
        if pairs in f.changed or f.stores[pairs] != 1 or place is None or place >= len(f.fn.body):
            continue
        new, at = f.fresh(f"{pairs}_map"), f.fn.body[place]
        yield {at: [assign(new, call("dict", load(pairs))), _rebuilt(at, {n: make(new) for n, make in uses.items()})]} | {n: make(new) for n, make in uses.items() if not any(x is n for x in ast.walk(at))}


Family = Callable[[Facts], Iterator[Edit]]
SLOWER: dict[str, Family] = {
    "set_to_list_membership": set_to_list,
    **{k: unhoisted(k) for k in ("unhoist_call", "unhoist_sort", "unhoist_convert", "unhoist_arith", "unhoist_alloc")},
    "dict_linear_search": linear_search,
    "join_to_concat": concatenating_join,
    "worse_builtins": sorted_ends,
    "materialize": materialized,
    "comprehension_to_loop": appending_loop,
    "append_to_concat": concatenating,
    "dict_build": copying_store,
    "repeated_scan": scanning_count,
}
FASTER: dict[str, Family] = {
    "hoist": hoisted,
    "set_membership": set_membership,
    "minmax": sorted_ends_undone,
    "dematerialize": dematerialized,
    "comprehension": comprehended,
    "append": appending,
    "setdefault": setdefault,
    "counter": running_count,
    "join": joined,
    "dict_lookup": dict_lookup,
}
#: The faster family that undoes each slower one.
INVERSE = {**{k: "hoist" for k in SLOWER if k.startswith("unhoist")}, "set_to_list_membership": "set_membership", "dict_linear_search": "dict_lookup", "join_to_concat": "join", "worse_builtins": "minmax", "materialize": "dematerialize", "comprehension_to_loop": "comprehension", "append_to_concat": "append", "dict_build": "setdefault", "repeated_scan": "counter"}


def _rebuilt(node: ast.AST, edit: Edit) -> ast.AST:
    """A copy of the tree with the edit applied; what stands in for a node is copied with the edit, too, but for that node itself."""

    def copied(x: object, edit: Edit) -> object:
        if isinstance(x, list):
            out: list = []
            for y in x:
                if isinstance(y, ast.AST) and y in edit:
                    new, rest = edit[y], {k: v for k, v in edit.items() if k is not y}
                    out += [] if new is None else copied(new, rest) if isinstance(new, list) else [copied(new, rest)]
                else:
                    out.append(copied(y, edit))
            return out
        if not isinstance(x, ast.AST):
            return x
        if x in edit:
            return copied(edit[x], {k: v for k, v in edit.items() if k is not x})
        return type(x)(**{name: copied(value, edit) for name, value in ast.iter_fields(x)})

    return copied(node, edit)


def function_in(tree: ast.Module) -> ast.FunctionDef | None:
    return next((n for n in tree.body if isinstance(n, ast.FunctionDef)), None)


def variants(source: str | None, families: dict[str, Family], most: int | None = None) -> Iterator[tuple[str, str, int]]:
    """(family, variant, ord) of the first function of the source: no variant twice, none equal to the source, at most `most` a family."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    fn = function_in(tree)
    if fn is None:
        return
    facts, seen = Facts(fn), {ast.unparse(tree)}
    for family, rule in families.items():
        found = 0
        for edit in rule(facts):
            new = _rebuilt(tree, edit)
            body = function_in(new).body
            if not body:
                continue
            text = ast.unparse(ast.fix_missing_locations(new))
            if text in seen:
                continue
            seen.add(text)
            yield family, text + "\n", found
            found += 1
            if most is not None and found >= most:
                break
