"""Evaluation of candidate functions in a fresh, isolated interpreter per row, with hard limits.

Values cross the process boundary as tagged JSON, never as pickles: plain JSON stands for itself, tuples, sets, dicts, floats, bytes and
complex numbers have a tag. The child runs `python -I` without the session's environment, under limits of memory, CPU seconds, file
size and processes, each call under an alarm, and is killed at the timeout. Sources are checked statically, then run with the allowed
built-ins and imports alone. It guards against accidents and against programs that reach for reward by other means; it is no security boundary.

The verdict of a candidate is, in this order: syntax_error, static_error, load_error, then on the correctness inputs timeout or
incorrect, then on the workload timeout, resource or runtime_error, else ok with the ratio of median times. Ratios are timings and differ
from run to run.
"""

from __future__ import annotations

import json
import subprocess
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from emberline.operators.codeops import ALLOWED_MODULES, SAFE_NAMES, static_error

TIMEOUT_S, MEMORY_MB, REPEATS, CALL_S, WORKLOAD_S = 30, 512, 7, 2.0, 8.0
#: A candidate slower than this, as a median of two pairs or more, is timed no further.
HOPELESS = 20.0

CODEC = r"""
def pack(v, depth=0):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return {"f": repr(v)}
    if isinstance(v, complex):
        return {"c": [repr(v.real), repr(v.imag)]}
    if isinstance(v, (bytes, bytearray)):
        return {"b" if isinstance(v, bytes) else "B": v.hex()}
    if depth < 60:
        for kind, tag in ((list, None), (tuple, "t"), (set, "s"), (frozenset, "z")):
            if type(v) is kind:
                items = [pack(x, depth + 1) for x in v]
                return items if tag is None else {tag: sorted(items, key=repr) if tag in "sz" else items}
        if isinstance(v, dict):
            return {"d": [[pack(k, depth + 1), pack(x, depth + 1)] for k, x in v.items()]}
        if hasattr(v, "__next__"):
            return {"i": [pack(x, depth + 1) for x in v]}
    return {"r": [type(v).__name__, repr(v)]}

def unpack(v):
    if isinstance(v, list):
        return [unpack(x) for x in v]
    if not isinstance(v, dict):
        return v
    ((tag, x),) = v.items() if len(v) == 1 else (("plain", v),)
    if tag == "f":
        return float(x)
    if tag == "c":
        return complex(float(x[0]), float(x[1]))
    if tag in "bB":
        return bytes.fromhex(x) if tag == "b" else bytearray.fromhex(x)
    if tag in ("t", "s", "z"):
        return {"t": tuple, "s": set, "z": frozenset}[tag](unpack(y) for y in x)
    if tag == "d":
        return {unpack(k): unpack(y) for k, y in x}
    if tag in "ir":
        return v
    return {k: unpack(y) for k, y in v.items()}
"""

CHILD = (
    CODEC
    + r"""
import builtins, copy, gc, json, math, random, resource, signal, sys, time

class Late(BaseException):
    pass

def late(*_):
    raise Late

def within(seconds, fn, *args):
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return fn(*args)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)

def namespace():
    true_import, allowed = builtins.__import__, set(job["modules"])

    def only_allowed(name, globals=None, locals=None, fromlist=(), level=0):
        if level or name.split(".")[0] not in allowed:
            raise ImportError(name)
        return true_import(name, globals, locals, fromlist, level)

    safe = {n: getattr(builtins, n) for n in job["names"] if hasattr(builtins, n)}
    return {"__builtins__": {**safe, "__import__": only_allowed}, "__name__": "candidate"}

def load(source):
    space = namespace()
    exec(compile(source, "<candidate>", "exec"), space)
    fn = space[job["func_name"]]
    if not callable(fn):
        raise TypeError("not callable")
    return fn

def told(fn, args):
    args = copy.deepcopy(args)
    out = {"value": None, "error": None}
    try:
        out["value"] = pack(within(job["call_s"], fn, *args))
    except Late:
        out["error"] = "timeout"
    except Exception as e:
        out["error"] = type(e).__name__
    out["args"] = pack(args)
    return out

def close(a, b):
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(close, a, b))
    if isinstance(a, dict):
        if a.keys() != b.keys():
            return False
        if "f" in a or "c" in a:
            return all(map(near, *([x] if isinstance(x, str) else x for x in (*a.values(), *b.values()))))
        if "d" in a:
            x, y = ({json.dumps(k): v for k, v in m["d"]} for m in (a, b))
            return x.keys() == y.keys() and all(close(x[k], y[k]) for k in x)
        return all(close(a[k], b[k]) for k in a)
    return a == b

def near(a, b):
    a, b = float(a), float(b)
    return (a != a and b != b) or math.isclose(a, b, rel_tol=job["rel"], abs_tol=job["abs"])

def spent(source, inputs):
    fn, work, groups = load(source), copy.deepcopy(inputs), {}
    gc.collect()
    gc.disable()
    try:
        return within(job["workload_s"], clocked, fn, work, groups), groups
    finally:
        gc.enable()

def clocked(fn, work, groups):
    start = last = time.perf_counter_ns()
    of = None
    for args in work:
        if job["by_group"] and args[0] != of:
            now = time.perf_counter_ns()
            if of is not None:
                groups[of] = groups.get(of, 0) + now - last
            of, last = args[0], now
        fn(*args)
    end = time.perf_counter_ns()
    if of is not None:
        groups[of] = groups.get(of, 0) + end - last
    return end - start

def middle(xs):
    xs = sorted(xs)
    return (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2

def timed(out):
    code, base, perf = job["candidate"], job["source"] if job["mode"] == "evaluate" else None, unpack(job["perf"])
    both = [code] if base is None else [code, base]
    groups, rng = [], random.Random(job["seed"])
    for _ in range(job["warmup"]):
        for c in both:
            spent(c, perf)
    new, old = [], []
    for _ in range(job["repeats"]):
        turn = [(code, new)] if base is None else [(code, new), (base, old)]
        if rng.random() < 0.5:
            turn.reverse()
        for c, into in turn:
            ns, per = spent(c, perf)
            into.append(ns)
            if into is new:
                groups.append(per)
        if len(old) >= 2 and middle(new) > job["hopeless"] * middle(old):
            break
    out["candidate_ns"] = middle(new)
    if old:
        out["ratio"] = middle(new) / max(middle(old), 1)
    if job["by_group"]:
        out["group_ns"] = {str(k): middle([g.get(k, 0) for g in groups]) for k in sorted({k for g in groups for k in g})}

def judged():
    out = {"status": "ok", "n_pass": 0, "n_total": len(job["inputs"]), "ratio": None}
    try:
        fn = within(job["call_s"], load, job["candidate"])
    except Late:
        return out | {"status": "timeout"}
    except Exception:
        return out | {"status": "load_error"}
    got = [told(fn, unpack(a)) for a in job["inputs"]]
    if job["mode"] == "baseline":
        out["expected"] = got
        if any(g["error"] == "timeout" for g in got):
            return out | {"status": "timeout"}
    else:
        expected = job["expected"]
        if expected is None:
            old = load(job["source"])
            expected = [told(old, unpack(a)) for a in job["inputs"]]
        out["n_total"] = len(expected)
        out["n_pass"] = sum(e["error"] == g["error"] and close(e["value"], g["value"]) and close(e["args"], g["args"]) for e, g in zip(expected, got))
        if out["n_pass"] < out["n_total"]:
            return out | {"status": "timeout" if any(g["error"] == "timeout" for g in got) else "incorrect"}
    try:
        timed(out)
    except Late:
        out["status"] = "timeout"
    except MemoryError:
        out["status"] = "resource"
    except Exception:
        out["status"] = "runtime_error"
    return out

def plain(v, depth=0):
    if v is None or isinstance(v, (bool, int, float, complex, str, bytes)):
        return True
    if depth > 4 or not isinstance(v, (list, tuple, set, frozenset, dict)) or len(v) >= 100000:
        return False
    inside = list(v.items()) if isinstance(v, dict) else list(v)
    return all(plain(x, depth + (not isinstance(v, dict))) for x in inside[:200])

def accepted():
    # the first spec combination under which the function behaves: (its place, share of sizes without error, seconds at 64 and 512)
    fn = load(job["candidate"])
    for k, c in enumerate(job["combos"]):
        good, seen, sound = 0, set(), True
        for a in c["sizes"]:
            try:
                v = within(0.2, fn, *unpack(a))
                if not plain(v) or repr(v) != repr(within(0.2, fn, *unpack(a))):
                    sound = False
            except Late:
                sound = False
            except MemoryError:
                sound = False
            except Exception:
                continue
            if not sound:
                break
            good += 1
            seen.add(repr(v)[:300])
        if not sound or good < 0.75 * len(c["sizes"]) or len(seen) < 2 or seen == {"None"}:
            continue
        seconds = []
        try:
            for several in (c["small"], c["large"]):
                each = []
                for a in several:
                    a, t = unpack(a), time.perf_counter()
                    try:
                        within(1.0, fn, *a)
                    except Exception:
                        pass
                    each.append(time.perf_counter() - t)
                seconds.append(middle(each))
        except Late:
            continue
        if 2e-5 <= seconds[1] <= 0.3 and seconds[1] / max(seconds[0], 1e-9) >= 2.5:
            return {"status": "ok", "combo": k, "ok_share": good / len(c["sizes"]), "t64": seconds[0], "t512": seconds[1]}
    return {"status": "rejected"}

text = sys.stdin.read()
job = json.loads(text)
real, sys.stdout = sys.stdout, open("/dev/null", "w")
for what, soft, hard in (("RLIMIT_AS", job["memory_mb"] << 20, job["memory_mb"] << 20), ("RLIMIT_CPU", job["cpu_s"], job["cpu_s"] + 2), ("RLIMIT_NPROC", 0, 0), ("RLIMIT_FSIZE", 1 << 20, 1 << 20)):
    try:
        resource.setrlimit(getattr(resource, what), (soft, hard))
    except (ValueError, OSError):
        pass
sys.setrecursionlimit(3000)
signal.signal(signal.SIGALRM, late)
try:
    answer = accepted() if job["mode"] == "accept" else judged()
except MemoryError:
    answer = {"status": "resource"}
except BaseException as e:
    answer = {"status": "worker_error", "message": repr(e)[:300]}
json.dump(answer, real)
"""
)

RESULT = "status string, n_pass int, n_total int, ratio double"

_codec: dict = {}
exec(compile(CODEC, "<codec>", "exec"), _codec)
pack, unpack = _codec["pack"], _codec["unpack"]


def run(job: dict, timeout_s: float = TIMEOUT_S, memory_mb: int = MEMORY_MB) -> dict:
    """The child's answer to one job; one that hangs, dies or answers nothing has a status of its own."""
    whole = {"modules": sorted(ALLOWED_MODULES), "names": sorted(SAFE_NAMES), "memory_mb": memory_mb, "cpu_s": int(timeout_s) + 1, "call_s": CALL_S, "workload_s": WORKLOAD_S, "rel": 1e-9, "abs": 1e-12, "hopeless": HOPELESS, "warmup": 1, "repeats": REPEATS, "by_group": False, "seed": 0} | job
    try:
        done = subprocess.run([sys.executable, "-I", "-c", CHILD], input=json.dumps(whole), capture_output=True, text=True, timeout=timeout_s, env={}, cwd="/")
    except subprocess.TimeoutExpired:
        return {"status": "timeout"}
    if done.returncode:
        return {"status": "resource"}
    try:
        return json.loads(done.stdout)
    except ValueError:
        return {"status": "worker_error"}


def baseline(source: str, func_name: str, inputs: str, perf: str | None = None, timeout_s: float = TIMEOUT_S, **options) -> dict:
    """What a source does on inputs (`expected`), and its median time on the workload (`candidate_ns`, `group_ns`)."""
    if error := static_error(source, func_name):
        return {"status": "syntax_error" if error == "syntax_error" else "static_error"}
    given = json.loads(inputs)
    return run({"mode": "baseline", "candidate": source, "func_name": func_name, "inputs": given, "perf": json.loads(perf) if perf else given} | options, timeout_s)


def evaluate(source: str, candidate: str, func_name: str, inputs: str, timeout_s: float = TIMEOUT_S, memory_mb: int = MEMORY_MB, repeats: int = REPEATS, expected: list | None = None, perf: str | None = None, **options) -> dict:
    """Whether candidate behaves as source on inputs (JSON: a list of argument lists), or as `expected` records, and the ratio of its time to source's on `perf`."""
    failed = {"n_pass": 0, "n_total": 0, "ratio": None}
    if error := static_error(candidate, func_name):
        return failed | {"status": "syntax_error" if error == "syntax_error" else "static_error"}
    given = json.loads(inputs)
    return failed | run({"mode": "evaluate", "source": source, "candidate": candidate, "func_name": func_name, "inputs": given, "perf": json.loads(perf) if perf else given, "expected": expected, "repeats": repeats} | options, timeout_s, memory_mb)


def evaluated(jobs: DataFrame, timeout_s: float = TIMEOUT_S, repeats: int = REPEATS) -> DataFrame:
    """jobs (source, candidate, func_name, inputs, ...) with RESULT, a row at a time; a row that hangs has the status timeout."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            told = [evaluate(r.source, r.candidate, r.func_name, r.inputs, timeout_s, repeats=repeats) for r in frame.itertuples()]
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame([{k: r[k] for k in ("status", "n_pass", "n_total", "ratio")} for r in told], columns=["status", "n_pass", "n_total", "ratio"]).astype({"ratio": "float64"})], axis=1)

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in jobs.schema)
    return jobs.mapInPandas(rows, f"{head}, {RESULT}")
