"""Each keyed expression against plain Python on random inputs, odd and empty ones among them. What raises in Python is null."""

import math
import random
import re
from collections import Counter

import pytest

from emberline.functions.keyed import LIBRARY, column, rounded_to

SCHEMA = "xs array<bigint>, ys array<bigint>, ts array<string>, us array<string>, ps array<struct<a:bigint,b:bigint>>, qs array<struct<a:bigint,b:bigint>>, ns array<struct<k:string,v:bigint>>, ds array<struct<k:string,v:string>>, rows array<array<bigint>>, s string, s2 string, k bigint, lo bigint, hi bigint"


def grouped(items):
    out = {}
    for k, v in items:
        out.setdefault(k, []).append(v)
    return [*out.items()]


def counted(items):
    return [*Counter(items).items()]


def by_count(ts):
    return [t for t, _ in Counter(ts).most_common()]


def wrapped(ts, width):
    lines, line, used = [], [], 0
    for t in ts:
        if line and used + len(t) > width:
            lines, line, used = [*lines, line], [], 0
        line, used = [*line, t], used + len(t) + 1
    return "\n".join(map(" ".join, [*lines, line] if line else lines))


def streak(xs):
    runs = []
    for x in xs:
        runs = [*runs[:-1], (x, runs[-1][1] + 1)] if runs and runs[-1][0] == x else [*runs, (x, 1)]
    return max(runs, key=lambda v: v[1])[0]


def two_sum(xs, k):
    return next(([xs.index(k - x), i] for i, x in enumerate(xs) if k - x in xs[:i]), None)


def prefix(ts):
    n = 0
    while ts and all(len(t) > n and t[n] == ts[0][n] for t in ts):
        n += 1
    return ts[0][:n] if ts else ""


PLAIN = {
    "lookup_prices": lambda r: [dict(r.ns).get(t, 0) for t in r.ts],
    "map_ids": lambda r: [dict(r.ps)[x] for x in r.xs],
    "resolve_ids": lambda r: [dict(r.ps).get(x, -1) for x in r.xs],
    "price_total": lambda r: sum(dict(r.ns).get(t, 0) for t in r.ts),
    "known_ids_count": lambda r: sum(x in dict(r.ps) for x in r.xs),
    "translate_tokens": lambda r: [dict(r.ds).get(t, t) for t in r.ts],
    "relabel": lambda r: [dict(r.ds).get(t, t) for t in r.ts],
    "missing_keys": lambda r: [t for t in r.ts if t not in dict(r.ns)],
    "has_all_keys": lambda r: all(t in dict(r.ns) for t in r.ts),
    "weighted_total": lambda r: sum(dict(r.ps).get(x, 1) * 2 for x in r.xs),
    "score_lookup_max": lambda r: max(dict(r.ns).get(t, 0) for t in r.ts),
    "lookup_pairs_both": lambda r: [dict(r.qs).get(a, 0) + dict(r.qs).get(b, 0) for a, b in r.ps],
    "pair_lookup_sum": lambda r: sum(dict(r.ps).get(x, 0) for x in r.xs),
    "format_scores": lambda r: "\n".join(f"{t}: {dict(r.ns).get(t, 0)}" for t in r.ts),
    "best_score_name": lambda r: max(r.ns, key=lambda p: p.v).k,
    "above_mean_names": lambda r: [p.k for p in r.ns if p.v > sum(q.v for q in r.ns) / len(r.ns)],
    "count_hits": lambda r: sum(x in r.ys for x in r.xs),
    "overlap_count": lambda r: sum(x in r.ys for x in r.xs),
    "drop_banned": lambda r: [t for t in r.ts if t not in r.us],
    "unknown_words": lambda r: [t for t in r.ts if t not in r.us],
    "mark_seen": lambda r: [(t, t in r.us) for t in r.ts],
    "count_pairs_in_table": lambda r: sum(p.a in r.ys and p.b in r.ys for p in r.ps),
    "matches_sorted_prefix": lambda r: [y for y in r.ys if y in sorted(r.xs)[:5]],
    "report_known_ratio": lambda r: f"{sum(x in r.ys for x in r.xs)}/{len(r.xs)}",
    "percent_known": lambda r: round(100 * sum(t in r.us for t in r.ts) / len(r.ts)),
    "filter_and_scale": lambda r: [x / max(r.xs) if max(r.xs) else None for x in r.xs if x in r.ys],
    "group_by_key": lambda r: grouped(r.ps),
    "group_pairs": lambda r: grouped(r.ps),
    "bucket_by_length": lambda r: grouped((len(t), t) for t in r.ts),
    "anagram_groups": lambda r: [v for _, v in grouped(("".join(sorted(t)), t) for t in r.ts)],
    "index_by_first_letter": lambda r: grouped((t[0], t) for t in r.ts),
    "token_lengths_by_letter": lambda r: grouped((t[0], len(t)) for t in r.ts),
    "char_histogram": lambda r: counted(r.s),
    "count_tokens": lambda r: counted(r.ts),
    "count_values": lambda r: counted(r.xs),
    "count_pairs_by_first": lambda r: counted(p.a for p in r.ps),
    "histogram_buckets": lambda r: counted(x // r.k for x in r.xs) if r.k else None,
    "mode_value": lambda r: max(r.xs, key=r.xs.count),
    "top_tokens_line": lambda r: ",".join(by_count(r.ts)[: r.k]),
    "rank_tokens": lambda r: [by_count(r.ts).index(t) for t in r.ts],
    "group_sizes_line": lambda r: " ".join(f"{a}:{n}" for a, n in sorted(counted(p.a for p in r.ps))),
    "scale_by_max": lambda r: [x / max(r.xs) if max(r.xs) else None for x in r.xs],
    "fraction_of_total": lambda r: [x / sum(r.xs) if sum(r.xs) else None for x in r.xs],
    "percent_of_max": lambda r: [round(100 * x / max(r.xs)) if max(r.xs) else None for x in r.xs],
    "normalize_by_first": lambda r: [x / (abs(r.xs[0]) + 1) for x in r.xs],
    "above_threshold_ratio": lambda r: [x > r.k * len(r.xs) for x in r.xs],
    "mask_by_sorted_cutoff": lambda r: [x >= c for c in [sorted(r.xs)[r.k]] for x in r.xs],
    "label_by_quantile": lambda r: ["low" if x < sorted(r.xs)[len(r.xs) // 4] else "high" if x > sorted(r.xs)[3 * len(r.xs) // 4] else "mid" for x in r.xs],
    "rank_all": lambda r: [sorted(r.xs).index(x) for x in r.xs],
    "count_less_than_each": lambda r: [sum(y < x for y in r.xs) for x in r.xs],
    "index_in_sorted": lambda r: [sorted(r.xs).index(y) for y in r.ys],
    "distances_to_center": lambda r: [abs(p.a - sum(q.a for q in r.ps) / len(r.ps)) + abs(p.b - sum(q.b for q in r.ps) / len(r.ps)) for p in r.ps],
    "value_span": lambda r: max(r.xs) - min(r.xs),
    "center_and_round": lambda r: [round(x - sum(r.xs) / len(r.xs), r.k) for x in r.xs],
    "summary_line": lambda r: f"min={min(r.xs)} max={max(r.xs)} n={len(r.xs)}",
    "index_pairs_in_range": lambda r: [i for i, x in enumerate(r.xs) if r.lo <= x <= r.hi],
    "filter_in_range": lambda r: [x for x in r.xs if r.lo <= x <= r.hi],
    "clamp_all": lambda r: [max(r.lo, min(r.hi, x)) for x in r.xs],
    "squares_of_evens": lambda r: [x * x for x in r.xs if x % 2 == 0],
    "scaled_ints": lambda r: [x * r.k for x in r.xs],
    "absolute_values": lambda r: [abs(x) for x in r.xs],
    "threshold_flags": lambda r: [x >= r.k for x in r.xs],
    "even_odd_split": lambda r: [[x for x in r.xs if x % 2 == 0], [x for x in r.xs if x % 2]],
    "diffs_from_previous": lambda r: [b - a for a, b in zip(r.xs, r.xs[1:], strict=False)],
    "bounded_diffs": lambda r: [min(r.k, abs(b - a)) for a, b in zip(r.xs, r.xs[1:], strict=False)],
    "running_total": lambda r: [sum(r.xs[: i + 1]) for i in range(len(r.xs))],
    "weighted_sum": lambda r: sum(x * y for x, y in zip(r.xs, r.ys, strict=False)),
    "squares_sum": lambda r: sum(i * i for i in range(r.k)),
    "longest_streak_value": lambda r: streak(r.xs),
    "count_pairs_with_sum": lambda r: sum(r.xs[i] + r.xs[j] == r.k for j in range(len(r.xs)) for i in range(j)),
    "has_pair_with_diff": lambda r: any(abs(r.xs[i] - r.xs[j]) == r.k for j in range(len(r.xs)) for i in range(j)),
    "count_distinct_pairs_sum": lambda r: len({x for x in r.xs if r.k - x in r.xs and x < r.k - x}),
    "two_sum_indices": lambda r: two_sum(r.xs, r.k),
    "peak_pair": lambda r: max(r.ps, key=lambda p: p.b),
    "zero_padded": lambda r: [x + [0] * (r.k - len(x)) for x in r.rows],
    "rows_above_mean_len": lambda r: [x for x in r.rows if len(x) > sum(map(len, r.rows)) / len(r.rows)],
    "widest_range_row": lambda r: max(r.rows, key=lambda x: max(x) - min(x)),
    "row_fractions": lambda r: [[x / g if g else None for x in row] for g in [sum(map(sum, r.rows))] for row in r.rows],
    "shifted_by_min": lambda r: [[x - min(map(min, r.rows)) for x in row] for row in r.rows] if all(r.rows) else None,
    "csv_rows": lambda r: "\n".join(",".join(map(str, row)) for row in r.rows),
    "reverse_words": lambda r: " ".join(r.s.split()[::-1]),
    "comma_list": lambda r: ", ".join(r.ts),
    "render_row": lambda r: "|" + "|".join(map(str, r.xs)) + "|",
    "initials": lambda r: "".join(t[0] for t in r.ts),
    "build_path": lambda r: "/".join(t.strip("/") for t in r.ts),
    "wrap_words": lambda r: wrapped(r.ts, r.k),
    "repeat_joined": lambda r: r.s2.join([r.s] * r.k),
    "capitalize_sentence": lambda r: " ".join(t[:1].upper() + t[1:] for t in r.ts),
    "hex_string": lambda r: "".join(format(x, "02x") for x in r.xs),
    "tag_tokens": lambda r: "".join(f"<{r.s}>{t}</{r.s}>" for t in r.ts),
    "first_long_word": lambda r: next((t for t in r.ts if len(t) >= r.k), ""),
    "mean_length": lambda r: sum(map(len, r.ts)) / len(r.ts),
    "uppercase_short": lambda r: [t.upper() for t in r.ts if len(t) <= r.k],
    "strip_all": lambda r: [t.strip() for t in r.ts],
    "normalized_names": lambda r: " ".join(t for t in (t.strip().lower() for t in r.ts) if t not in r.us),
    "longest_common_prefix": lambda r: prefix(r.ts),
    "common_prefix_count": lambda r: sum(t.startswith(r.s) for t in r.ts),
}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(9)
    num = lambda n, a=-6, b=6: [rng.randint(a, b) for _ in range(n)]
    word = lambda n: "".join(rng.choice("abB/ \t ") for _ in range(n))
    rows = []
    for i in range(120):
        n = 0 if i < 4 else rng.randint(0, 9)
        least = rng.randint(0, 1)  # empty words and rows in half of the cases
        few = num(n) if i % 3 else num(n, -300, 300)
        rows.append((few, num(rng.randint(0, 6)), [word(rng.randint(least, 4)) for _ in range(n)], [word(1), "a", "b"], [tuple(num(2)) for _ in range(n)], [tuple(num(2)) for _ in range(n)],
                     [(word(rng.randint(least, 2)), rng.randint(-5, 9)) for _ in range(n)], [(word(1), word(2)) for _ in range(n)], [num(rng.randint(least, 3)) for _ in range(rng.randint(0, 3))], word(rng.randint(0, 9)), word(1), rng.randint(0, 5), -2, 3))
    return spark.createDataFrame(rows, SCHEMA).cache()


def plain(f, r):
    try:
        return f(r)
    except (ValueError, KeyError, IndexError, ZeroDivisionError):
        return None


def same(a, b):
    if isinstance(a, list | tuple) and isinstance(b, list | tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) and b is not None or isinstance(b, float) and a is not None:
        return math.isclose(a, b, abs_tol=1e-12)
    return a == b


def test_library_against_python(table):
    assert set(PLAIN) == set(LIBRARY)
    got = table.select("*", *(column(n) for n in PLAIN)).collect()
    wrong = [(n, [r[c] for c in ("xs", "ys", "ts", "ps", "ns", "rows", "s", "k")], r[n], plain(f, r)) for n, f in PLAIN.items() for r in got if not same(r[n], plain(f, r))]
    assert not wrong, (sorted({w[0] for w in wrong}), wrong[:3])


def test_rounding_is_that_of_binary_values(spark):
    values = [0.005, 0.015, 0.025, 0.125, 2.675, 1.005, -0.125, -2.675, 0.5, 1.5, 2.5, -0.5, 12345.6785, 1e6 + 0.0005, 0.0]
    rng = random.Random(2)
    values += [rng.choice((1, -1)) * rng.randint(0, 10**6) / 2000 for _ in range(2000)]
    for digits in range(4):
        got = spark.createDataFrame([(values,)], "ds array<double>").selectExpr(f"{rounded_to('ds', str(digits))} as r").first().r
        assert got == [round(v, digits) for v in values]


def test_what_depends_on_the_whole_array_alone_is_not_computed_for_each_element():
    from emberline.functions import arrays

    each = re.compile(r"(transform|filter|exists)\((xs|ys|ts|ps|ns|rows), \(?[a-z, ]+\)? -> (?:(?!transform\(array\().)*(array_sort\(xs\)|array_(max|min)\((xs|transform\(xs|flatten)|aggregate\((xs|ts|ps|ns|flatten)|flatten\(rows\))")
    assert not [n for n, x in {**arrays.LIBRARY, **LIBRARY}.items() if each.search(x)]
