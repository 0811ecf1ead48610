"""The workload library's array computations as Spark SQL expressions.

Arguments are columns: xs, ys arrays of bigint; ts, us arrays of strings; ps an array of struct<a bigint, b bigint>; rows an array of
arrays of bigint; s, s2 strings; k, lo, hi bigint. Order is kept, ties go to the first, windows and running values are folds over the
array, so each is a narrow expression. Where the plain function raises on an empty input the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "cast(array() as array<bigint>)"


def first_by(array: str, better: str) -> str:
    """The first element x that no other beats, by a key that is to be large."""
    return f"array_max(transform({array}, (x, i) -> struct({better}, -i, x as value))).value"


def let(name: str, value: str, body: str) -> str:
    """body with name for value, which is computed once and not for each element of the arrays that body goes through."""
    return f"transform(array({value}), {name} -> {body})[0]"


def times(array: str, value: str) -> str:
    """How often an array holds a value; never for null."""
    return f"coalesce(size({array}) - size(array_remove({array}, {value})), 0)"


def smaller(array: str, value: str) -> str:
    """How many elements come before a value that a sorted array holds."""
    return f"cast(coalesce(array_position({array}, {value}) - 1, 0) as int)"


def grouped(array: str) -> str:
    """array<struct<v, n, p>>: each value, its count and its first place, by place."""
    return f"transform(array_distinct({array}), v -> struct(v as v, {times(array, 'v')} as n, array_position({array}, v) as p))"


def groups(array: str, key: str, value: str) -> str:
    """array<struct<k, vs>> of elements e at places i: sorted once by key and place, each group is a slice. Keys stand in the order in which they first appear."""
    sliced = f"slice(vals, cast(coalesce(array_position(sorted, g), 1) as int), {times('sorted', 'g')})"
    body = let("sorted", "entries.k", let("vals", "entries.v", f"transform(array_distinct(transform({array}, e -> {key})), g -> struct(g as k, {sliced} as vs))"))
    return let("entries", f"array_sort(transform({array}, (e, i) -> struct({key} as k, i as i, {value} as v)))", body)


def scan(array: str, start: str, step: str) -> str:
    """Running values of a fold a -> step(a, x)."""
    return f"aggregate({array}, struct(cast({start} as bigint) as a, {NONE} as out), (q, x) -> struct({step.replace('@', 'q.a')} as a, concat(q.out, array({step.replace('@', 'q.a')})) as out), q -> q.out)"


def lookups(pairs: str, key: str, value: str, body: str, of: str, default: str) -> str:
    """body with @ for the last value of a key, or the default."""
    last = f"coalesce(try_element_at(vals, cast(nullif(array_position(names, {of}), 0) as int)), {default})"
    return let("names", f"reverse(transform({pairs}, p -> p.{key}))", let("vals", f"reverse(transform({pairs}, p -> p.{value}))", body.replace("@", last)))


TOTAL = "aggregate({0}, cast(0 as bigint), (a, x) -> a + x)"
SUM_XS = TOTAL.format("xs")
MEAN = f"({SUM_XS} / nullif(size(xs), 0))"
SORTED = "array_sort(xs)"
UPPER_MEDIAN = f"try_element_at({SORTED}, cast(floor(size(xs) / 2) as int) + 1)"
LARGEST, SMALLEST = "array_max(xs)", "array_min(xs)"

LIBRARY: dict[str, str] = {
    # membership and sets
    "contains_duplicate": "size(xs) <> size(array_distinct(xs))",
    "count_common": "size(filter(xs, x -> array_contains(ys, x)))",
    "remove_stopwords": "filter(ts, t -> not array_contains(us, t))",
    "two_sum_exists": f"exists(xs, x -> array_contains(xs, k - x) and (k - x <> x or {times('xs', 'x')} > 1))",
    "unique_preserve_order": "array_distinct(xs)",
    "intersection_size": "size(array_intersect(xs, ys))",
    "filter_known": "filter(ts, t -> array_contains(us, t))",
    "member_flags": "transform(xs, x -> array_contains(ys, x))",
    "first_missing": "try_element_at(filter(xs, x -> not array_contains(ys, x)), 1)",
    "all_covered": "size(array_except(xs, ys)) = 0",
    "count_new_ids": "size(array_distinct(xs))",
    "first_repeat": "try_element_at(filter(transform(xs, (x, i) -> if(array_position(xs, x) <= i, x, null)), x -> x is not null), 1)",
    "longest_unique_prefix": "coalesce(try_element_at(filter(transform(xs, (x, i) -> if(array_position(xs, x) <= i, i, null)), i -> i is not null), 1), size(xs))",
    "symmetric_difference_size": "size(filter(xs, x -> not array_contains(ys, x))) + size(filter(ys, y -> not array_contains(xs, y)))",
    "intersect_ordered": "filter(xs, x -> array_contains(ys, x))",
    "split_by_membership": "array(filter(xs, x -> array_contains(ys, x)), filter(xs, x -> not array_contains(ys, x)))",
    "missing_in_range": "array_except(transform(sequence(0, greatest(coalesce(array_max(xs), 0), 0)), i -> cast(i as bigint)), concat(xs, array(cast(greatest(coalesce(array_max(xs), 0), 0) as bigint))))",
    "count_shared_letters": "size(filter(split(s, ''), c -> c <> '' and instr(s2, c) > 0))",
    "is_anagram_pair": "array_sort(split(s, '')) = array_sort(split(s2, ''))",
    "nested_membership": "transform(rows, r -> size(filter(r, x -> array_contains(xs, x))))",
    # counts and groups
    "most_frequent": f"array_max(transform({grouped('xs')}, g -> struct(g.n, -g.p, g.v as value))).value",
    "majority_element": f"try_element_at(transform(filter({grouped('xs')}, g -> g.n * 2 > size(xs)), g -> g.v), 1)",
    "duplicates_only": f"transform(filter({grouped('xs')}, g -> g.n > 1), g -> g.v)",
    "word_frequencies": f"transform({grouped('ts')}, g -> concat(g.v, '=', g.n))",
    "group_by_parity": "array(filter(xs, x -> pmod(x, 2) = 0), filter(xs, x -> pmod(x, 2) = 1))",
    "positions_of": f"transform({groups('xs', 'e', 'i')}, g -> g.vs)",
    "flag_frequent": f"transform(xs, x -> {times('xs', 'x')} >= k)",
    "sum_by_key": f"transform({groups('ps', 'e.a', 'e.b')}, g -> struct(g.k as a, aggregate(g.vs, cast(0 as bigint), (t, b) -> t + b) as b))",
    "dedupe_keep_max": f"transform(array_sort({groups('ps', 'e.a', 'e.b')}), g -> struct(g.k as a, array_max(g.vs) as b))",
    "unique_per_key": f"transform({groups('ps', 'e.a', 'e.b')}, g -> size(array_distinct(g.vs)))",
    "count_even": "size(filter(xs, x -> pmod(x, 2) = 0))",
    "count_matching_prefix": "size(filter(ts, t -> startswith(t, s)))",
    "count_matching": "size(filter(zip_with(slice(xs, 1, least(size(xs), size(ys))), slice(ys, 1, least(size(xs), size(ys))), (x, y) -> x = y), b -> b))",
    # arithmetic over the whole array
    "normalize_scores": let("total", SUM_XS, "transform(xs, x -> x / nullif(total, 0))"),
    "count_above_mean": let("mean", MEAN, "size(filter(xs, x -> x > mean))"),
    "clip_to_bounds": "transform(xs, x -> greatest(lo, least(hi, x)))",
    "rank_by_sorted_position": let("sorted", SORTED, f"transform(xs, x -> {smaller('sorted', 'x')})"),
    "center_values": let("mean", MEAN, "transform(xs, x -> x - mean)"),
    "deviation_from_max": let("top", LARGEST, "transform(xs, x -> top - x)"),
    "relative_to_min": let("low", SMALLEST, "transform(xs, x -> x - low)"),
    "count_above_half_max": let("top", LARGEST, "size(filter(xs, x -> x > top / 2))"),
    "scale_to_unit": let("top", LARGEST, let("low", SMALLEST, "transform(xs, x -> if(top = low, 0D, (x - low) / (top - low)))")),
    "last_n_sum": let("last", TOTAL.format("slice(xs, greatest(size(xs) - cast(k as int), 0) + 1, cast(k as int))"), "transform(xs, x -> x + last)"),
    "bucket_index": "transform(xs, x -> cast(x / 10 as bigint))",
    "compare_to_median": let("median", UPPER_MEDIAN, "transform(xs, x -> x > median)"),
    "count_in_top_half": let("median", UPPER_MEDIAN, "size(filter(xs, x -> x >= median))"),
    "distance_to_nearest_end": "transform(xs, (x, i) -> least(i, size(xs) - 1 - i))",
    "windowed_flags": "transform(xs, (x, i) -> i + k < size(xs))",
    "value_range": "array_max(xs) - array_min(xs)",
    "extreme_gap": let("top", LARGEST, let("low", SMALLEST, "transform(xs, x -> greatest(top - x, x - low))")),
    "sum_of_squares_odd": "aggregate(filter(xs, x -> pmod(x, 2) = 1), cast(0 as bigint), (a, x) -> a + x * x)",
    "total_positive": "aggregate(filter(xs, x -> x > 0), cast(0 as bigint), (a, x) -> a + x)",
    "outlier_flags": let("mean", MEAN, let("widest", "array_max(transform(xs, y -> abs(y - mean)))", "transform(xs, x -> abs(x - mean) > widest / 2)")),
    "pair_with_max_product": let("sorted", SORTED, "if(size(xs) < 2, null, greatest(element_at(sorted, 1) * element_at(sorted, 2), element_at(sorted, -1) * element_at(sorted, -2)))"),
    "dot_product": "aggregate(zip_with(slice(xs, 1, least(size(xs), size(ys))), slice(ys, 1, least(size(xs), size(ys))), (x, y) -> x * y), cast(0 as bigint), (a, x) -> a + x)",
    # order, folds and windows
    "prefix_sums": scan("xs", "0", "@ + x"),
    "cumulative_max": scan("xs", "-9223372036854775808", "greatest(@, x)"),
    "running_min": scan("xs", "9223372036854775807", "least(@, x)"),
    "moving_average": "if(k <= 0 or k > size(xs), cast(array() as array<double>), transform(sequence(1, size(xs) - cast(k as int) + 1), i -> aggregate(slice(xs, i, cast(k as int)), cast(0 as bigint), (a, x) -> a + x) / k))",
    "min_window_sum": "if(k <= 0 or k > size(xs), null, array_min(transform(sequence(1, size(xs) - cast(k as int) + 1), i -> aggregate(slice(xs, i, cast(k as int)), cast(0 as bigint), (a, x) -> a + x))))",
    "max_subarray": "if(size(xs) = 0, null, aggregate(xs, struct(cast(null as bigint) as best, cast(null as bigint) as cur), (a, x) -> struct(greatest(a.best, greatest(coalesce(a.cur, 0), 0) + x) as best, greatest(coalesce(a.cur, 0), 0) + x as cur)).best)",
    "pairwise_diffs": "if(size(xs) < 2, cast(array() as array<bigint>), zip_with(slice(xs, 2, size(xs)), slice(xs, 1, greatest(size(xs) - 1, 0)), (x, y) -> x - y))",
    "dedupe_sorted": "filter(transform(xs, (x, i) -> if(i > 0 and try_element_at(xs, i) = x, null, x)), x -> x is not null)",
    "top_k": "slice(sort_array(xs, false), 1, greatest(cast(k as int), 0))",
    "kth_smallest": f"if(k < 0, null, try_element_at({SORTED}, cast(k as int) + 1))",
    "merge_sorted": "array_sort(concat(xs, ys))",
    "remove_duplicates_sorted_output": "array_sort(array_distinct(xs))",
    "count_inversions": "aggregate(transform(xs, (x, i) -> size(filter(slice(xs, i + 2, size(xs)), y -> y < x))), 0, (a, x) -> a + x)",
    "count_subarrays_with_sum": let("sums", f"concat(array(cast(0 as bigint)), {scan('xs', '0', '@ + x')})", f"aggregate(transform(sums, (p, i) -> if(array_contains(sums, p + k), {times('slice(sums, i + 2, size(xs) + 1)', 'p + k')}, 0)), 0, (a, x) -> a + x)"),
    "longest_zero_run": "aggregate(xs, struct(0 as best, 0 as cur), (a, x) -> struct(greatest(a.best, if(x = 0, a.cur + 1, 0)) as best, if(x = 0, a.cur + 1, 0) as cur)).best",
    "first_over_budget": f"coalesce(try_element_at(filter(transform({scan('xs', '0', '@ + x')}, (v, i) -> if(v > k, i, null)), i -> i is not null), 1), -1)",
    "chunk_sums": "if(k <= 0 or size(xs) = 0, cast(array() as array<bigint>), transform(sequence(0, cast(floor((size(xs) - 1) / greatest(k, 1)) as int)), c -> aggregate(slice(xs, c * cast(k as int) + 1, greatest(cast(k as int), 0)), cast(0 as bigint), (a, x) -> a + x)))",
    "interleave": "flatten(zip_with(slice(xs, 1, least(size(xs), size(ys))), slice(ys, 1, least(size(xs), size(ys))), (x, y) -> array(x, y)))",
    "signs": "transform(xs, x -> cast(signum(x) as int))",
    "nonzero_positions": "filter(transform(xs, (x, i) -> if(x <> 0, i, null)), i -> i is not null)",
    "closest_to_zero": f"{first_by('xs', '-abs(x)')}",
    "has_negative": "exists(xs, x -> x < 0)",
    "first_above": "try_element_at(filter(xs, x -> x > k), 1)",
    "first_negative": "coalesce(try_element_at(filter(xs, x -> x < 0), 1), 0)",
    "all_positive": "forall(xs, x -> x > 0)",
    # texts
    "join_tokens": "array_join(ts, ' ')",
    "csv_line": "array_join(transform(xs, x -> cast(x as string)), ',')",
    "repeat_pattern": "repeat(s, cast(k as int))",
    "is_palindrome": "s = reverse(s)",
    "longest_token": f"{first_by('ts', 'length(x)')}",
    "shortest_word": f"{first_by('ts', '-length(x)')}",
    "tokens_longer_than_avg": let("mean", "aggregate(ts, 0, (a, x) -> a + length(x)) / nullif(size(ts), 0)", "filter(ts, t -> length(t) > mean)"),
    "slugify_tokens": "array_join(transform(ts, t -> lower(t)), '-')",
    "key_value_line": "array_join(transform(ps, p -> concat(p.a, '=', p.b)), ';')",
    "bracketed": "array_join(transform(xs, x -> concat('[', x, ']')), '')",
    "reverse_each": "array_join(transform(ts, t -> reverse(t)), ' ')",
    "dedupe_join": "array_join(array_distinct(ts), ' ')",
    "distinct_sorted_line": "array_join(array_sort(array_distinct(ts)), ' ')",
    "indexed_tokens": "transform(ts, (t, i) -> concat(i, ':', t))",
    "longest_tokens": let("longest", "array_max(transform(ts, u -> length(u)))", "filter(ts, t -> length(t) = longest)"),
    "lengths_of": "transform(ts, t -> length(t))",
    "has_long_token": "exists(ts, t -> length(t) > k)",
    # pairs and rows
    "pair_sums": "transform(ps, p -> p.a + p.b)",
    "any_pair_sums_to": "exists(ps, p -> p.a + p.b = k)",
    "all_sorted_pairs": "forall(ps, p -> p.a <= p.b)",
    "contains_negative_product": "exists(ps, p -> p.a * p.b < 0)",
    "flatten_pairs": "flatten(transform(ps, p -> array(p.a, p.b)))",
    "lookup_last": lookups("ps", "a", "b", "transform(xs, x -> @)", "x", "-1"),
    "flatten": "flatten(rows)",
    "row_maxima": "transform(filter(rows, r -> size(r) > 0), r -> array_max(r))",
    "row_minima": "transform(filter(rows, r -> size(r) > 0), r -> array_min(r))",
    "row_sums": "transform(rows, r -> aggregate(r, cast(0 as bigint), (a, x) -> a + x))",
    "nonempty_rows": "filter(rows, r -> size(r) > 0)",
    "first_elements": "transform(filter(rows, r -> size(r) > 0), r -> r[0])",
    "longest_row": f"{first_by('rows', 'size(x)')}",
    "max_row_by_total": f"{first_by('rows', 'aggregate(x, cast(0 as bigint), (a, y) -> a + y)')}",
    "intersect_count_multi": "if(size(rows) = 0, 0, size(aggregate(rows, array_distinct(rows[0]), (a, r) -> array_intersect(a, r))))",
}


def column(name: str) -> Column:
    return F.expr(LIBRARY[name]).alias(name)
