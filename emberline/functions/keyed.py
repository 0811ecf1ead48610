"""The rest of the workload library as Spark SQL expressions: lookups by key, groups, counts, scaled values, texts.

Arguments are columns as in `arrays`, and besides: ns an array of struct<k string, v bigint>, ds an array of struct<k string, v string>,
qs an array of struct<a bigint, b bigint>. A lookup takes the last entry of a key. Groups and counts stand in the order in which their
keys first appear. Where the plain function raises, the result is null; one value for each element of an empty array is the empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline.functions.arrays import LIBRARY as ARRAYS
from emberline.functions.arrays import LARGEST, MEAN, SORTED, SUM_XS, TOTAL, first_by, grouped, groups, let, lookups, smaller, times

#: White space at both ends, and between words, as plain Python's str methods see it.
ENDS = r"r'(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$'"
GAPS = r"r'(?U)[\s\x1c-\x1f]+'"
LENGTHS = "aggregate({0}, cast(0 as bigint), (a, e) -> a + {1})"


def known(pairs: str, key: str, body: str, of: str) -> str:
    """body with @ for whether a key is among those of the pairs."""
    return let("keys", f"transform({pairs}, p -> p.{key})", body.replace("@", f"if(size(keys) = 0, false, array_contains(keys, {of}))"))


def counts(array: str, key: str = "e") -> str:
    """array<struct<k, n>> of elements e."""
    return let("keys", f"transform({array}, e -> {key})", f"transform(array_distinct(keys), g -> struct(g as k, {times('keys', 'g')} as n))")


def unless(wrong: str, value: str) -> str:
    return f"if({wrong}, null, {value})"


def rounded_to(values: str, digits: str) -> str:
    """Doubles rounded to the nearest decimal, exact ties to even: each is split in two parts, whose products with a power of ten (up to 10^7) are exact, so that their distance to the tie has the right sign."""
    high = "(d * 134217729D - (d * 134217729D - d))"
    parts = f"transform({values}, d -> struct({high} * pow(10D, {digits}) as h, (d - {high}) * pow(10D, {digits}) as l))"
    floors = f"transform({parts}, q -> struct(floor(q.h + q.l) as m, q.h as h, q.l as l))"
    past = "((q.h - (q.m + 0.5D)) + q.l)"
    return f"transform({floors}, q -> (q.m + case when {past} > 0 then 1 when {past} < 0 then 0 else pmod(q.m, 2) end) / pow(10D, {digits}))"


BY_COUNT = f"transform(array_sort(transform({grouped('ts')}, g -> struct(-g.n as a, g.p as b, g.v as v))), g -> g.v)"
LETTERS = "filter(split(s, ''), e -> e <> '')"
NO_KEY = "exists(ts, t -> t = '')"
GRAND = TOTAL.format("flatten(rows)")
PAIR_MEANS = ("(aggregate(ps, 0D, (t, p) -> t + p.a) / nullif(size(ps), 0))", "(aggregate(ps, 0D, (t, p) -> t + p.b) / nullif(size(ps), 0))")

LIBRARY: dict[str, str] = {
    # lookups
    "lookup_prices": lookups("ns", "k", "v", "transform(ts, t -> @)", "t", "0"),
    "map_ids": unless(known("ps", "a", "exists(xs, x -> not @)", "x"), lookups("ps", "a", "b", "transform(xs, x -> @)", "x", "null")),
    "resolve_ids": lookups("ps", "a", "b", "transform(xs, x -> @)", "x", "-1"),
    "price_total": TOTAL.format(lookups("ns", "k", "v", "transform(ts, t -> @)", "t", "0")),
    "known_ids_count": known("ps", "a", "size(filter(xs, x -> @))", "x"),
    "translate_tokens": lookups("ds", "k", "v", "transform(ts, t -> @)", "t", "t"),
    "relabel": lookups("ds", "k", "v", "transform(ts, t -> @)", "t", "t"),
    "missing_keys": known("ns", "k", "filter(ts, t -> not @)", "t"),
    "has_all_keys": known("ns", "k", "forall(ts, t -> @)", "t"),
    "weighted_total": TOTAL.format(lookups("ps", "a", "b", "transform(xs, x -> 2 * @)", "x", "1")),
    "score_lookup_max": lookups("ns", "k", "v", "array_max(transform(ts, t -> @))", "t", "0"),
    "lookup_pairs_both": "zip_with({0}, {1}, (a, b) -> a + b)".format(*(lookups("qs", "a", "b", "transform(ps, e -> @)", f"e.{x}", "0") for x in "ab")),
    "pair_lookup_sum": TOTAL.format(lookups("ps", "a", "b", "transform(xs, x -> @)", "x", "0")),
    "format_scores": lookups("ns", "k", "v", "array_join(transform(ts, t -> concat(t, ': ', @)), chr(10))", "t", "0"),
    "best_score_name": f"{first_by('ns', 'x.v')}.k",
    "above_mean_names": let("mean", "aggregate(ns, 0D, (t, q) -> t + q.v) / nullif(size(ns), 0)", "transform(filter(ns, p -> p.v > mean), p -> p.k)"),
    # membership
    "count_hits": ARRAYS["count_common"],
    "overlap_count": ARRAYS["count_common"],
    "drop_banned": ARRAYS["remove_stopwords"],
    "unknown_words": ARRAYS["remove_stopwords"],
    "mark_seen": "transform(ts, t -> struct(t as e, array_contains(us, t) as seen))",
    "count_pairs_in_table": "size(filter(ps, p -> array_contains(ys, p.a) and array_contains(ys, p.b)))",
    "matches_sorted_prefix": let("first", f"slice({SORTED}, 1, 5)", "filter(ys, y -> array_contains(first, y))"),
    "report_known_ratio": "concat(size(filter(xs, x -> array_contains(ys, x))), '/', size(xs))",
    "percent_known": unless("size(ts) = 0", "cast(bround(100 * size(filter(ts, t -> array_contains(us, t))) / nullif(size(ts), 0)) as bigint)"),
    "filter_and_scale": let("top", LARGEST, "transform(filter(xs, x -> array_contains(ys, x)), x -> x / nullif(top, 0))"),
    # groups and counts
    "group_by_key": groups("ps", "e.a", "e.b"),
    "group_pairs": groups("ps", "e.a", "e.b"),
    "bucket_by_length": groups("ts", "length(e)", "e"),
    "anagram_groups": f"transform({groups('ts', "array_join(array_sort(split(e, '')), '')", 'e')}, g -> g.vs)",
    "index_by_first_letter": unless(NO_KEY, groups("ts", "substring(e, 1, 1)", "e")),
    "token_lengths_by_letter": unless(NO_KEY, groups("ts", "substring(e, 1, 1)", "length(e)")),
    "char_histogram": counts(LETTERS),
    "count_tokens": counts("ts"),
    "count_values": counts("xs"),
    "count_pairs_by_first": counts("ps", "e.a"),
    "histogram_buckets": unless("k <= 0", counts("xs", "(e - pmod(e, if(k > 0, k, 1))) div if(k > 0, k, 1)")),
    "mode_value": ARRAYS["most_frequent"],
    "top_tokens_line": f"array_join(slice({BY_COUNT}, 1, cast(greatest(k, 0) as int)), ',')",
    "rank_tokens": let("ranked", BY_COUNT, "transform(ts, t -> array_position(ranked, t) - 1)"),
    "group_sizes_line": let("keys", "transform(ps, p -> p.a)", f"array_join(transform(array_sort(array_distinct(keys)), v -> concat(v, ':', {times('keys', 'v')})), ' ')"),
    # values against the whole array
    "scale_by_max": let("top", LARGEST, "transform(xs, x -> x / nullif(top, 0))"),
    "fraction_of_total": ARRAYS["normalize_scores"],
    "percent_of_max": let("top", LARGEST, "transform(xs, x -> cast(bround(100 * x / nullif(top, 0)) as bigint))"),
    "normalize_by_first": "transform(xs, x -> x / (abs(xs[0]) + 1))",
    "above_threshold_ratio": "transform(xs, x -> x > k * size(xs))",
    "mask_by_sorted_cutoff": unless("k < 0 or k >= size(xs)", let("sorted", SORTED, "transform(xs, x -> x >= try_element_at(sorted, cast(k as int) + 1))")),
    "label_by_quantile": let("sorted", SORTED, "transform(xs, x -> case when x < sorted[size(xs) div 4] then 'low' when x > sorted[3 * size(xs) div 4] then 'high' else 'mid' end)"),
    "rank_all": ARRAYS["rank_by_sorted_position"],
    "count_less_than_each": ARRAYS["rank_by_sorted_position"],
    "index_in_sorted": unless("exists(ys, y -> not array_contains(xs, y))", let("sorted", SORTED, f"transform(ys, y -> {smaller('sorted', 'y')})")),
    "distances_to_center": let("ma", PAIR_MEANS[0], let("mb", PAIR_MEANS[1], "transform(ps, e -> abs(e.a - ma) + abs(e.b - mb))")),
    "value_span": ARRAYS["value_range"],
    "center_and_round": rounded_to(ARRAYS["center_values"], "k"),
    "summary_line": unless("size(xs) = 0", "concat('min=', array_min(xs), ' max=', array_max(xs), ' n=', size(xs))"),
    # element by element, and neighbours
    "index_pairs_in_range": "filter(transform(xs, (x, i) -> if(x between lo and hi, i, null)), i -> i is not null)",
    "filter_in_range": "filter(xs, x -> x between lo and hi)",
    "clamp_all": ARRAYS["clip_to_bounds"],
    "squares_of_evens": "transform(filter(xs, x -> pmod(x, 2) = 0), x -> x * x)",
    "scaled_ints": "transform(xs, x -> x * k)",
    "absolute_values": "transform(xs, x -> abs(x))",
    "threshold_flags": "transform(xs, x -> x >= k)",
    "even_odd_split": ARRAYS["group_by_parity"],
    "diffs_from_previous": ARRAYS["pairwise_diffs"],
    "bounded_diffs": f"transform({ARRAYS['pairwise_diffs']}, x -> least(k, abs(x)))",
    "running_total": ARRAYS["prefix_sums"],
    "weighted_sum": ARRAYS["dot_product"],
    "squares_sum": "if(k <= 0, 0, (k - 1) * k * (2 * k - 1) div 6)",
    "longest_streak_value": "aggregate(xs, struct(cast(null as bigint) as best, 0 as top, cast(null as bigint) as cur, 0 as n), (q, x) -> struct(if(if(x <=> q.cur, q.n + 1, 1) > q.top, x, q.best) as best, greatest(q.top, if(x <=> q.cur, q.n + 1, 1)) as top, x as cur, if(x <=> q.cur, q.n + 1, 1) as n), q -> q.best)",
    # pairs of places
    "count_pairs_with_sum": TOTAL.format(f"transform(xs, (x, i) -> {times('slice(xs, 1, i)', 'k - x')})"),
    "has_pair_with_diff": "if(k = 0, size(xs) <> size(array_distinct(xs)), exists(xs, x -> coalesce(array_contains(xs, try_add(x, abs(k))), false)))",
    "count_distinct_pairs_sum": "size(filter(array_distinct(xs), x -> x < k - x and array_contains(xs, k - x)))",
    "two_sum_indices": "try_element_at(filter(transform(xs, (x, i) -> if(array_position(xs, k - x) between 1 and i, array(cast(array_position(xs, k - x) - 1 as int), i), null)), p -> p is not null), 1)",
    "peak_pair": first_by("ps", "x.b"),
    # rows
    "zero_padded": "transform(rows, r -> concat(r, array_repeat(cast(0 as bigint), cast(greatest(k - size(r), 0) as int))))",
    "rows_above_mean_len": let("mean", "size(flatten(rows)) / nullif(size(rows), 0)", "filter(rows, r -> size(r) > mean)"),
    "widest_range_row": unless("exists(rows, r -> size(r) = 0)", first_by("rows", "array_max(x) - array_min(x)")),
    "row_fractions": let("total", GRAND, "transform(rows, r -> transform(r, x -> x / nullif(total, 0)))"),
    "shifted_by_min": unless("exists(rows, r -> size(r) = 0)", let("low", "array_min(flatten(rows))", "transform(rows, r -> transform(r, x -> x - low))")),
    "csv_rows": "array_join(transform(rows, r -> array_join(transform(r, x -> cast(x as string)), ',')), chr(10))",
    # texts
    "reverse_words": f"array_join(reverse(filter(split(s, {GAPS}), w -> w <> '')), ' ')",
    "comma_list": "array_join(ts, ', ')",
    "render_row": "concat('|', array_join(transform(xs, x -> cast(x as string)), '|'), '|')",
    "initials": unless(NO_KEY, "array_join(transform(ts, t -> substring(t, 1, 1)), '')"),
    "build_path": "array_join(transform(ts, t -> trim(both '/' from t)), '/')",
    "wrap_words": "aggregate(ts, struct('' as out, cast(0 as bigint) as used, false as some), (q, t) -> struct(concat(q.out, case when not q.some then '' when q.used + length(t) > k then chr(10) else ' ' end, t) as out, if(q.some and q.used + length(t) <= k, q.used, cast(0 as bigint)) + length(t) + 1 as used, true as some), q -> q.out)",
    "repeat_joined": "array_join(array_repeat(s, cast(greatest(k, 0) as int)), s2)",
    "capitalize_sentence": "array_join(transform(ts, t -> concat(upper(substring(t, 1, 1)), substring(t, 2))), ' ')",
    "hex_string": "array_join(transform(xs, x -> concat(case when x < 0 then '-' when x < 16 then '0' else '' end, lower(hex(abs(x))))), '')",
    "tag_tokens": "array_join(transform(ts, t -> concat('<', s, '>', t, '</', s, '>')), '')",
    "first_long_word": "coalesce(try_element_at(filter(ts, t -> length(t) >= k), 1), '')",
    "mean_length": f"{LENGTHS.format('ts', 'length(e)')} / nullif(size(ts), 0)",
    "uppercase_short": "transform(filter(ts, t -> length(t) <= k), t -> upper(t))",
    "strip_all": f"transform(ts, t -> regexp_replace(t, {ENDS}, ''))",
    "normalized_names": f"array_join(filter(transform(ts, t -> lower(regexp_replace(t, {ENDS}, ''))), t -> not array_contains(us, t)), ' ')",
    "longest_common_prefix": "if(size(ts) = 0, '', aggregate(ts, ts[0], (p, t) -> if(p = '' or t = '', '', substring(p, 1, size(filter(sequence(1, greatest(least(length(p), length(t)), 1)), i -> substring(p, 1, i) = substring(t, 1, i)))))))",
    "common_prefix_count": ARRAYS["count_matching_prefix"],
}


def column(name: str) -> Column:
    return F.expr(LIBRARY[name]).alias(name)
