"""Quality rules: text statistics in Spark expressions, and decision lists learned from labelled statistics.

statistics() computes every figure with built-in functions over the whole text. learn() grows and prunes conjunctions
of thresholds by sequential covering: a rule starts empty, takes the condition with the largest information gain on
two thirds of the rows until it covers hardly any good text, loses conditions again while that helps on the held-out
third, and the rows it covers leave before the next rule. verdict() turns the rules, in order, into one CASE WHEN.

Words are runs of characters other than x20 and x09 to x0D. n_repeat_words counts the words that lie in a 5-word window
found twice or more in the text, the first included; windows are compared by the 64-bit XXH64 chain of their words
within one text (two windows of a text of 20,000 words differ but agree so with a chance of about 1e-11).

Results in special cases: a null text counts as empty and has zeros throughout; repeated rows each give a row; an empty
table gives an empty one; without labels of both kinds the list has no rule and keeps all; rows whose label is null
teach nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import WORD_SPACE, text_or_empty

SPACE_CLASS = r"[\x20\x09-\x0D]"
WINDOW = 5
#: Labelled rows that learn() gets at most; those with the smallest hash of their id.
MAX_LABELLED = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_chars")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *STATS as long) of every row."""
    trimmed = F.btrim("text", F.lit(WORD_SPACE))
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    words = F.when(trimmed == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = rows.select("id", "text", words.alias("words"), lines.alias("lines"))
    hashes = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.col("words")[i + k] for k in range(WINDOW)))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    b = a.select(
        "id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("text", F.lit(r"[!?]")).alias("n_marks"),
        F.length("text").alias("n_chars"),
        hashes.alias("hashes"),
    )
    kept = [c for c in b.columns if c != "hashes"]
    twice = F.size(F.array_distinct("hashes")) < F.size("hashes")
    c = b.select(*kept, F.when(twice, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("pairs"))
    pairs, last = F.col("pairs"), F.size("pairs") - 1
    same = F.filter(
        "pairs",
        lambda x, i: F.when(i > 0, pairs[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]).otherwise(F.lit(False)) | F.when(i < last, pairs[F.least(i + 1, last)]["h"] == x["h"]).otherwise(F.lit(False)),
    )
    d = c.select(*kept, F.sort_array(F.transform(same, lambda x: x["i"])).alias("starts"))
    starts = F.col("starts")
    own = F.transform("starts", lambda s, i: F.when(i < F.size("starts") - 1, F.least(F.lit(WINDOW), starts[F.least(i + 1, F.size("starts") - 1)] - s)).otherwise(F.lit(WINDOW)))
    e = d.select(*kept, F.coalesce(F.aggregate(own, F.lit(0), lambda x, y: x + y), F.lit(0)).alias("n_repeat_words"))
    # stack() keeps the optimizer from moving a filter on these figures below, where it would repeat them for each word
    return e.select(F.stack(F.lit(1), F.col("id"), *(F.col(s).cast("long") for s in STATS)).alias(id_col, *STATS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


#: What rules put thresholds on, as expressions over STATS.
FEATURES: dict[str, str] = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


def labelled(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LABELLED) -> dict[str, np.ndarray]:
    """FEATURES and "label" of at most `limit` labelled documents that pass the base rules; of documents that share an id one teaches."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("label"))
    few = known.orderBy(F.xxhash64("i"), "i", "label").limit(limit)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(few), "i")
    rows = statistics(texts.select(F.struct("i", "label").alias("key"), "text"), "key").where(~base_failed())
    one = rows.groupBy("key").agg(F.min(F.struct(*(F.expr(e).alias(n) for n, e in FEATURES.items()))).alias("x"))
    got = one.select("key", "key.label", "x.*").orderBy("key").collect()
    return {n: np.array([r[n] for r in got], float) for n in FEATURES} | {"label": np.array([r["label"] for r in got], int)}


def learn(data: dict[str, np.ndarray], bad: int = 0, precision: float = 0.9, least: int = 5, most_rules: int = 8, bins: int = 32) -> list[tuple[Condition, ...]]:
    """Rules for documents labelled `bad`, in the order found. A rule stays if it is right for `precision` of the held-out rows."""
    y = data["label"] == bad
    n = len(y)
    grow = np.arange(n) % 3 != 2
    left, rules = np.ones(n, bool), []
    if not y.any() or y.all():
        return rules

    def score(mask: np.ndarray) -> float:
        return (y[mask].sum() + 1) / (mask.sum() + 2)

    while len(rules) < most_rules:
        covered, rule = left & grow, []
        while len(rule) < 4 and covered.any() and y[covered].mean() < 0.995:
            p0, n0 = y[covered].sum(), covered.sum()
            best, best_gain = None, 1e-9
            for f in FEATURES:
                for t in np.unique(np.quantile(data[f][covered], np.linspace(0, 1, bins + 1))):
                    for c in (Condition(f, True, float(t)), Condition(f, False, float(t))):
                        m = covered & c.holds(data)
                        p = y[m].sum()
                        if p >= least and (gain := p * (np.log(p / m.sum()) - np.log(p0 / n0))) > best_gain:
                            best, best_gain = c, gain
            if best is None:
                break
            rule.append(best)
            covered &= best.holds(data)
        held = left & ~grow

        def on(r: list[Condition], rows: np.ndarray) -> np.ndarray:
            return reduce(np.logical_and, (c.holds(data) for c in r), rows)

        while len(rule) > 1:
            shorter = max(([*rule[:i], *rule[i + 1 :]] for i in range(len(rule))), key=lambda r: score(on(r, held)))
            if score(on(shorter, held)) < score(on(rule, held)):
                break
            rule = shorter
        if not rule or y[on(rule, left)].sum() < least or score(on(rule, held)) < precision or y[on(rule, left)].mean() < precision:
            break
        rule = [_middle(c, data[c.feature][left], data[c.feature][on(rule, left) & y]) for c in rule]
        rules.append(tuple(rule))
        left &= ~on(rule, left)
    return rules


def _middle(c: Condition, every: np.ndarray, covered: np.ndarray) -> Condition:
    """c with its threshold in the middle of the gap between the rows that it refuses and the bad ones that the rule covers."""
    refused = every[every <= c.threshold] if c.above else every[every > c.threshold]
    if not len(refused) or not len(covered):
        return c
    a, b = (refused.max(), covered.min()) if c.above else (refused.min(), covered.max())
    return Condition(c.feature, c.above, float(a + b) / 2)


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The number from 1 of the first rule that holds, else 0, as one CASE WHEN over STATS."""
    if not rules:
        return F.lit(0)
    return F.expr("CASE " + " ".join(f"WHEN {' AND '.join(map(str, r))} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END")


def judged(docs: DataFrame, rules: list[tuple[Condition, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *STATS, base_failed boolean, rule int, kept boolean) of every row."""
    out = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    out = out.withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
