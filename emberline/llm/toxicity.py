"""Toxicity: bags of subword embeddings averaged into a linear softmax.

A word is itself and its character n-grams with boundary marks, each hashed to an embedding; its vector is their average, and
that of a window of words is the average of theirs. Embeddings and softmax are trained jointly in numpy, so a misspelling or an
inflection that was never seen shares most vectors with words that were. A text is scored by its most toxic window of few words, as the
words that matter would vanish in a longer average; in training, too, a toxic text teaches by the windows that look
most toxic, a clean one by all its windows and by those most of all.

Three things hold the model back from learning the rows by heart: embeddings begin next to zero, so that what is hardly seen adds no more than the bias, and subwords that were
never seen are left out of averages; steps are scaled by the gradients so far, over a floor that keeps n-grams of one text small; and training ends by the area under the
curve of the calibration rows, whose best epoch counts. Scores are the shares of toxic rows among those rows by log-odds; a bag without evidence has their base rate.
Then a second model learns from all labelled rows, calibration ones included, and the mean of both models' weights is taken: cross-validation found more so (README).

fit() takes a bounded sample, of whole texts: at most MAX_LABELLED labelled texts of each kind to train on and MAX_CALIBRATION to calibrate
on, in the order of a hash of their id, and of those as many as fit into MAX_SAMPLE_CHARS characters in all; every text is scored whole.

Where `collapse` holds, a word that only repeats the one before it counts once, or it would fill windows alone. Cross-validation inside the rows
that may teach decided for it (README).

Results in special cases: a null, empty or wordless text has the calibrated score of an empty bag, near the base rate; repeated rows each give a row;
an empty table gives an empty one; without labels of both kinds every score is 0; rows whose label or id is null teach nothing; of documents that
share an id one teaches; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, written

WORD = re.compile(r"[^\W_]+")
BUCKETS, DIMENSIONS = 1 << 17, 8
SHORTEST, LONGEST = 3, 6
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 4, 2
MAX_LABELLED, MAX_CALIBRATION, MAX_SAMPLE_CHARS = 1200, 2400, 32_000_000
#: Epochs at most, without gain on the calibration rows before the end, of equal windows at the start, and where there are no such rows.
EPOCHS, PATIENCE, WARM, UNCHECKED = 12, 3, 1, 3
BATCH, RATE, FLOOR, TOP = 128, 0.5, 1e-7, 3.0
#: The part of a score that is no share of calibration rows.
TILT = 0.02
CACHE_WORDS = 400_000
THRESHOLD = 0.3


def subwords(word: str) -> Iterator[int]:
    """The buckets of a lower-cased word: itself and its n-grams, boundaries included, in a fixed order, one after the other."""
    marked = f"<{word}>"
    data = marked.encode("utf-8")
    yield crc32(data) % BUCKETS
    if len(data) == len(marked):
        for k in range(SHORTEST, LONGEST + 1):
            for i in range(len(data) - k + 1):
                yield crc32(data[i : i + k]) % BUCKETS
        return
    for k in range(SHORTEST, LONGEST + 1):
        for i in range(len(marked) - k + 1):
            yield crc32(marked[i : i + k].encode("utf-8")) % BUCKETS


def words(text: str | None, collapse: bool = True) -> list[str]:
    """Lower-cased words; with `collapse` without those that only repeat the one before them."""
    found = WORD.findall(text.lower()) if text else []
    return [w for w, last in zip(found, [None, *found], strict=False) if w != last] if collapse else found


def window_starts(n: int, stride: int) -> np.ndarray:
    return np.arange(-(-max(n - WINDOW, 0) // stride) + 1) * stride


@dataclass
class Model:
    """weights: each bucket's part in the log-odds, bias included, nan where it was never seen; base: those of a bag without evidence; knots and rates: the share
    of toxic rows by log-odds; collapse: see words()."""

    weights: np.ndarray
    base: float = 0.0
    knots: tuple[float, ...] = ()
    rates: tuple[float, ...] = ()
    collapse: bool = True

    def __post_init__(self) -> None:
        self.cache: dict[str, float] = {}
        self.table: list[float | None] = [None if w != w else w for w in self.weights.tolist()]

    def __getstate__(self) -> tuple:
        return self.weights, self.base, self.knots, self.rates, self.collapse

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.base, self.knots, self.rates, self.collapse = state
        self.__post_init__()

    def word(self, word: str) -> float:
        """The average of the subwords that were seen, the base without any."""
        table, total, n = self.table, 0.0, 0
        for b in subwords(word):
            if (w := table[b]) is not None:
                total += w
                n += 1
        w = total / n if n else self.base
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if len(word) < 64:
            self.cache[word] = w
        return w

    def log_odds(self, text: str | None) -> float:
        """Of the most toxic window of the whole text."""
        found = words(text, self.collapse)
        if not found:
            return self.base
        values = [*map(self.cache.get, found)]
        if None in values:
            values = [self.word(w) if v is None else v for w, v in zip(found, values, strict=True)]
        n = len(values)
        if n <= WINDOW:
            return sum(values) / n
        sums = np.concatenate([[0.0], np.cumsum(values)])
        starts = window_starts(n, STRIDE)
        ends = np.minimum(starts + WINDOW, n)
        return float(((sums[ends] - sums[starts]) / (ends - starts)).max())

    def score(self, text: str | None) -> float:
        """The share of toxic rows about these log-odds; a part of TILT, the log-odds' own, tells equal shares apart."""
        x = self.log_odds(text)
        own = float(1 / (1 + np.exp(-np.clip(x, -50, 50))))
        return (1 - TILT) * float(np.interp(x, self.knots, self.rates)) + TILT * own if self.knots else own


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sums(groups: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each group."""
    return np.stack([np.bincount(groups, rows[:, k], n) for k in range(rows.shape[1])], axis=1)


class Bags:
    """Texts as windows of words, words as buckets: the vocabulary's buckets one word after the other, and each text's words."""

    def __init__(self, texts: list[str], collapse: bool = True):
        vocabulary: dict[str, int] = {}
        self.docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t, collapse)], np.int32) for t in texts]
        parts = [np.fromiter(subwords(w), np.int32) for w in vocabulary]
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        self.flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def log_odds(self, weights: np.ndarray) -> np.ndarray:
        """Of the most toxic window of each text, 0 for an empty one."""
        own = weights[self.flat]
        seen = ~np.isnan(own)
        sums = [np.add.reduceat(x, self.first[:-1]) if len(x) else x for x in (np.where(seen, own, 0), seen.astype(int))]
        values = sums[0] / np.maximum(1, sums[1])
        out = np.zeros(len(self.docs))
        for k, d in enumerate(self.docs):
            if len(d):
                sums = np.concatenate([[0.0], np.cumsum(values[d], dtype=float)])
                starts = window_starts(len(d), STRIDE)
                ends = np.minimum(starts + WINDOW, len(d))
                out[k] = ((sums[ends] - sums[starts]) / (ends - starts)).max()
        return out


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    """Under the curve of found against falsely flagged rows; ties count half."""
    _, back, n = np.unique(scores, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[back]
    ones = int(labels.sum())
    return float((ranks[labels == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(labels) - ones)))


def train(texts: list[str], labels: list[int], checked: list[str] = (), checked_labels: list[int] = (), seed: int = 7, collapse: bool = True) -> Model:
    """The jointly trained embeddings and softmax, as weights of buckets; the checked rows tell which epoch is the best."""
    rng = np.random.default_rng(seed)
    bags, tests, target = Bags(texts, collapse), Bags(list(checked), collapse), np.array(checked_labels)
    docs, first, flat = bags.docs, bags.first, bags.flat
    E = rng.normal(0, 1e-3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    W = np.stack([-np.ones(DIMENSIONS), np.ones(DIMENSIONS)]).astype(np.float32) * 0.5
    b = np.zeros(2, np.float32)
    gE, gW, gb = np.full_like(E, FLOOR), np.full_like(W, 1e-6), np.full_like(b, 1e-6)
    y = np.array(labels)
    usable = np.array([k for k, d in enumerate(docs) if len(d)], int)
    told = len(set(checked_labels)) > 1
    best, since, weights = -1.0, 0, np.full(BUCKETS, np.nan, np.float32)

    for epoch in range(EPOCHS if told else UNCHECKED):
        order = rng.permutation(usable)
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            tokens, lengths, owner = [], [], []
            for k, d in enumerate(batch):
                starts = window_starts(len(docs[d]), WINDOW)
                tokens.append(docs[d])
                lengths.append(np.minimum(WINDOW, len(docs[d]) - starts))
                owner.append(np.full(len(starts), k))
            lengths, owner = np.concatenate(lengths), np.concatenate(owner)
            own, place = np.unique(np.concatenate(tokens), return_inverse=True)
            sizes = (first[own + 1] - first[own]).astype(np.int64)
            cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            subs = flat[np.repeat(first[own] - cuts, sizes) + np.arange(sizes.sum())]
            V = np.add.reduceat(E[subs], cuts, axis=0) / sizes[:, None]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            X = np.add.reduceat(V[place], starts, axis=0) / lengths[:, None]
            z = X @ W.T + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
            toxic = y[batch][owner] == 1
            weight = 1.0 / np.bincount(owner, minlength=len(batch))[owner]
            most = np.zeros(len(batch)) - 1
            np.maximum.at(most, owner, p[:, 1])
            if epoch >= WARM:
                top = p[:, 1] >= most[owner] * 0.999
                weight = np.where(toxic, top / np.maximum(1, np.bincount(owner, top, len(batch)))[owner], weight + TOP * top)
            d = p.copy()
            d[np.arange(len(d)), toxic.astype(int)] -= 1
            d = (d * weight[:, None] / len(batch) * 16).astype(np.float32)
            dW, db, dX = d.T @ X, d.sum(axis=0), d @ W
            dV = _sums(place, np.repeat(dX / lengths[:, None], lengths, axis=0), len(V))
            dE = _sums(subs, np.repeat(dV / sizes[:, None], sizes, axis=0), BUCKETS).astype(np.float32)
            gE += dE * dE
            E -= RATE * dE / np.sqrt(gE)
            gW += dW * dW
            W -= 0.1 * dW / np.sqrt(gW)
            gb += db * db
            b -= RATE * db / np.sqrt(gb)
        now = np.where((gE > FLOOR).any(axis=1), E @ (W[1] - W[0]) + (b[1] - b[0]), np.nan).astype(np.float32)
        reached = area(tests.log_odds(now), target) if told else epoch
        since = 0 if reached > best else since + 1
        if reached > best:
            best, weights = reached, now
        if since >= PATIENCE:
            break
    return Model(weights, collapse=collapse)


def calibrated(model: Model, texts: list[str], labels: list[int]) -> Model:
    """model with the share of toxic rows by log-odds, as the closest shares that never fall (isotonic regression), and the base where they reach the base rate."""
    x, y = np.array([model.log_odds(t) for t in texts]), np.array(labels, float)
    if len(y) < 20 or y.min() == y.max():
        return model
    pooled: list[list[float]] = []  # rows, sum of log-odds, toxic rows
    for a, b in sorted(zip(x.tolist(), y.tolist(), strict=True)):
        pooled.append([1, a, b])
        while len(pooled) > 1 and pooled[-2][2] * pooled[-1][0] >= pooled[-1][2] * pooled[-2][0]:
            n, a, b = pooled.pop()
            pooled[-1] = [pooled[-1][0] + n, pooled[-1][1] + a, pooled[-1][2] + b]
    # a row more of each kind keeps small pools off 0 and 1
    rates = np.maximum.accumulate([(b + y.mean()) / (n + 1) for n, _, b in pooled])
    model.knots, model.rates = tuple(a / n for n, a, _ in pooled), tuple(rates.tolist())
    at = int(np.searchsorted(rates, y.mean()))
    if 0 < at < len(rates):
        low, high = rates[at - 1], rates[at]
        model.base = float(model.knots[at - 1] + (model.knots[at] - model.knots[at - 1]) * (y.mean() - low) / (high - low))
    else:
        model.base = float(model.knots[min(at, len(rates) - 1)])
    model.cache.clear()
    return model


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED, most_calibration: int = MAX_CALIBRATION, most_chars: int = MAX_SAMPLE_CHARS) -> tuple[list, list]:
    """(rows to train on, rows to calibrate on) of (y, t), in a fixed order; none of them is held out."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), (F.col(label_col) > 0).cast("int").alias("y"), (remainder == 3).alias("last"))

    def few(rows: DataFrame, n: int) -> DataFrame:
        return rows.orderBy(F.xxhash64("i"), "i", "y").limit(n)

    chosen = few(known.where("not last and y = 1"), most).union(few(known.where("not last and y = 0"), most)).union(few(known.where("last"), most_calibration)).distinct()
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")
    picked = written(texts.groupBy("i", "y", "last").agg(F.min_by("t", F.xxhash64("t")).alias("t")))
    left, kept = most_chars, []
    for r in sorted(picked.select("i", "y", "last", F.xxhash64("i").alias("h"), F.length("t").alias("n")).collect(), key=lambda r: (r["h"], r["i"], r["y"])):
        if r["n"] <= left:
            left -= r["n"]
            kept.append((r["i"], r["y"]))
    if not kept:
        return [], []
    ids = docs.sparkSession.createDataFrame(kept, f"i {picked.schema['i'].dataType.simpleString()}, y int")
    got = sorted(picked.join(F.broadcast(ids), ["i", "y"]).collect(), key=lambda r: (r["i"], r["y"]))
    return [(r["y"], r["t"]) for r in got if not r["last"]], [(r["y"], r["t"]) for r in got if r["last"]]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", collapse: bool = True, **bounds: int) -> Model | None:
    """The model of the labelled rows that aren't held out, None without labels of both kinds. docs holds the texts; bounds are those of sample()."""
    rows, rest = sample(docs, labels, label_col, id_col, text_col, **bounds)
    if len({y for y, _ in rows}) < 2:
        return None
    checked, target = [t for _, t in rest], [y for y, _ in rest]
    model = calibrated(train([t for _, t in rows], [y for y, _ in rows], checked, target, collapse=collapse), checked, target)
    return averaged(model, train([t for _, t in rows + rest], [y for y, _ in rows + rest], collapse=collapse)) if model.knots else model


def averaged(model: Model, other: Model) -> Model:
    """model with the mean of both models' weights, where both have seen a subword."""
    a, b = model.weights, other.weights
    mean = np.where(np.isnan(a), b, np.where(np.isnan(b), a, (a + b) / 2)).astype(np.float32)
    return Model(mean, model.base, model.knots, model.rates, model.collapse)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()] if model else [0.0] * batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def score_of(model: Model | None) -> Callable[[Column], Column]:
    """scored()'s score as a function of a text column, for filters that keep all columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) if model else 0.0 for t in texts], dtype="float64")

    return lambda text: score(text.cast("string"))
