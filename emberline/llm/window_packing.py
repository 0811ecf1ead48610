"""Packing by non-negative least squares: windows filled exactly by few whole pieces, and a stream for the rest.

Documents are tokenized once and written as pieces: full windows, then what remains of a document. Every set of up to three lengths
that fills a window exactly is a column, with how often it takes each length; non-negative least squares finds how often to repeat each so
that together they come nearest to the histogram of lengths. Repeats are rounded down and then up while pieces last; what is left is
filled up greedily by decreasing length where sets of any depth fill a window, and the rest is laid end to end and cut at the windows'
ends. The last, unfilled window is cut into powers of two, which need no padding: no token of padding is left, and only pieces of the
stream are cut beyond the cuts that a long document needs.

The histogram (a number for each length up to the capacity) and the plan made from it are all that the driver sees; the plan is bounded
by the capacity and by `Repeats`' parameters. Pieces get their rank among those of their length by the task that wrote them and by counts
of the tasks before it, so the tokens of a piece stay where they are; only those of cut pieces are looked up again.

Results in special cases: a null text counts as empty and is one piece that holds the end token alone; equal rows are each placed;
rows with a null or repeated id are documents of their own; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.bpe import NEWER, ODD_SPACE, SPACE, Bpe
from emberline.llm.common import small_batches, written

CAPACITY = 2048
END = 1
#: Words kept with their tokens by each Python worker, once and as many older ones, and the longest that is kept.
CACHE_WORDS, CACHED_CHARS = 250_000, 64
#: Characters of texts that are split into words at a time; a longer text is by itself.
SPLIT_CHARS = 1_000_000
#: Stands for the end of a word; words that hold it go to the library.
MARK = "\x01"
#: Rows of cut pieces, or of a plan, that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 200_000


class Words:
    """A vocabulary file of the tokenizers library whose words end in a suffix and are split at white space; each word is encoded once.

    Words' parts go to tiktoken together, each with a mark in place of the suffix: the merges keep their order as ranks, after the bytes and the
    bytes with a mark. What that doesn't cover (special tokens, marks, scripts whose tables may be newer here than there) goes to the
    library itself, and so do whole texts with files of another kind. Words of tests and of the tables given encode as by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        try:
            bpe = Bpe(path)
        except ValueError:
            bpe = None
        self.by_word = bpe is not None and bpe.by_space and bool(bpe.end) and not any(regex.search(r"\s", x) for x in bpe.special)
        if not self.by_word:
            return
        self.fold, self.pattern, self.odd = bpe.fold, bpe.pattern, regex.compile("|".join([MARK, NEWER.pattern, *map(regex.escape, bpe.special)]))
        mark, strings = MARK.encode(), [*bpe.bytes, *(c + bpe.end for c in bpe.bytes), *(bpe.strings[i] for i in bpe.merged)]
        ranks: dict[bytes, int] = {}
        for s in strings:
            ends = s.endswith(bpe.end)
            ranks.setdefault(bytes(bpe.back[c] for c in (s[: -len(bpe.end)] if ends else s)) + mark * ends, len(ranks))
        back = [*ranks]
        self.id_of = np.array([bpe.vocab["".join(bpe.bytes[x] for x in s[:-1]) + bpe.end if len(s) > 1 and s[-1:] == mark else "".join(bpe.bytes[x] for x in s)] for s in back], "<u4")
        self.space = ranks[b" "]
        self.ranks = tiktoken.Encoding(path, pat_str=f"[^{MARK} ]*{MARK}| ", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words."""
        odd = {w for w in words if self.odd.search(w)} if self.odd.search(" ".join(words)) else set()
        plain = [w for w in words if w not in odd] if odd else words
        findall, mark = self.pattern.findall, f"{MARK}"
        parts = [w if w.isalpha() else mark.join(findall(w)) for w in self.fold(" ".join(plain)).split(" ")] if plain else []
        found = self.ranks.encode_to_numpy(f"{MARK} ".join([*parts, ""]), disallowed_special=()) if plain else np.zeros(0, np.uint32)
        spaces = np.flatnonzero(found == self.space)
        data = np.delete(self.id_of[found], spaces).tobytes()
        stops = ((spaces - np.arange(len(spaces))) * 4).tolist()
        out = {w: data[a:b] for w, a, b in zip(plain, [0, *stops], stops, strict=False)}
        return out | dict(zip(odd, self._by_library([*odd]), strict=True)) if odd else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        if not self.by_word:
            return self._by_library(texts)
        # lists of words take ten times the bytes of their texts, so few texts are split at a time
        out: list[bytes] = []
        some: list[str] = []
        held = 0
        for text in texts:
            some.append(text)
            held += len(text)
            if held >= SPLIT_CHARS:
                out += self._some(some)
                some, held = [], 0
        return out + self._some(some)

    def _some(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        words = [[w for w in regex.split(f"[{SPACE}]+", t) if w] if ODD_SPACE.search(t) else t.split() for t in texts]
        new = set().union(*words).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        found = self._learn([*new.difference(again)])
        long = {w: x for w, x in found.items() if len(w) > CACHED_CHARS}
        self.known.update(found)
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in words]
        for w in long:
            del self.known[w]
        return out


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of pieces: (id, start, length, doc_tokens long, ids binary: little-endian unsigned 32-bit, part int, rank long).

    `end` stands after each document's own ids. part is the task that made the piece, rank its place among that task's pieces of its length.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, part = words_of(path), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        for batch in batches:
            at, starts, lengths, totals, ids, own = [], [], [], [], [], []
            for i, data in enumerate(known.encode([t or "" for t in batch.column(1).to_pylist()])):
                data += last
                n = len(data) // 4
                for start in range(0, n, capacity):
                    size = min(capacity, n - start)
                    at.append(i)
                    starts.append(start)
                    lengths.append(size)
                    totals.append(n)
                    ids.append(data[4 * start : 4 * (start + size)])
                    own.append(ranks[size])
                    ranks[size] += 1
            whole = [pa.array(x, pa.int64()) for x in (starts, lengths, totals)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *whole, pa.array(ids, pa.binary()), pa.array([part] * len(at), pa.int32()), pa.array(own, pa.int64())], names=["id", "start", "length", "doc_tokens", "ids", "part", "rank"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, ids binary, part int, rank long"))


def combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Every set of one to three of these lengths that adds up to the capacity, a row each, longest first, 0 for no piece."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    short = np.flatnonzero(there[:capacity])
    out += [np.array([[capacity - x, x, 0] for x in short if x and 2 * x <= capacity and there[capacity - x]]).reshape(-1, 3)]
    for k in short[(short > 0) & (3 * short <= capacity)]:
        j = short[(short >= k) & (2 * short <= capacity - k)]
        j = j[there[capacity - k - j]]
        out.append(np.stack([capacity - k - j, j, np.full_like(j, k)], axis=1))
    return np.concatenate(out).astype(np.int64)


class Repeats:
    """How often to repeat each combination: non-negative least squares over all of them, by active columns.

    Columns whose gradient still falls join the active ones, the steepest first and no length twice in a round; the problem over the active
    ones is solved by accelerated projected gradient steps, scaled for each column; columns at zero leave. It ends where no column outside would lower the
    error (by `tolerance`, relative to the steepest at the start), or after `rounds`.
    """

    def __init__(self, columns: np.ndarray, target: np.ndarray, rounds: int = 60, steps: int = 300, tolerance: float = 1e-4):
        self.target = target.astype(float)
        self.columns, self.x = columns[:0], np.zeros(0)
        scale = max(1.0, self.target.max(initial=0))
        b, active, x = self.target / scale, np.zeros(0, np.int64), np.zeros(0)
        limit = tolerance * self._gain(columns, b).max(initial=0)
        for _ in range(rounds):
            gain = self._gain(columns, b - self._used(columns[active], x, len(b)))
            steep = np.flatnonzero(gain > limit)
            steep = steep[np.argsort(-gain[steep], kind="stable")][: 8 * len(b)]
            chosen = self._apart(columns[steep], len(b))
            if not len(chosen) or not limit:
                break
            new = np.setdiff1d(steep[chosen], active)
            if not len(new):
                break
            active, x = np.concatenate([active, new]), np.concatenate([x, np.zeros(len(new))])
            x = self._solved(columns[active], b, x, steps)
            active, x = active[x > 1e-12], x[x > 1e-12]
        self.columns, self.x = columns[active], x * scale

    @staticmethod
    def _gain(columns: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """What is still missing of each column's lengths. rest[0] is that of no piece: 0."""
        return rest[columns].sum(axis=1)

    @staticmethod
    def _used(columns: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        used = np.bincount(columns.ravel(), np.repeat(x, 3), n)
        used[0] = 0
        return used

    @staticmethod
    def _apart(columns: np.ndarray, n: int) -> np.ndarray:
        """The first columns that share no length with one before."""
        taken, out = np.zeros(n, bool), []
        for i, (a, b, c) in enumerate(columns.tolist()):
            if not (taken[a] or taken[b] or taken[c]):
                out.append(i)
                taken[[a, b, c]] = True
                taken[0] = False
        return np.array(out, np.int64)

    def _solved(self, columns: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
        n = len(b)
        scale = self._gain(columns, self._used(columns, np.ones(len(columns)), n))
        y, t = x, 1.0
        for _ in range(steps):
            after = np.maximum(0, y + self._gain(columns, b - self._used(columns, y, n)) / scale)
            if ((y - after) * (after - x)).sum() > 0:  # the speed points uphill: start over
                t = 1.0
            then = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = after + (t - 1) / then * (after - x), after, then
        return x


class Plan:
    """Where the pieces of each length go.

    rows: (length, from rank, to rank, first sequence, pieces a sequence, offset); stream: (length, from rank, to rank, first place) of pieces laid
    end to end from sequence `first` on; tail: where, in the stream, sequences begin after its last full window.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < x <= capacity for x in counts):
            raise ValueError("lengths must be from 1 to the capacity")
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 1, np.int64)
        for x, n in counts.items():
            self.left[x] = n
        self.ranks = np.zeros(capacity + 1, np.int64)
        self._repeat()
        self._fill()
        self.whole = self.sequences
        self._stream()

    def _fix(self, lengths: tuple[int, ...], most: int) -> int:
        """At most so many sequences of these pieces, as far as they last."""
        need = Counter(lengths)
        n = min(most, *(int(self.left[x]) // k for x, k in need.items()))
        if n <= 0:
            return 0
        at = 0
        for x, k in need.items():
            self.rows.append((x, int(self.ranks[x]), int(self.ranks[x]) + n * k, self.sequences, k, at))
            self.ranks[x] += n * k
            self.left[x] -= n * k
            at += x * k
        self.sequences += n
        return n

    def _repeat(self) -> None:
        lengths = np.flatnonzero(self.left)
        if not len(lengths):
            return
        columns = combinations(lengths, self.capacity)
        if not len(columns):
            return
        found = Repeats(columns, self.left)
        whole = np.floor(found.x + 1e-6).astype(np.int64)
        rest = found.x - whole
        for i in np.argsort(-found.x, kind="stable"):
            self._fix(tuple(x for x in found.columns[i].tolist() if x), int(whole[i]))
        for i in np.argsort(-rest, kind="stable"):
            if rest[i] > 0:
                self._fix(tuple(x for x in found.columns[i].tolist() if x), 1)

    def _fill(self) -> None:
        """Longest first, each with the longest that fit, where that fills a sequence."""
        for x in range(self.capacity, 0, -1):
            while self.left[x]:
                chosen, room, free = [x], self.capacity - x, self.left.copy()
                free[x] -= 1
                while room and len(fits := np.flatnonzero(free[: room + 1])):
                    y = int(fits[-1])
                    k = min(room // y, int(free[y]))
                    chosen += [y] * k
                    room -= k * y
                    free[y] -= k
                if room or not self._fix(tuple(chosen), self.capacity * int(self.left[x])):
                    break

    def _stream(self) -> None:
        self.stream, place = [], 0
        for x in range(self.capacity, 0, -1):
            if n := int(self.left[x]):
                self.stream.append((x, int(self.ranks[x]), int(self.ranks[x]) + n, place))
                place += n * x
        self.first, full = self.sequences, place // self.capacity
        self.sequences += full
        self.full, self.tail, at = full, [], full * self.capacity
        for power in reversed(range(self.capacity.bit_length())):
            if (place - full * self.capacity) >> power & 1:
                self.tail.append(at)
                at += 1 << power
        self.sequences += len(self.tail)
        self.cuts = full + len(self.tail)


def packed(rows: DataFrame, capacity: int = CAPACITY, value: Callable[[Column], Column] = lambda ids: ids, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, start, length, doc_tokens, value, sequence_id, offset long) of every piece as it is placed; rows is a table of `pieces`.

    value is made from the ids of a piece, so that a digest can stand in their place; sequence ids have no gaps.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    counts = written(counts.select("part", "length", "n", before.alias("before")))
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    # counts grow with the rows, so they are never broadcast
    ranked = rows.select("id", "start", "length", "doc_tokens", value(F.col("ids")).alias("value"), "part", "rank").join(counts.drop("n").hint("merge"), ["part", "length"])
    ranked = ranked.withColumn("place", F.col("rank") + F.col("before"))
    spots = [(x, a, b, first, each, at, None) for x, a, b, first, each, at in plan.rows] + [(x, a, b, None, None, None, place) for x, a, b, place in plan.stream]
    table = spark.createDataFrame(spots, "of long, from long, to long, first long, each long, at long, stream long")
    inside = (F.col("length") == F.col("of")) & (F.col("place") >= F.col("from")) & (F.col("place") < F.col("to"))
    if len(spots) <= broadcast_rows:
        placed = ranked.join(F.broadcast(table), inside)
    else:
        placed = ranked.join(table.hint("merge"), inside)
    k, cap = F.col("place") - F.col("from"), F.lit(capacity).cast("long")
    whole = F.struct((F.col("first") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("each")) * F.col("length")).cast("long").alias("offset"))
    position = F.col("stream") + k * F.col("length")
    placed = written(placed.select("id", "start", "length", "doc_tokens", "value", "part", "rank", whole.alias("whole"), position.alias("position")))
    # cuts inside a piece of the stream: the end of the window that it begins in, and where the sequences of the tail begin
    stop = F.col("position") + F.col("length")
    tail = F.array(*(F.lit(x).cast("long") for x in plan.tail)) if plan.tail else F.expr("cast(array() as array<long>)")
    ends = F.array_sort(F.array_distinct(F.concat(F.array((F.floor(F.col("position") / cap).cast("long") + 1) * cap), tail)))
    cuts = F.filter(ends, lambda c: (c > F.col("position")) & (c < stop))
    stream = placed.where("position is not null").withColumn("cuts", cuts)

    def spot(place: Column) -> Column:
        """The sequence and the offset of a place in the stream."""
        begins = F.filter(tail, lambda c: c <= place)
        full = place < plan.full * capacity
        sequence = F.when(full, F.floor(place / cap)).otherwise(plan.full - 1 + F.size(begins)) + plan.first
        return F.struct(sequence.cast("long").alias("sequence_id"), F.when(full, F.pmod(place, cap)).otherwise(place - F.array_max(begins)).cast("long").alias("offset"))

    out = ["id", "start", "length", "doc_tokens", "value", "spot.sequence_id", "spot.offset"]
    uncut = placed.where("position is null").withColumn("spot", F.col("whole")).select(*out)
    uncut = uncut.unionByName(stream.where(F.size("cuts") == 0).withColumn("spot", spot(F.col("position"))).select(*out))
    if not plan.cuts:
        return uncut
    cut = stream.where(F.size("cuts") > 0).select("part", "length", "rank", "position", "cuts")
    cut = F.broadcast(cut) if plan.cuts <= broadcast_rows else cut.hint("merge")
    found = rows.join(cut, ["part", "length", "rank"]).withColumn("from", F.explode(F.concat(F.array("position"), "cuts")))
    to = F.coalesce(F.array_min(F.filter("cuts", lambda c: c > F.col("from"))), stop)
    found = found.withColumn("to", to).withColumn("skip", F.col("from") - F.col("position"))
    ids = F.substring("ids", (F.col("skip") * 4 + 1).cast("int"), ((F.col("to") - F.col("from")) * 4).cast("int"))
    found = found.select("id", (F.col("start") + F.col("skip")).alias("start"), (F.col("to") - F.col("from")).alias("length"), "doc_tokens", value(ids).alias("value"), spot(F.col("from")).alias("spot"))
    return uncut.unionByName(found.select(*out))
