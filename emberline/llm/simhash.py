"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

A fingerprint has a bit set if it is set in over half of the text's shingle hashes. It is one word of 64 bits, or several, each of
hashes of its own. Fingerprints link if they differ in at most `radius` bits. Equal fingerprints are one class from the start.

To find links between classes the bits of each word are grouped into partitions, correlated bits together; partition i gets a
threshold t_i >= -1 with sum(t_i + 1) = radius + 1, so two fingerprints that differ in at most `radius` bits differ in at most t_i
bits of some partition i. Dynamic programming picks the thresholds of the smallest estimated cost: probes, plus candidates estimated from
the counts of values (their XOR correlation) at the number of classes there is; the cut into partitions is chosen so, too, and gets wider as
rows grow. A probe leaves t_i bits of the partition out. Every class is probed under each, each group of one value is verified
on whole fingerprints, and only a spanning forest of its links is emitted. Groups above GROUP_ROWS are cut into blocks, and each pair of
blocks is a group of its own, so none is dropped or collected whole.

likely_probes() is the same for links that need not all be found by one partition's pigeonhole but with a stated probability: the
near copies of emberline/llm/near.py, which verifies its candidates by whole shingle sets.

Results in special cases: a null or wordless text has fingerprint zero, linked like any other; repeated rows and rows
that share an id are one node; rows with a null id get a fingerprint, link nothing and have a null component; an empty
table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches, written
from emberline.llm.components import components

SEED = 42
#: Members of a group that one task verifies together.
GROUP_ROWS = 20_000
#: Cost of emitting a probe, in verified candidate pairs.
PROBE_COST = 50.0
#: Bits of the groups whose values are counted; partitions are made of whole groups.
BLOCK_BITS = 8
#: Probes that one partition may take.
MOST_PROBES = 200


def shingles(text: str | None, width: int) -> list[bytes]:
    """Shingles of `width` words, repeats included: A-Z lower-cased, words split at x20 and x09-x0D; fewer words: all in one."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [joined[a : b - 1] for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: str | None, width: int = 3, words: int = 1) -> np.ndarray:
    found = shingles(text, width)
    if not found:
        return np.zeros(words, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in found], dtype="<u8")
    out = np.zeros(words, np.uint64)
    for k in range(words):
        own = h if not k else mixed(h, k)
        out[k] = bits_of(own)
    return out


def bits_of(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have set."""
    return int(np.packbits(ones_of(hashes) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255):  # sums of so few fit into a byte
        ones += np.add.reduce(np.unpackbits(hashes[i : i + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return ones


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of word k: those of word 0, mixed again."""
    h = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_columns(words: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words))]


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long, fp1 long, ...: the bits of the fingerprint's words) of every row."""
    small_batches(docs.sparkSession)
    names = word_columns(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(words))], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("id", id_col)


def correlation(classes: DataFrame, names: list[str]) -> list[np.ndarray]:
    """|correlation| of the 64 bits of each word over all fingerprints; only 65 x 65 sums a word reach the driver."""
    size = 65 * 65

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 65, 65))
        for batch in batches:
            for k, column in enumerate(batch.columns):
                fps = column.to_numpy()
                for i in range(0, len(fps), 4096):
                    bits = np.unpackbits(np.ascontiguousarray(fps[i : i + 4096]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    bits = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
                    total[k] += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names) * size)), pa.array(total.ravel())], names=["at", "n"])

    sums = np.zeros(len(names) * size)
    for r in classes.select(*names).mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        sums[r["at"]] = r["n"]
    out = []
    for s in sums.reshape(len(names), 65, 65):
        n = max(s[64, 64], 1.0)
        mean = s[64, :64] / n
        cov = s[:64, :64] / n - np.outer(mean, mean)
        dev = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        out.append(np.abs(cov / np.outer(dev, dev)))
    return out


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` partitions: each starts with the most correlated free pair and takes the free bit closest to its own."""
    free, out = set(range(len(corr))), []
    for p in range(parts):
        width = math.ceil(len(free) / (parts - p))
        if width == len(free):
            out.append(sorted(free))
            break
        a, b = max(combinations(sorted(free), 2), key=lambda ab: corr[ab])
        own = [a, b]
        while len(own) < width:
            own.append(max(sorted(free - {*own}), key=lambda c: corr[c, own].mean()))
        free -= {*own}
        out.append(sorted(own))
    return out


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit number."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def distances(rows: DataFrame, groups: list[tuple[str, list[int]]]) -> tuple[list[np.ndarray], int]:
    """(for each group of at most BLOCK_BITS bits: the share of all ordered pairs of rows that differ in d of its bits, for d = 0, 1, ...; rows).

    From the counts of each group's values, by their XOR correlation. Tasks sum counts before they are shuffled; len(groups) x
    2 ** BLOCK_BITS sums reach the driver at most.
    """
    size = 1 << BLOCK_BITS
    if any(len(g) > BLOCK_BITS for _, g in groups):
        raise ValueError(f"a group has more than {BLOCK_BITS} bits")
    names = list(dict.fromkeys(name for name, _ in groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), size), np.int64)
        for batch in batches:
            fps = [c.to_numpy().view(np.uint64) for c in batch.columns]
            for i, (name, bits) in enumerate(groups):
                value = np.zeros(batch.num_rows, np.uint64)
                for k, b in enumerate(bits):
                    value |= (fps[names.index(name)] >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
                total[i] += np.bincount(value.astype(np.int64), minlength=size)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    counts = np.zeros(len(groups) * size)
    for r in rows.select(*names).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["at"]] = r["n"]
    out, n = [], 0
    for x, (_, bits) in zip(counts.reshape(len(groups), size), groups, strict=True):
        n = int(x.sum())
        both = np.maximum(_hadamard(_hadamard(x[: 1 << len(bits)]) ** 2), 0)
        weight = np.bitwise_count(np.arange(len(both), dtype=np.uint64))
        out.append(np.bincount(weight, both, len(bits) + 1) / max(both.sum(), 1e-300))
    return out, n


def _hadamard(v: np.ndarray) -> np.ndarray:
    h = 1
    while h < len(v):
        v = v.reshape(-1, 2, h)
        v = np.stack([v[:, 0] + v[:, 1], v[:, 0] - v[:, 1]], axis=1).ravel()
        h *= 2
    return v


def cost(share: np.ndarray, n: float, t: int) -> float:
    """Estimated cost of a partition probed to threshold t, in verified pairs. share: of pairs by their differing bits there.

    A probe leaves t bits out; a pair that differs in d <= t bits meets under each choice of the t bits that holds those d.
    """
    if t < 0:
        return 0.0
    width = len(share) - 1
    if t > width or math.comb(width, t) > MOST_PROBES:
        return math.inf
    return n * n * sum(float(share[d]) * math.comb(width - d, t - d) for d in range(t + 1)) + PROBE_COST * n * math.comb(width, t)


def thresholds(shares: list[np.ndarray], n: float, radius: int) -> tuple[float, list[int]]:
    """(estimated cost, t_i >= -1 with sum(t_i + 1) = radius + 1) of the smallest cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for share in shares:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t in range(-1, radius - spent + 1):
                new = c + cost(share, n, t)
                if math.isfinite(new) and ((k := spent + t + 1) not in after or new < after[k][0]):
                    after[k] = (new, [*ts, t])
        best = after
    return best.get(radius + 1, (math.inf, []))


def likely(shares: list[np.ndarray], n: float, rate: float, miss: float) -> list[int]:
    """t_i >= -1 of the smallest estimated cost so that two fingerprints whose bits differ with probability `rate`, each by itself, agree to t_i bits in some partition i but for a probability of `miss`; by dynamic programming."""
    units = 400
    need = -math.log(miss)

    def gain(width: int, t: int) -> int:
        found = sum(math.comb(width, d) * rate**d * (1 - rate) ** (width - d) for d in range(t + 1))
        return math.floor(-math.log1p(-found) / need * units) if found < 1 else units

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for share in shares:
        after: dict[int, tuple[float, list[int]]] = {}
        for got, (c, ts) in best.items():
            for t in range(-1, 3):
                new = c + cost(share, n, t)
                if math.isfinite(new) and ((k := min(units, got + (gain(len(share) - 1, t) if t >= 0 else 0))) not in after or new < after[k][0]):
                    after[k] = (new, [*ts, t])
        best = after
    if units not in best:
        raise ValueError("fingerprints of so few words can't reach this probability: take more")
    return best[units][1]


def merged(shares: list[np.ndarray]) -> np.ndarray:
    """The share of pairs by differing bits of several groups together, as if they were independent."""
    out = np.ones(1)
    for s in shares:
        out = np.convolve(out, s)
    return out


def exact_probes(classes: DataFrame, names: list[str], radius: int) -> list[tuple[str, int]]:
    """(word, mask) of the probes: fingerprints that differ in at most `radius` bits are equal under some mask.

    The bits of each word fall into groups of BLOCK_BITS correlated bits; every cut of a word's groups into partitions is tried, and that
    of the smallest estimated cost at this number of rows is taken: few narrow partitions for few rows, wider ones with more probes for
    many. Of several words, each takes its part of the radius.
    """
    groups = [(name, g) for name, c in zip(names, correlation(classes, names), strict=True) for g in grouped_bits(c, 64 // BLOCK_BITS)]
    shares, n = distances(classes, groups)
    each = 64 // BLOCK_BITS
    out = []
    for w, name in enumerate(names):
        own = radius // len(names) if w else radius - radius // len(names) * (len(names) - 1)
        if w and own == radius // len(names):
            own -= 1  # sum(own + 1) = radius + 1
        if own < 0:
            continue
        best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
        for cuts in range(1 << each - 1):
            runs, last = [], 0
            for k in range(1, each + 1):
                if k == each or cuts >> k - 1 & 1:
                    runs.append(range(w * each + last, w * each + k))
                    last = k
            c, ts = thresholds([merged([shares[i] for i in run]) for run in runs], max(n, 1), own)
            if c < best[0]:
                best = (c, [(sorted(b for i in run for b in groups[i][1]), t) for run, t in zip(runs, ts, strict=True)])
        if not best[1]:
            raise ValueError("the radius takes more probes than there may be")
        out += [(name, mask) for bits, t in best[1] for mask in masks(bits, t)]
    return out


def likely_probes(classes: DataFrame, names: list[str], rate: float, miss: float) -> list[tuple[str, int]]:
    """(word, mask) of the probes: fingerprints whose bits differ with probability `rate` are equal under some mask but for a probability of `miss`."""
    groups = [(name, g) for name, c in zip(names, correlation(classes, names), strict=True) for g in grouped_bits(c, 64 // BLOCK_BITS)]
    shares, n = distances(classes, groups)
    pairs = [(name, g + h, merged([s, t])) for (name, g), (_, h), s, t in zip(groups[::2], groups[1::2], shares[::2], shares[1::2], strict=True)]
    ts = likely([s for _, _, s in pairs], max(n, 1), rate, miss)
    return [(name, mask) for (name, bits, _), t in zip(pairs, ts, strict=True) for mask in masks(sorted(bits), t)]


def masks(bits: list[int], t: int) -> list[int]:
    """Masks of these bits without t of them, for every choice of the t; none for t < 0."""
    return [mask_of([b for b in bits if b not in left]) for left in combinations(bits, t)] if t >= 0 else []


def forest(group: np.ndarray, fps: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within each group; group numbers are sorted."""
    a: list[int] = []
    b: list[int] = []
    cuts = np.flatnonzero(np.diff(group)) + 1
    starts, ends = np.array([0, *cuts]), np.array([*cuts, len(group)])
    sizes = ends - starts
    small = np.repeat(sizes <= 32, sizes)
    top = int(sizes[sizes <= 32].max(initial=1))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    for d in range(1, top):
        at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]).sum(axis=1, dtype=np.int64) <= radius]
        for x, y in zip(nodes[at].tolist(), nodes[at + d].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:  # a forest over the whole task: its groups may share nodes
                root[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
    for s, e in zip(starts[sizes > 32].tolist(), ends[sizes > 32].tolist(), strict=True):
        rest, rest_nodes = np.ascontiguousarray(fps[s:e].T), nodes[s:e]
        queue: list[tuple[np.ndarray, int]] = []
        while len(rest_nodes):
            if not queue:
                queue.append((rest[:, 0], int(rest_nodes[0])))
                rest, rest_nodes = rest[:, 1:], rest_nodes[1:]
                continue
            f, x = queue.pop()
            at = _within(rest, f, radius)
            if len(at):
                found = rest_nodes[at].tolist()
                a += [x] * len(found)
                b += found
                queue += zip(rest[:, at].T, found, strict=True)
                stay = np.ones(len(rest_nodes), bool)
                stay[at] = False
                rest, rest_nodes = rest[:, stay], rest_nodes[stay]
    return a, b


def _within(words: np.ndarray, f: np.ndarray, radius: int) -> np.ndarray:
    """The places of fingerprints (a row of words for each word) that differ from f in at most radius bits; most fall out by their first words."""
    first = min(3, len(f))
    d = np.bitwise_count(words[0] ^ f[0])
    for k in range(1, first):
        d = d + np.bitwise_count(words[k] ^ f[k])
    at = np.flatnonzero(d <= radius)
    if first < len(f) and len(at):
        more = d[at].astype(np.int64)
        for k in range(first, len(f)):
            more += np.bitwise_count(words[k][at] ^ f[k])
        at = at[more <= radius]
    return at


def links(classes: DataFrame, radius: int, probes: list[tuple[str, int]], carried: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a long, b long): links between classes (node long, fp long, fp1 ...) that are equal under one of the probes (word, mask) and differ in at most `radius` bits of the first `carried` words; only a spanning forest of each task's links."""
    names = [c for c in classes.columns if c != "node"]
    key = F.array(*(F.struct(F.lit(i).alias("part"), F.col(name).bitwiseAND(F.lit(mask).cast("long")).alias("key")) for i, (name, mask) in enumerate(probes)))
    names = names[:carried]
    keyed = classes.select(F.inline(key), *names, "node")
    sizes = keyed.groupBy("part", "key").count().where(F.col("count") > group_rows)
    sizes = written(sizes.select("part", "key", F.ceil(F.col("count") / group_rows).cast("int").alias("blocks")))
    if sizes.isEmpty():
        keyed = keyed.withColumn("pair", F.lit(0))
    else:
        cut = keyed.join(sizes, ["part", "key"], "left")
        own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
        other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.least(own, c) * F.col("blocks") + F.greatest(own, c) + 1))
        keyed = cut.select("part", "key", *names, "node", F.explode(other).alias("pair"))
    dealt = keyed.repartition(F.xxhash64("part", "key", "pair")).sortWithinPartitions("part", "key", "pair").select("part", "key", "pair", "node", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def out(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            cols = [np.concatenate([r[k] for r in rows]) for k in range(4 + len(names))]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            a, b = forest(np.cumsum(new), np.stack(cols[4:], axis=1).view(np.uint64), cols[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            # the last group may go on in the next batch
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield out([*kept, tuple(c[:cut] for c in cols)])
                kept = []
            elif kept and any(kept[-1][k][-1] != cols[k][0] for k in range(3)):
                yield out(kept)
                kept = []
            kept.append(tuple(c[cut:].copy() for c in cols))
        if kept:
            yield out(kept)

    return dealt.mapInArrow(run, "a long, b long")


def clustered(prints: DataFrame, radius: int = 3, id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, fp, fp1 ..., component) of every row of fingerprints(), which should be a written table as it is read several times."""
    names = [c for c in prints.columns if c != id_col]
    classes = written(prints.where(F.col(id_col).isNotNull()).groupBy(*names).agg(F.min(id_col).cast("long").alias("node")))
    found = components(links(classes, radius, exact_probes(classes, names, radius), group_rows=group_rows))
    labelled = classes.join(found, "node", "left").select(*names, F.coalesce("component", "node").alias("component"))
    out = prints.join(labelled, names, "left")
    return out.select(id_col, *names, F.when(F.col(id_col).isNotNull(), F.col("component")).alias("component"))
