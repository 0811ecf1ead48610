"""BPE encoding and decoding with a vocabulary file of the tokenizers library.

Each word is a doubly linked list of symbols; a priority queue holds the ranks of the merges that adjacent
symbols allow, and entries whose symbols have since changed are skipped when they come up. Decoding
concatenates vocabulary strings.

Supported files: model BPE without dropout, unknown token or byte fallback, over a ByteLevel alphabet, with the
normalizers NFC, Replace of white space and Lowercase, and a Split or ByteLevel pre-tokenizer. Anything else
raises ValueError rather than giving other ids.

Results in special cases: a null text counts as empty and gives no ids and an empty decoded text; repeated rows
each give a row; an empty table gives an empty one; columns other than the two named are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import small_batches

#: Unicode White_Space, as the tokenizers library's expressions read \s.
SPACE = "\t-\r \x85\xa0  -     　"
#: What str.split() takes for white space beyond that.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
#: Words kept with their encoding by each Python worker.
CACHE_WORDS = 400_000


#: From here on the library's tables and those of the regex module may be of different Unicode versions.
NEWER = regex.compile("[\u0530-\U0010ffff]")


def by_library(pattern: str) -> regex.Pattern:
    """The pattern with \\p{L} and \\p{N} as the tokenizers library's own tables have them."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name in ("\\p{L}", "\\p{N}"):
        runs = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
        ranges = "".join(f"{regex.escape(x[0])}-{regex.escape(x[-1])}" for run, _ in runs for x in regex.findall("[\0-\ud7ff]+|[\ue000-\U0010ffff]+", run))
        pattern = pattern.replace(f"[{name}]", f"[{ranges}]").replace(name, ranges)
    return regex.compile(pattern)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class Bpe:
    """One vocabulary file: encode() gives ids, tokens() and decode() give strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # symbols are ids; a pair is the number left << 20 | right
        self.left = [self.vocab[a] for a, _ in pairs]
        self.right = [self.vocab[b] for _, b in pairs]
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.rank = {a << 20 | b: r for r, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for x in spec["added_tokens"]:
            if x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]:
                raise ValueError(f"added token {x['content']} has options that aren't supported")
        self.strings = {i: s for s, i in chain(self.vocab.items(), self.special.items())}
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        kinds = [n["type"] for n in (spec["normalizer"] or {"normalizers": []})["normalizers"]] if spec["normalizer"] is None or "normalizers" in spec["normalizer"] else [spec["normalizer"]["type"]]
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"normalizers {kinds} aren't supported")
        self.folds = bool(kinds)
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and self.folds:
            self.pattern = regex.compile(steps[0]["pattern"]["Regex"].replace("^\\s", f"^{SPACE}"))
            self.exact = None
            self.by_space = True  # no match spans white space
        elif [s["type"] for s in steps] == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]:
            s = f"[{SPACE}]"
            self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|{s}+(?!(?!{s})\X|(?!{s})[\s\S])|{s}+")
            self.by_space = False
        else:
            raise ValueError("this pre-tokenizer isn't supported")
        self.bytes = byte_alphabet()
        self.back = {c: b for b, c in enumerate(self.bytes)}
        self.first = [self.vocab[c] for c in self.bytes]
        self.last = [self.vocab[c + self.end] for c in self.bytes]
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token: merges by rank, leftmost first among equals."""
        data = word.encode("utf-8")
        ids = [self.first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n == 1:
            return (ids[0],)
        rank, left, right, merged = self.rank, self.left, self.right, self.merged
        # an entry is rank << shift | place of the left symbol
        shift, i, queue = n.bit_length(), 0, []
        a = ids[0]
        for b in ids[1:]:
            if (r := rank.get(a << 20 | b)) is not None:
                queue.append(r << shift | i)
            a = b
            i += 1
        if not queue:
            return tuple(ids)
        heapify(queue)
        after, before, mask = [*range(1, n), 0], [*range(-1, n - 1)], (1 << shift) - 1
        while queue:
            e = heappop(queue)
            i, r = e & mask, e >> shift
            j = after[i]
            if ids[i] != left[r] or not j or ids[j] != right[r]:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = m, _ = merged[r], -1
            after[i] = k = after[j]
            if k:
                before[k] = i
                if (r := rank.get(m << 20 | ids[k])) is not None:
                    heappush(queue, r << shift | i)
            if (h := before[i]) >= 0 and (r := rank.get(ids[h] << 20 | m)) is not None:
                heappush(queue, r << shift | h)
        return tuple([x for x in ids if x >= 0])

    def chunk(self, text: str) -> tuple[int, ...]:
        out = []
        pattern = self.pattern
        if self.by_space and NEWER.search(text):
            pattern = self.exact = self.exact or by_library(pattern.pattern)
        for w in pattern.findall(text):
            if (ids := self.cache.get(w)) is None:
                ids = self.word(w)
                if len(w) < 64:
                    if len(self.cache) >= CACHE_WORDS:
                        self.cache.clear()
                    self.cache[w] = ids
            out.extend(ids)
        return tuple(out)

    def part(self, part: str) -> tuple[int, ...]:
        """The ids of a text without white space, for a pattern whose matches don't span it."""
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        if part.isascii() or not NEWER.search(part):
            if part.isalpha():
                ids = self.word(part)
                if len(part) < 64:
                    self.cache[part] = ids
                return ids
            if part[:-1].isalpha() and part[-1] in ".,":
                a, b = part[:-1], part[-1]
                ids = (self.cache.get(a) or self.part(a)) + (self.cache.get(b) or self.word(b))
                if len(part) < 64:
                    self.cache[part] = ids
                return ids
        ids = self.chunk(part)
        if len(part) < 64:
            self.cache[part] = ids
        return ids

    def fold(self, text: str) -> str:
        if not text.isascii():
            if NEWER.search(text):
                from tokenizers import normalizers

                return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone would choose the final sigma by context
        return text.lower()

    def plain(self, text: str) -> list[int]:
        """The ids of a text without special tokens."""
        if not self.by_space:
            return list(self.chunk(text))
        text = self.fold(text)
        out: list[int] = []
        cache = self.cache
        for part in filter(None, regex.split(f"[{SPACE}]+", text)) if ODD_SPACE.search(text) else text.split():
            ids = cache.get(part)
            if ids is None:
                ids = self.part(part)
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """As encode(text, add_special_tokens=False): the strings of special tokens in the text give their ids."""
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        """As decode(ids, skip_special_tokens=False): vocabulary strings, one after the other.

        With a ByteLevel decoder they are bytes and stand together; without a decoder one space stands between them.
        """
        strings = self.strings
        if not self.byte_level:
            return " ".join([strings[i] for i in ids])
        out = bytearray()
        for i in ids:
            s = strings[i]
            if all(c in self.back for c in s):
                out += bytes(self.back[c] for c in s)
            else:
                out += s.encode("utf-8")
        return out.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row; path is the vocabulary file, present on every machine."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = pa.array([0, *_sums(ids)], pa.int32())
            values = pa.array(list(chain.from_iterable(ids)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def _sums(lists: list[list[int]]) -> Iterator[int]:
    total = 0
    for x in lists:
        total += len(x)
        yield total
