"""A paged token store: the ids of all documents, one after the other, in pages of fixed width.

A page is a binary of PAGE ids of WIDTH bytes each, big-endian; `page` is its number. Pages are written range by range in order, with small row groups, so a
read of a few pages is pruned by the statistics of `page`. Where a document's ids begin follows from the ranges' totals, and no task
holds more than one page or one document. An index keeps (id, start, n) of each document.

Results in special cases: documents without ids, null ones included, are in the index alone; equal or null ids are documents of their own; an empty table gives a store without
pages, whose windows raise ValueError, as do windows not shorter than the store; the last page may be shorter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import tokens
from emberline.operators.tables import kept_folder
from emberline.plans.dialects import Ranked, numbered

#: Ids of a page, and bytes of an id.
PAGE, WIDTH = 1 << 14, 2
#: Bytes of a row group: some pages.
ROW_GROUP = 1 << 20


def packed(ids: Column) -> Column:
    """An array of ids as WIDTH bytes each."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.lpad(F.hex(i), 2 * WIDTH, "0")), ""))


def packed_bytes(text: Column) -> Column:
    """A text's byte tokens and their end token as two bytes each: bytes read as Latin characters, moved up, and written as UTF-16."""
    plain = "".join(map(chr, range(256)))
    moved = "".join(chr(b + tokens.FIRST_BYTE) for b in range(256))
    return F.encode(F.concat(F.translate(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), plain, moved), F.lit(chr(tokens.END))), "UTF-16BE")


@dataclass
class TokenStore:
    """pages: (page long, ids binary); index: (id, start, n long); total: ids of all documents."""

    pages: DataFrame
    index: DataFrame
    total: int

    def windows(self, starts: list[int], length: int) -> DataFrame:
        """(window int, start long, ids binary) of `length` ids from each start; only the pages that hold them are read."""
        if self.total <= length or any(not 0 <= s <= self.total - length for s in starts):
            raise ValueError("a window must lie within the store, which must be longer")
        spark = self.pages.sparkSession
        needed = sorted({p for s in starts for p in range(s // PAGE, (s + length - 1) // PAGE + 1)})
        found = self.pages.where(F.col("page").isin(needed))
        wanted = spark.createDataFrame([(k, s, p) for k, s in enumerate(starts) for p in range(s // PAGE, (s + length - 1) // PAGE + 1)], "window int, start long, page long")
        first = F.greatest(F.col("start") - F.col("page") * PAGE, F.lit(0))
        last = F.least(F.col("start") + length - F.col("page") * PAGE, F.lit(PAGE))
        part = F.substring("ids", (first * WIDTH + 1).cast("int"), ((last - first) * WIDTH).cast("int"))
        parts = found.join(F.broadcast(wanted), "page").select("window", "start", F.struct("page", F.hex(part).alias("part")).alias("p"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "")
        return parts.groupBy("window", "start").agg(F.unhex(joined).alias("ids"))

    def drawn(self, n: int, length: int, seed: str) -> DataFrame:
        """n windows whose starts are drawn by hash, as `windows` gives them."""
        import hashlib

        room = self.total - length
        if room <= 0:
            raise ValueError("a window must lie within the store, which must be longer")
        return self.windows([int(hashlib.sha1(f"{seed}|{k}".encode()).hexdigest()[:15], 16) % room for k in range(n)], length)


def written(docs: DataFrame, ids: Column, order: str = "doc_id") -> TokenStore:
    """The store of docs in this order; ids is a binary of each document's ids, its end token included."""
    spark, path = docs.sparkSession, kept_folder(docs.sparkSession)
    # the documents themselves are dealt and kept, and their ids are made when pages are cut: they may be much larger
    n = F.coalesce((F.length(ids) / WIDTH).cast("long"), F.lit(0))
    own = docs.withColumns({"_order": F.col(order), "_tie": F.xxhash64(*docs.columns), "_size": n})
    placed = numbered(own, Ranked("", "_order, _tie", "_rank", {"_end": "_size"})).withColumn("_start", F.col("_end") - F.col("_size"))
    placed.select(F.col("_order").alias("id"), F.col("_start").alias("start"), F.col("_size").alias("n")).write.parquet(f"{path}/index")
    # a document's ids in each page that they touch; pages are dealt once, as their parts, by ranges that serve to put them together and to write them in order
    page = F.explode(F.sequence(F.floor(F.col("start") / PAGE), F.floor((F.col("start") + F.col("n") - 1) / PAGE)))
    cut = placed.where("_size > 0").select(F.col("_start").alias("start"), F.col("_size").alias("n"), ids.alias("ids")).withColumn("page", page)
    first = F.greatest(F.col("start"), F.col("page") * PAGE)
    size = F.least(F.col("start") + F.col("n"), (F.col("page") + 1) * PAGE) - first
    cut = cut.select("page", first.alias("at"), F.substring("ids", ((first - F.col("start")) * WIDTH + 1).cast("int"), (size * WIDTH).cast("int")).alias("part"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])
    pages = cut.repartitionByRange(ranges, "page").groupBy("page").agg(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), "")).alias("ids"))
    pages.sortWithinPartitions("page").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/pages")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> TokenStore:
    index = spark.read.parquet(f"{path}/index")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return TokenStore(spark.read.schema("page long, ids binary").parquet(f"{path}/pages"), index, total)
