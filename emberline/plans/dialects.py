"""SQL fragments that Spark and DuckDB write differently, so that one query text serves both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.exact_quantile import upper_median
from emberline.operators.tables import kept_table


@dataclass
class Ranked:
    """Rows to be numbered from 1 in one order over the whole table, with running sums."""

    select: str
    order: str
    rank: str
    sums: dict[str, str]


@dataclass
class Medians:
    """The upper median of a value by group."""

    select: str
    group: str
    value: str


class Spark:
    name = "spark"

    def __init__(self) -> None:
        self.ahead: dict[str, Ranked | Medians] = {}

    def medians(self, alias: str, select: str, group: str, value: str) -> str:
        """A table expression `alias` (group, n, median): of n values in ascending order the one at n // 2, from 0. Groups of any size: Spark narrows ranges ahead."""
        self.ahead[alias] = Medians(select, group, value)
        return f"{alias} as (select * from {{{alias}}})"

    def ranked(self, alias: str, select: str, order: str, rank: str = "r", **sums: str) -> str:
        """A table expression `alias`: rows of select with their place in `order` and, by name, running sums that include their own row.

        One window over a whole table would be one task, so Spark numbers the rows ahead, range by range.
        """
        self.ahead[alias] = Ranked(select, order, rank, sums)
        return f"{alias} as (select * from {{{alias}}})"

    def t(self, table: str) -> str:
        return "{" + table + "}"

    def unit(self, key: str) -> str:
        """The first 15 hex digits of sha1 as a number from 0 to 1."""
        return f"(cast(conv(substring(sha1({key}), 1, 15), 16, 10) as bigint) / 1152921504606846976.0D)"

    def draw(self, key: str, n: str) -> str:
        return f"(cast(conv(substring(sha1({key}), 1, 15), 16, 10) as bigint) % {n})"

    def array(self, value: str, order: str, names: str = "") -> str:
        """Values in the order of `order`."""
        return f"transform(array_sort(collect_list(named_struct('o', {order}, 'v', {value}))), s -> s.v)"

    def rows(self, array: str, pos: str, value: str) -> str:
        """lateral view text: an array's elements with their place from 0."""
        return f"lateral view posexplode({array}) _x as {pos}, {value}"

    def series(self, n: int, name: str) -> str:
        return f"(select cast(id as int) {name} from range({n})) as _{name}"

    def fold(self, array: str, init: dict[str, str], step: Callable[[str, str], dict[str, str]]) -> str:
        start = ", ".join(f"'{k}', {v}" for k, v in init.items())
        body = ", ".join(f"'{k}', {v}" for k, v in step("a", "x").items())
        return f"aggregate({array}, named_struct({start}), (a, x) -> named_struct({body}))"

    def struct(self, **values: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"

    def words(self, text: str) -> str:
        return f"filter(split({text}, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')"

    def map_(self, array: str, var: str, body: str) -> str:
        return f"transform({array}, {var} -> {body})"

    def keep(self, array: str, var: str, body: str) -> str:
        return f"filter({array}, {var} -> {body})"

    def size(self, array: str) -> str:
        return f"size({array})"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_join({array}, '{sep}')"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{to}')"

    def top(self, array: str) -> str:
        return f"array_max({array})"

    def at(self, array: str, pos: str) -> str:
        """The element at a place from 0."""
        return f"{array}[{pos}]"

    def places(self, array: str) -> str:
        """0 to size - 1 of an array that is not empty."""
        return f"sequence(0, size({array}) - 1)"

    def cat(self, *arrays: str) -> str:
        return f"concat({', '.join(arrays)})"

    def one(self, value: str) -> str:
        """An array of one element."""
        return f"array({value})"

    def bytes_of(self, text: str) -> str:
        """The UTF-8 bytes of a text as two hexadecimal digits each."""
        return f"regexp_extract_all(hex({text}), '(..)', 1)"

    def number(self, digits: str) -> str:
        return f"cast(conv({digits}, 16, 10) as int)"

    def text_of(self, digits: str) -> str:
        """The text whose UTF-8 bytes are these hexadecimal digits."""
        return f"decode(unhex({digits}), 'utf-8')"

    def fail(self, message: str) -> str:
        return f"raise_error({message})"


class Duck(Spark):
    name = "duckdb"

    def ranked(self, alias: str, select: str, order: str, rank: str = "r", **sums: str) -> str:
        more = "".join(f", sum({x}) over (order by {order} rows unbounded preceding) as {name}" for name, x in sums.items())
        return f"{alias} as (select *, row_number() over (order by {order}) as {rank}{more} from ({select}) x)"

    def medians(self, alias: str, select: str, group: str, value: str) -> str:
        placed = f"select {group}, {value}, row_number() over (partition by {group} order by {value}) - 1 as i, count({value}) over (partition by {group}) as n from ({select}) x where {value} is not null"
        return f"{alias} as (select {group}, n, {value} as median from ({placed}) y where i = n // 2)"

    def t(self, table: str) -> str:
        return table

    def unit(self, key: str) -> str:
        return f"(('0x' || substr(sha1({key}), 1, 15))::bigint / 1152921504606846976.0::double)"

    def draw(self, key: str, n: str) -> str:
        return f"(('0x' || substr(sha1({key}), 1, 15))::bigint % {n})"

    def array(self, value: str, order: str, names: str = "") -> str:
        return f"list({value} order by {order})"

    def series(self, n: int, name: str) -> str:
        return f"(select cast(range as int) {name} from range({n})) as _{name}"

    def fold(self, array: str, init: dict[str, str], step: Callable[[str, str], dict[str, str]]) -> str:
        start = ", ".join(f"'{k}': {v}" for k, v in init.items())
        body = ", ".join(f"'{k}': {v}" for k, v in step("a", "x").items())
        return f"list_reduce({array}, lambda a, x: {{{body}}}, {{{start}}})"

    def struct(self, **values: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"

    def words(self, text: str) -> str:
        return f"list_filter(string_split_regex({text}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"

    def map_(self, array: str, var: str, body: str) -> str:
        return f"list_transform({array}, lambda {var}: {body})"

    def keep(self, array: str, var: str, body: str) -> str:
        return f"list_filter({array}, lambda {var}: {body})"

    def size(self, array: str) -> str:
        return f"cast(len({array}) as int)"

    def distinct(self, array: str) -> str:
        return f"list_distinct({array})"

    def join(self, array: str, sep: str) -> str:
        return f"array_to_string({array}, '{sep}')"

    def sub(self, text: str, pattern: str, to: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"

    def top(self, array: str) -> str:
        return f"list_max({array})"

    def at(self, array: str, pos: str) -> str:
        return f"{array}[{pos} + 1]"

    def places(self, array: str) -> str:
        return f"range(0, len({array}))"

    def cat(self, *arrays: str) -> str:
        return "(" + " || ".join(arrays) + ")"

    def one(self, value: str) -> str:
        return f"[{value}]"

    def bytes_of(self, text: str) -> str:
        return f"regexp_extract_all(hex({text}), '..')"

    def number(self, digits: str) -> str:
        return f"cast('0x' || {digits} as int)"

    def text_of(self, digits: str) -> str:
        return f"decode(unhex({digits}))"

    def fail(self, message: str) -> str:
        return f"error({message})"


def numbered(df: DataFrame, r: Ranked) -> DataFrame:
    """df with its rows' places and running sums: dealt by ranges of the order, which are written once, numbered each by itself, and moved on by what the ranges before it hold."""
    spark = df.sparkSession
    order = [F.expr(x) for x in r.order.split(", ")]
    dealt = kept_table(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count("*").alias("n"), *(F.sum(F.expr(x)).cast("double").alias(name) for name, x in r.sums.items())).orderBy("_range").collect()
    names, before, rows = ["n", *r.sums], dict.fromkeys(["n", *r.sums], 0.0), []
    for t in totals:  # a row for each range, however many rows there are
        rows.append((t["_range"], *before.values()))
        before = {n: before[n] + (t[n] or 0) for n in names}
    offsets = spark.createDataFrame(rows, "_range int, " + ", ".join(f"_{n} double" for n in names))
    own = Window.partitionBy("_range").orderBy(*order)
    running = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = dealt.withColumns({r.rank: F.row_number().over(own), **{n: F.sum(F.expr(x)).over(running) for n, x in r.sums.items()}}).join(F.broadcast(offsets), "_range")
    return told.withColumns({c: (F.col(c) + F.col(f"_{n}")).cast("long") for c, n in ((r.rank, "n"), *((n, n) for n in r.sums))}).drop("_range", *(f"_{n}" for n in names))


@dataclass
class Catalogue:
    """Named queries with the tables that each reads."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, tables: str, text: Callable[[Spark], str]) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()}
            d = Spark()
            whole = text(d)
            for alias, r in d.ahead.items():
                of = spark.sql(r.select, **frames)
                frames[alias] = upper_median(of, r.group, r.value) if isinstance(r, Medians) else numbered(of, r)
            return spark.sql(whole, **frames)

        self.queries[name] = run
        self.sql[name] = text(Duck())
