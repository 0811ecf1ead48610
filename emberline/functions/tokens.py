"""Token ids of texts: UTF-8 bytes as built-in expressions, or any tokenizer in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Ids of byte tokens: three special ones, then the bytes.
PAD, BEGIN, END, FIRST_BYTE = 0, 1, 2, 3
SHOWN = {PAD: "<pad>", BEGIN: "<bos>", END: "<eos>"}


def byte_ids(text: str, begin: bool = False, end: bool = False) -> Column:
    """A text column's UTF-8 bytes as ids, with begin and end tokens as asked; null for null."""
    ids = F.expr(f"transform(regexp_extract_all(hex(`{text}`), '(..)', 1), h -> cast(conv(h, 16, 10) as int) + {FIRST_BYTE})")
    parts = ([F.array(F.lit(BEGIN))] if begin else []) + [ids] + ([F.array(F.lit(END))] if end else [])
    return F.concat(*parts)


def byte_text(ids: str) -> Column:
    """The text of an array of byte tokens; special ones show as their names, other ids below 0 or above the bytes give nothing."""
    special = " ".join(f"when {i} then '{name.encode().hex()}'" for i, name in SHOWN.items())
    digits = f"array_join(transform(`{ids}`, i -> case i {special} else if(i between {FIRST_BYTE} and {FIRST_BYTE + 255}, lpad(hex(i - {FIRST_BYTE}), 2, '0'), '') end), '')"
    return F.expr(f"decode(unhex({digits}), 'utf-8')")


def encoded_by(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[int]]]], ids: str = "ids", begin: int | None = None, end: int | None = None) -> DataFrame:
    """df with a column of token ids, by the batch function that make() gives once in each task; null texts have null ids.

    A column of that name is replaced. Batches are those of Arrow, at most spark.sql.execution.arrow.maxBytesPerBatch bytes each.
    """
    kept = [c for c in df.columns if c != ids]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    head, tail = [] if begin is None else [begin], [] if end is None else [end]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            found = iter(encode([t for t in texts if t is not None]))
            told = pa.array([None if t is None else [*head, *next(found), *tail] for t in texts], arrow.field(ids).type)
            yield pa.RecordBatch.from_arrays([*batch.columns, told], schema=arrow)

    return df.select(*kept).mapInArrow(rows, schema)
