"""The library's folds as SQL functions, so that plain SQL and views can call them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

STEPS = "array<struct<step: int, kind: string, status: string, ratio: double>>"
#: name: (parameters, result, body)
SCALARS: dict[str, tuple[str, str, str]] = {
    "speedup": ("best_ratio double", "double", "1 / greatest(best_ratio, 1e-9D)"),
    "truncated_best": (
        f"steps {STEPS}, budget int",
        "struct<best: double, used: int>",
        """aggregate(steps, named_struct('best', 1D, 'used', 0, 'done', false),
          (a, x) -> named_struct(
            'best', if(not a.done and x.kind <> 'stop' and a.used < budget and x.status = 'ok' and coalesce(x.ratio < 0.97D * a.best, false), x.ratio, a.best),
            'used', if(a.done or x.kind = 'stop' or a.used >= budget, a.used, a.used + 1),
            'done', a.done or x.kind = 'stop' or a.used >= budget),
          a -> named_struct('best', a.best, 'used', a.used))""",
    ),
    "reward": (
        "best_ratio double, n_edits int, n_invalid int",
        "double",
        "least(greatest(ln(1 / greatest(best_ratio, 1e-9D)), -4D), 4D) - 0.01D * n_edits - 0.05D * n_invalid",
    ),
    "canonical_key": ("seed string, chain string", "string", "substring(sha1(concat(seed, '\\n---\\n', chain)), 1, 16)"),
    "p_reach": (
        "n int, c int, k int",
        "double",
        "if(n < k, double('NaN'), 1 - aggregate(sequence(0, greatest(k, 1) - 1), 1D, (p, j) -> if(j < k, p * greatest(n - c - j, 0) / greatest(n - j, 1), p)))",
    ),
}


class Numbered:
    """TABLE rows with `k`, their number from 1 within what the call partitions by, in the order of the named column; the other columns stay as they are.

    select * from numbered(table(t) , group => 'task_id', by => 'ts'): analyze() takes the columns from the table, whatever they are, and asks for the partitioning and order.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, group: AnalyzeArgument, by: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or group.value not in rows.dataType.names or by.value not in rows.dataType.names:
            raise ValueError("numbered(table, group, by): group and by must name columns of the table")
        schema = StructType([*rows.dataType.fields]).add("k", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(group.value)], orderBy=[OrderingColumn(by.value)])

    def __init__(self) -> None:
        self.n = 0

    def eval(self, rows, group: str, by: str) -> Iterator[tuple]:
        self.n += 1
        yield (*rows, self.n)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
    spark.udtf.register("numbered", udtf(Numbered))
    return [*SCALARS, "numbered"]
