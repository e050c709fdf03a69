"""Table functions for SQL and DataFrames.

    tables.register(spark)
    SELECT d.id, s.* FROM d, LATERAL segments(d.text, 'sentence') AS s
    SELECT * FROM filled(TABLE(marks) PARTITION BY file ORDER BY at)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType

from corpusloom.functions.text import SEGMENTS, spans

SEGMENT = StructType([StructField("segment_index", IntegerType()), StructField("text", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


class Segments:
    """segment_index, text, start, end (code points, end exclusive) of a text's segments by a strategy; none for null and blank texts."""

    @staticmethod
    def analyze(text: AnalyzeArgument, strategy: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType) or not isinstance(strategy.dataType, StringType):
            raise ValueError("segments needs a text and a strategy, both strings")
        if strategy.isConstantExpression and strategy.value not in {*SEGMENTS, "paragraph", "full_text"}:
            raise ValueError(f"no such strategy: {strategy.value}")
        return AnalyzeResult(SEGMENT)

    def eval(self, text: str | None, strategy: str | None) -> Iterator[tuple]:
        for n, (segment, start, end) in enumerate(spans(text, strategy)):
            yield n, segment, start, end


class Filled:
    """The rows of a table with each null as the last value before it in its partition (PARTITION BY, ORDER BY). A column whose name
    begins with "own_" stays as it is."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("filled needs a table")
        return AnalyzeResult(StructType([StructField(f.name, f.dataType) for f in table.dataType.fields]))

    def __init__(self) -> None:
        self.last: dict[str, object] = {}

    def eval(self, row: Row) -> Iterator[tuple]:
        held = row.asDict()
        for name, value in held.items():
            if value is not None:
                self.last[name] = value
        yield tuple(v if v is not None or re.match("own_", k) else self.last.get(k) for k, v in held.items())


segments = udtf(Segments, useArrow=True)
filled = udtf(Filled)


def register(spark: SparkSession) -> None:
    spark.udtf.register("segments", segments)
    spark.udtf.register("filled", filled)
