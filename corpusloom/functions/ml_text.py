"""Text forms of model outputs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_line(word: str, vector: str) -> Column:
    numbers = F.transform(vector_to_array(vector), lambda x: F.round(x, 6).cast("string"))
    return F.concat_ws(" ", F.col(word), F.array_join(numbers, " "))
