"""Running a function over whole texts, batch by batch, with the rows' other columns carried beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import bounded_batches


def map_texts(docs: DataFrame, text_col: str, carry: Sequence[str], make: Callable[[], Callable[[pa.Array], Sequence[pa.Array]]], fields: str) -> DataFrame:
    """row (a struct of the `carry` columns, so that no name can clash) and `fields`, one output row for each row of docs.

    make() is called once in each task; what it returns gets a batch's texts and gives an array for each field."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    made = T._parse_datatype_string(fields)
    schema = T.StructType([own.schema["row"], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *of(batch.column(1))], names=schema.names)

    return own.mapInArrow(run, schema)
