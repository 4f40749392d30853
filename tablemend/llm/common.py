"""Tables, stored intermediate results and batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from tablemend.session import stored  # noqa: F401  a name of this module too


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_fields(df: DataFrame, fields: Sequence[StructField]) -> StructType:
    """The schema of ``df`` with ``fields`` at its end; columns of the same names are replaced."""
    names = {f.name for f in fields}
    return StructType([*(f for f in df.schema.fields if f.name not in names), *fields])


def text_slices(
    batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 2 << 20
) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of Arrow batches of about ``most_bytes`` of text at most (a longer text is alone), with the texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most_bytes:
                yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, total = i, 0
            total += int(n)
        yield batch.slice(start), texts.slice(start).to_pylist()


def extended(batch: pa.RecordBatch, schema: pa.Schema, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with new columns, in the order of ``schema``."""
    columns = [
        new[f.name] if f.name in new else batch.column(batch.schema.get_field_index(f.name)).cast(f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


#: A to Z to lower case; every other ASCII byte but letters and digits becomes a space. Bytes beyond ASCII stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, ASCII digits and characters beyond ASCII, as UTF-8; only A to Z are lower-cased."""
    return (text or "").encode().translate(_PLAIN).split()
