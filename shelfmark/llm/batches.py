"""Arrow batches through numpy and Python, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A function sees at most so many rows and, but for one longer text, so many bytes of text at once.
ROWS, BYTES = 1024, 1 << 19
#: Bytes of a batch that Spark sends to Python (a longer row goes alone). Spark's own 64 MB stand in the JVM and in Python at once.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of this session to BATCH_BYTES, unless it asks for less."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def release() -> None:
    """Give memory that is free back to the system: workers live on between tasks, and what a stage has needed would stay theirs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch | pa.Array, text: str | None = None, rows: int = ROWS, size: int = BYTES) -> Iterator:
    """Pieces of a batch (by its column text) or of an array of texts, in order, within the bounds above."""
    column = batch if text is None else batch.column(batch.schema.get_field_index(text))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = held = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(lengths) > at:
        yield batch.slice(at)


def text_filter(docs: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows of docs, all columns, for whose text the function that make() gives in a worker says true.

    Only the text goes to Python, once, and only booleans come back.
    """
    bound_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for batch in batches:
            parts = [apply(piece) for piece in slices(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())
        apply = None
        release()

    return docs.where(F.arrow_udf(keep, "boolean")(F.col(f"`{text}`").cast("string")))


def map_texts(docs: DataFrame, key: str, text: str, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], schema: str, also: dict | None = None) -> DataFrame:
    """(key, *also, *schema) for each row of docs; make() gives, in a worker, what maps a text column to the columns of schema.

    Only key, text and the `also` columns (name to Column) are read, under names of our own, so further
    columns, whatever their names, don't matter. Key and `also` pass through unchanged.
    """
    also = also or {}
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"), *[c.alias(f"_also_{n}") for n, c in also.items()])
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [T.StructField("_key", source.schema["_key"].dataType), *[T.StructField(f"_also_{n}", source.schema[f"_also_{n}"].dataType) for n in also]]
    out = T.StructType(kept + list(fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        apply = make()
        for batch in batches:
            for piece in slices(batch, "_text"):
                columns = [piece.column(piece.schema.get_field_index(f.name)) for f in kept]
                columns += apply(piece.column(piece.schema.get_field_index("_text")))
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        apply = columns = None
        release()

    rows = source.mapInArrow(run, out)
    return rows.select(F.col("_key").alias(key), *[F.col(f"_also_{n}").alias(n) for n in also], *[f.name for f in fields])


def span_digest(spans, base: tuple[str, ...]):
    """(joined, base_sha256) columns of an array<struct<kind,start,end,..>> already in order."""
    join = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return join(spans), F.sha2(join(F.filter(spans, lambda s: s["base"] & s["kind"].isin(*base))), 256)


def kind_count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")
