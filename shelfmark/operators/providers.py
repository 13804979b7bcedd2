"""Columns made by external models, batch by batch, with the failures of a batch kept to its rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_provider(rows: DataFrame, column: str, kind: str, load: Callable[[], Callable[[pd.DataFrame], list]], batch: int = 32, fallbacks: tuple[Callable, ...] = (), default=None, seconds: float | None = None) -> DataFrame:
    """Adds column from a model: load() runs once a task, what it returns takes a batch of rows and gives a value each.

    A batch that fails is halved until single rows fail; each of those is tried on the models of `fallbacks`
    (say, without its images), which are loaded when first needed, and gets `default` if all fail. MemoryError and
    ValueError count as failures, anything else stops the job. seconds: a task's budget, after which its
    remaining rows get the default unasked. Sort by length before if the model pads (see by_length()).
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(column, T._parse_datatype_string(kind))])

    def values(models: list, part: pd.DataFrame) -> list:
        try:
            return list(models[0](part))
        except (MemoryError, ValueError):
            if len(part) > 1:
                half = len(part) // 2
                return values(models, part.iloc[:half]) + values(models, part.iloc[half:])
        for i, more in enumerate(fallbacks, 1):
            if len(models) == i:
                models.append(more())
            try:
                return list(models[i](part))
            except (MemoryError, ValueError):
                continue
        return [default]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began, models = time.monotonic(), [load()]
        for part in parts:
            for i in range(0, len(part), batch):
                piece = part.iloc[i : i + batch]
                late = seconds is not None and time.monotonic() - began > seconds
                made = [default] * len(piece) if late else values(models, piece)
                yield piece.assign(**{column: pd.Series(made, index=piece.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def by_image(rows: DataFrame, column: str, kind: str, with_images: Callable, text_only: Callable, zeros, batch: int = 32, paths: str = "image_paths") -> DataFrame:
    """Adds column from two models: cards with images go to the first, and to the second where that fails or they have none; zeros if both fail."""
    has = F.size(F.coalesce(paths, F.array().cast("array<string>"))) > 0
    seen = with_provider(rows.where(has), column, kind, with_images, batch, (text_only,), zeros)
    return seen.unionByName(with_provider(rows.where(~has), column, kind, text_only, batch, (), zeros))


def by_length(rows: DataFrame, text: str, partitions: int) -> DataFrame:
    """Rows of like length together, long ones first within a partition, so that batches pad little."""
    sized = rows.withColumn("_size", F.coalesce(F.length(text), F.lit(0)))
    return sized.repartitionByRange(partitions, "_size").sortWithinPartitions(F.desc("_size")).drop("_size")


def masked_mean(states, mask):
    """Mean of the vectors (array<array<double>>) whose mask is 1, as a Column; zeros without any."""
    pairs = F.arrays_zip(states.alias("s"), mask.alias("m"))
    kept = F.transform(F.filter(pairs, lambda p: p["m"] == 1), lambda p: p["s"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.coalesce(F.try_element_at(kept, F.lit(1)), F.transform(F.coalesce(F.try_element_at(states, F.lit(1)), F.array().cast("array<double>")), lambda _: F.lit(0.0))), lambda a, x: F.zip_with(a, x, lambda u, v: u + v))
    return F.transform(total, lambda v: v / F.greatest(F.size(kept), F.lit(1)))
