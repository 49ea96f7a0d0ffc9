"""Sums of vectors and matrices over the rows of keys, made by numpy in tasks and added by Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookflow.operators.ranks import joined


def typed(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*cols).schema.fields)


def centred(df: DataFrame, cols: Sequence[str], keys: Sequence[str], more: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keys, `more` and the columns less their key's mean, NaN as NULL; and the means, an array `centre` for each key. Products about a mean don't cancel."""
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    centres = df.groupBy(*keys).agg(F.array(*[F.coalesce(F.avg(value(c)), F.lit(0.0)) for c in cols]).alias("centre"))
    rows = joined(df, centres.withColumnRenamed("centre", "__centre"), keys)
    return rows.select(*keys, *more, *[(value(c) - F.col("__centre")[i]).alias(c) for i, c in enumerate(cols)]), centres


def summed_vectors(df: DataFrame, columns: Sequence[str], keys: Sequence[str], part: Callable[[np.ndarray], dict[tuple, np.ndarray]], labels: Sequence[str]) -> DataFrame:
    """Sums of vectors over the rows of each key and label: keys, labels, vec.

    `part` gives a vector for each tuple of labels from a block of rows, NaN for NULL.
    A task adds up its blocks and sends one vector for each key and label; vectors
    are then added by place, on the map side first, so neither a key nor a matrix meets in one task.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, rows in frame.groupby(list(keys), sort=False, dropna=False) if len(keys) else [((), frame)]:
                for label, vec in part(rows[list(columns)].to_numpy(float)).items():
                    at = (*key, *label)
                    total[at] = total[at] + vec if at in total else vec
        if total:
            names = [*keys, *labels]
            yield pd.DataFrame({**{n: [k[i] for k in total] for i, n in enumerate(names)}, "vec": list(total.values())})

    by = [*keys, *labels]
    head = ", ".join(x for x in (typed(df, keys) if keys else "", *[f"{x} string" for x in labels], "vec array<double>") if x)
    ready = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    places = ready.mapInPandas(add, head).select(*by, F.posexplode("vec").alias("place", "v")).groupBy(*by, "place").agg(F.sum("v").alias("v"))
    return places.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("s")).select(*by, F.col("s.v").alias("vec"))
