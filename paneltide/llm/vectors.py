"""Reading vector columns: one row per id, with a defined treatment of broken vectors.

A null id has no row in a result and takes part in nothing. Of rows that repeat an id the
largest vector in array order counts. A vector that is null, or holds null or non-finite
components, is not whole. An empty vector is whole but has no direction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_id(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row per id."""
    return (df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
            .agg(F.max(vector_col).alias("v")))


def is_whole(v: Column) -> Column:
    """No null and no non-finite component."""
    def finite(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    return F.coalesce(v.isNotNull() & F.forall(v, finite), F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
