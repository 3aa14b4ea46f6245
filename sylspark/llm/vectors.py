"""Vector tables: valid rows, equal vectors as one class, double precision products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid(table: DataFrame, keep: list[str]) -> DataFrame:
    """``vec_id``, ``keep`` and ``v`` (little-endian doubles) of the rows whose vector is usable.

    A vector is not if it is null, empty, zero, or holds null or non-finite components.
    """
    names = ["vec_id", *keep]

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("embedding")
            column = batch.column(at)
            data = []
            for x in column.to_pylist():
                v = None
                if x and None not in x:
                    y = np.array(x, "<f8")
                    if np.isfinite(y).all() and y.any():
                        v = y.tobytes()
                data.append(v)
            out = [batch.column(batch.schema.names.index(k)) for k in names]
            yield pa.RecordBatch.from_arrays([*out, pa.array(data, pa.binary())], [*names, "v"]).filter(pa.array([d is not None for d in data], pa.bool_()))

    given = table.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, "embedding")
    kinds = ", ".join(f"{k} {given.schema[k].dataType.simpleString()}" for k in names)
    return given.mapInArrow(run, f"{kinds}, v binary")


def matrix(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


def fitted(classes: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, by the least hash, for fitting an index; sorted, so the fit is repeatable."""
    got = classes.orderBy(F.xxhash64("v"), "v").limit(rows).select("v").toArrow().column(0).to_pylist()
    return matrix(got) if got else np.empty((0, 0))
