"""Vectors as blocks of bounded size, for operators that compare all with all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block's vectors, about.
BLOCK_BYTES = 1 << 20


def usable(v: Column) -> Column:
    """Not null, not empty, all components there and finite."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def vectors_of(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(d, v, dim) of the usable vectors; float components stay float, all others become double."""
    inner = rows.schema[vec_col].dataType.elementType.simpleString()
    v = F.col(f"`{vec_col}`") if inner == "float" else F.col(f"`{vec_col}`").cast("array<double>")
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("d"), v.alias("v")).where(usable(F.col("v"))).withColumn("dim", F.size("v"))


def packed(rows: DataFrame, keys: list[str], weights: bool = False) -> DataFrame:
    """Rows (keys..., d, v, dim[, m]) -> one row per key: (keys..., dim, ids, m, data), sorted by d.

    The keys must bound their groups; ``data`` is the components in row order.
    """
    wide = rows.schema["v"].dataType.elementType.simpleString() == "double"
    kind = np.dtype("<f8" if wide else "<f4")

    def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, m, v = [], [], []
        for b in batches:
            d.append(b.column("d").to_numpy())
            m.append(b.column("m").to_numpy() if weights else np.ones(b.num_rows, np.int64))
            v.append(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1))
        ids = np.concatenate(d)
        order = np.argsort(ids, kind="stable")
        data = np.concatenate(v)[order]
        yield pa.RecordBatch.from_arrays([*[pa.array([k.as_py()], pa.int64()) for k in key], pa.array([data.shape[1]], pa.int32()), pa.array([ids[order].astype("<i8").tobytes()]), pa.array([np.concatenate(m)[order].astype("<i8").tobytes()]), pa.array([data.tobytes()])], [*keys, "dim", "ids", "m", "data"])

    fields = ", ".join(f"{k} long" for k in keys)
    return rows.groupBy(*keys).applyInArrow(pack, f"{fields}, dim int, ids binary, m binary, data binary")


def unpacked(dim: int, ids: bytes, m: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids) // 8
    return np.frombuffer(ids, "<i8"), np.frombuffer(m, "<i8"), np.frombuffer(data, "<f4" if len(data) == 4 * n * dim else "<f8").reshape(n, dim).astype(np.float64)
