"""Principal components from sums: one pass adds up moments by batch, the driver solves for as many numbers as there are dimensions squared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def moments(rows: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """How many vectors there are, their sum, and the sum of their outer products; nulls are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("v"))
                own = np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("sums"):
                own = np.frombuffer(x.as_buffer(), np.float64)
                total = own.copy() if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "sums binary")
    found = parts.repartition(16).mapInArrow(add, "sums binary").collect()  # 16 rows whatever the input
    if not found:
        return 0, np.empty(0), np.empty((0, 0))
    flat = np.sum([np.frombuffer(bytes(r["sums"]), np.float64) for r in found], axis=0)
    d = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
    return int(flat[0]), flat[1 : d + 1], flat[d + 1 :].reshape(d, d)


class Components:
    """mean, axes (components x dimensions) and variances of the leading principal components; an axis's largest entry is positive."""

    def __init__(self, n: int, total: np.ndarray, outer: np.ndarray, keep: int):
        self.mean = total / max(1, n)
        covariance = (outer - n * np.outer(self.mean, self.mean)) / max(1, n - 1)
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(values)[::-1][:keep]
        axes = vectors[:, order].T
        sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
        self.axes, self.variances, self.all = axes * np.where(sign == 0, 1, sign)[:, None], np.maximum(values[order], 0), float(np.maximum(values, 0).sum())

    def project(self, vector: Column) -> Column:
        mean, axes = self.mean, self.axes

        @pandas_udf(ArrayType(DoubleType()))
        def run(v):
            return v.map(lambda x: None if x is None else axes @ (np.asarray(x, np.float64) - mean))

        return run(vector)


def principal_components(rows: DataFrame, vector: str, keep: int) -> Components:
    n, total, outer = moments(rows, vector)
    return Components(n, total, outer, keep)
