"""Table functions for SQL: ``SELECT ... FROM tiles t, LATERAL voxels(t.voxels, t.dtype, t.x0, ...)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class Voxels:
    """(x, y, z, t, value) of every voxel of a tile, in the volume's coordinates."""

    def eval(self, voxels: bytes, dtype: str, x0: int, y0: int, z0: int, t0: int, nx: int, ny: int, nz: int, nt: int) -> Iterator[tuple]:
        import numpy as np

        a = np.frombuffer(voxels, np.dtype(dtype)).reshape(nx, ny, nz, nt)
        for (x, y, z, t), v in np.ndenumerate(a):
            yield x0 + x, y0 + y, z0 + z, t0 + t, float(v)


def register(spark: SparkSession) -> None:
    spark.udtf.register("voxels", udtf(Voxels, returnType="x int, y int, z int, t int, value double"))
