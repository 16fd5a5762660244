"""Generated pictures for the tests."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def checker(n: int = 8) -> np.ndarray:
    y, x = np.mgrid[0:n, 0:n]
    return np.where((x + y) % 2, 0xFFFFFF, 0)


def ring(n: int = 24) -> np.ndarray:
    y, x = np.mgrid[0:n, 0:n] - (n - 1) / 2
    d = np.hypot(x, y)
    return np.where((d < n / 2 - 2) & (d > n / 4), 0x2060C0, 0xFFFFFF)


def dot_field(n: int = 12) -> np.ndarray:
    """Blue dots in a red field framed in blue."""
    out = np.full((n, n), 0x0000FF)
    out[2:-2, 2:-2] = 0xFF0000
    out[4:-4:2, 4:-4:2] = 0x0000FF
    return out


def pixels(spark: SparkSession, pictures: dict[str, np.ndarray]) -> DataFrame:
    rows = [(name, x, y, int(rgb), 255) for name, p in pictures.items() for (y, x), rgb in np.ndenumerate(p)]
    return spark.createDataFrame(rows, "img_id string, x int, y int, rgb int, a int")


def picture(df: DataFrame, name: str) -> np.ndarray:
    rows = df.where(df.img_id == name).select("x", "y", "rgb").toPandas()
    out = np.full((rows.y.max() + 1, rows.x.max() + 1), -1)
    out[rows.y, rows.x] = rows.rgb
    return out
