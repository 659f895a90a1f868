"""Arrays of numbers that tasks have gathered, put together few at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that meet in one task.
FAN = 64


def added(df: DataFrame, how: str = "sum") -> DataFrame:
    """One array for each `what` of rows (what int, part long, value: doubles as binary): their sum, or with how "qr" the
    R factor of all R factors. FAN parts meet in a task, and then what is left of each `what`."""

    def add(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(v, np.float64) for v in table.column("value").to_pylist()]
        if how == "qr":
            width = int(round(len(parts[0]) ** 0.5))
            out = np.linalg.qr(np.vstack([p.reshape(-1, width) for p in parts]), mode="r")
        else:
            out = np.sum(parts, axis=0)
        return pa.table({"what": table.column("what")[:1], "part": table.column("part")[:1], "value": pa.array([out.tobytes()], pa.binary())})

    once = df.groupBy("what", F.floor(F.col("part") / FAN).alias("_set")).applyInArrow(add, "what int, part long, value binary")
    return once.groupBy("what").applyInArrow(add, "what int, part long, value binary")
