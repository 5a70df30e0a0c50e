"""How components of vectors relate, from the covariances that `baseline.learn` adds up: no rows are gathered."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations(models: DataFrame, regime: str, covariance: str = "covariance") -> DataFrame:
    """(regime, i, j, r) of every two components i < j; null where one does not vary."""
    rows = models.select(regime, F.col(covariance).alias("c"), F.posexplode(covariance).alias("i", "row"))
    each = rows.select(regime, "c", "i", F.posexplode("row").alias("j", "v")).where("i < j")
    # variances of nothing but rounding count as none
    scale = F.sqrt(F.get(F.get("c", F.col("i")), F.col("i")) * F.get(F.get("c", F.col("j")), F.col("j")))
    return each.select(regime, "i", "j", F.when(scale > 1e-15, F.col("v") / scale).alias("r"))


def explained(models: DataFrame, regime: str, wanted: list[tuple[int, tuple[int, ...]]], covariance: str = "covariance") -> DataFrame:
    """(regime, i, r2): the share of the variance of component i that its least-squares fit by the others named (with a
    constant) explains, for each (i, others) of `wanted`; null where i does not vary. Others that depend on each other
    count once."""

    @F.arrow_udf("array<double>")
    def of(cs: pa.Array) -> pa.Array:
        out = []
        for c in cs.to_pylist():
            c, own = np.array(c), []
            for i, others in wanted:
                o = list(others)
                fit = c[i, o] @ np.linalg.pinv(c[np.ix_(o, o)], rcond=1e-12, hermitian=True) @ c[o, i]
                own.append(float(fit / c[i, i]) if c[i, i] > 1e-15 else None)
            out.append(own)
        return pa.array(out, pa.list_(pa.float64()))

    names = F.array(*[F.lit(i) for i, _ in wanted])
    made = models.select(regime, F.arrays_zip(names.alias("i"), of(F.col(covariance)).alias("r2")).alias("all"))
    return made.select(regime, F.explode("all").alias("x")).select(regime, "x.i", "x.r2")
