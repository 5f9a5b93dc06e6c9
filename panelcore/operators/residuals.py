"""Calibration residuals as a ranked table: any interval level is two look-ups.

Residuals are ordered once, by range partitions, when a model is frozen; each row carries
its rank, and the table is written in that order. A quantile at any level then needs the
two rows beside its fractional rank. Ranks ascend through the files, so the scan skips
all row groups but those: intervals at a new level, or a set of predictive quantiles,
cost a few rows, whatever the number of residuals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcore.checks import ContractError
from panelcore.functions.ranks import global_row_number


@dataclass
class ResidualStore:
    """``rank, value`` of the signed residuals and of their sizes, ranks from 1."""

    n: int
    signed: DataFrame
    sizes: DataFrame

    @staticmethod
    def of(residuals: DataFrame) -> ResidualStore:
        def ranked(value) -> DataFrame:
            return global_row_number(residuals.select(value.alias("value")), ["value"], "rank")

        signed, sizes = ranked(F.col("residual")), ranked(F.abs("residual"))
        return ResidualStore(signed.count(), signed, sizes)

    def save(self, path: str) -> None:
        for name, table in (("signed", self.signed), ("sizes", self.sizes)):
            ordered = table.repartitionByRange("rank").sortWithinPartitions("rank")
            ordered.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str, n: int) -> ResidualStore:
        return ResidualStore(n, *(spark.read.parquet(f"{path}/{t}") for t in ("signed", "sizes")))

    def _at(self, table: DataFrame, levels: list[float]) -> list[float]:
        """Linear-interpolation quantiles; at most two rows per level are read."""
        places = [(self.n - 1) * q for q in levels]
        ranks = sorted({r + 1 for h in places for r in (math.floor(h), math.ceil(h))})
        at = {r["rank"]: r["value"] for r in table.where(F.col("rank").isin(ranks)).collect()}
        out = []
        for h in places:
            low, high = at[math.floor(h) + 1], at[math.ceil(h) + 1]
            out.append(low + (high - low) * (h - math.floor(h)))
        return out

    def quantiles(self, levels: list[float]) -> list[float]:
        """Signed residual quantiles."""
        self._require()
        return self._at(self.signed, levels)

    def width(self, alpha: float) -> float:
        """Conformal half-width with the finite-sample correction."""
        self._require()
        return self._at(self.sizes, [min(math.ceil((self.n + 1) * (1.0 - alpha)) / self.n, 1.0)])[0]

    def _require(self) -> None:
        if not self.n:
            raise ContractError("there are no calibration residuals")
