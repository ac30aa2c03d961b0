"""Transaction costs as column expressions and plain numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostModel:
    """Commission per share and slippage in basis points of traded notional; both at least 0."""

    commission_per_share: float = 0.0
    slippage_bps: float = 0.0

    def __post_init__(self) -> None:
        if self.commission_per_share < 0 or self.slippage_bps < 0:
            raise ValueError("costs must be >= 0")

    @classmethod
    def free(cls) -> CostModel:
        return cls()

    def commission(self, shares):
        return _abs(shares) * self.commission_per_share

    def slippage(self, shares, price):
        return _abs(shares * price) * self.slippage_bps * 1e-4

    def cost(self, shares, price):
        return self.commission(shares) + self.slippage(shares, price)


def _abs(x):
    return F.abs(x) if isinstance(x, Column) else abs(x)
