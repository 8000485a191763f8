"""Trading-cost model: round-trip cost of one side's notional."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import as_col


@dataclass(frozen=True)
class CostRates:
    """The published default rates (percent unless named otherwise)."""

    brokerage_pct: float = 0.03
    brokerage_flat_inr: float = 20.0
    stt_sell_pct: float = 0.025
    exchange_txn_pct: float = 0.00325
    sebi_charges_pct: float = 0.0001
    stamp_duty_buy_pct: float = 0.015
    gst_on_brokerage_pct: float = 18.0
    slippage_bps_per_side: float = 5.0

    @classmethod
    def load(cls, settings: dict | None = None, prefix: str = "TICKLOOM_COST_") -> "CostRates":
        """Defaults, then a settings mapping, then environment variables; bad numbers are skipped."""
        rates = cls()
        given = dict((settings or {}).get("costs") or settings or {})
        for f in fields(cls):
            for raw in (given.get(f.name), os.environ.get(prefix + f.name.upper())):
                try:
                    rates = replace(rates, **{f.name: float(raw)})
                except (TypeError, ValueError):
                    continue
        return rates

    def as_dict(self) -> dict[str, float]:
        return asdict(self)


def round_trip_pct(
    rates: CostRates,
    turnover: Column | float = 1.0,
    buy_value: Column | str | None = None,
    sell_value: Column | str | None = None,
) -> Column:
    """Cost in percent; the flat brokerage floor binds per side when a notional is given."""
    p = turnover if isinstance(turnover, Column) else F.lit(float(turnover))
    brokerage = p * rates.brokerage_pct
    for value in (sell_value, buy_value):
        if value is None:
            continue
        v = as_col(value).cast("double")
        floor = F.lit(rates.brokerage_flat_inr * 100.0) / F.greatest(v, F.lit(1.0))
        binds = (v > 0) & (p * rates.brokerage_pct * v / 100.0 < rates.brokerage_flat_inr)
        brokerage = F.when(binds, F.greatest(brokerage, floor)).otherwise(brokerage)
    both_sides = p * 2.0
    taxed = brokerage + both_sides * rates.exchange_txn_pct + both_sides * rates.sebi_charges_pct
    return (
        taxed * (1.0 + rates.gst_on_brokerage_pct / 100.0)
        + p * (rates.stt_sell_pct + rates.stamp_duty_buy_pct)
        + both_sides * rates.slippage_bps_per_side / 100.0
    )


def round_trip_fraction(rates: CostRates) -> float:
    """The percentage-only cost of a full turn as a decimal (driver-side constant)."""
    taxed = rates.brokerage_pct + 2.0 * (rates.exchange_txn_pct + rates.sebi_charges_pct)
    percent = (
        taxed * (1.0 + rates.gst_on_brokerage_pct / 100.0)
        + rates.stt_sell_pct
        + rates.stamp_duty_buy_pct
        + 2.0 * rates.slippage_bps_per_side / 100.0
    )
    return percent / 100.0
