"""Registry of exogenous (sidecar) features and their composition onto the panel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import ratio
from .asof import asof
from .calendar import by_date

Builder = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Feature:
    """``build`` makes the column from the sidecar (one row per date) or from the symbol's bars."""

    name: str
    build: Builder
    needs: tuple[str, ...]
    lookback_days: int = 0
    per_symbol: bool = False
    enabled: bool = True


class Registry:
    def __init__(self) -> None:
        self._features: dict[str, Feature] = {}

    def register(self, feature: Feature) -> None:
        if feature.name in self._features:
            raise ValueError(f"feature {feature.name} is registered already")
        if feature.lookback_days < 0:
            raise ValueError("lookback must be >= 0")
        self._features[feature.name] = feature

    def enable(self, name: str, on: bool = True) -> None:
        self._features[name] = replace(self._features[name], enabled=on)

    def names(self, enabled_only: bool = True) -> list[str]:
        return [f.name for f in self.features(enabled_only)]

    def features(self, enabled_only: bool = True) -> list[Feature]:
        return [f for f in self._features.values() if f.enabled or not enabled_only]

    def total_lookback(self) -> int:
        return sum(f.lookback_days for f in self.features())

    def __contains__(self, name: str) -> bool:
        return name in self._features


def past_return(days: int) -> Builder:
    """Return over ``days`` rows that ended the row before."""
    return lambda w: ratio(F.lag("close", 1).over(w), F.lag("close", 1 + days).over(w)) - 1.0


def _value(name: str) -> Builder:
    return lambda w: F.col(name).cast("double")


def default_registry() -> Registry:
    r = Registry()
    for f in (
        Feature("fii_dii_net_flow", _value("fii_net_cr"), ("fii_net_cr",), 1),
        Feature("dii_net_flow", _value("dii_net_cr"), ("dii_net_cr",), 1),
        Feature("fii_dii_net_flow_pct_adv", lambda w: ratio("fii_net_cr", "nifty100_adv_cr"), ("fii_net_cr", "nifty100_adv_cr"), 1),
        Feature("india_vix_level", _value("india_vix"), ("india_vix",), 1),
        Feature("india_vix_change_5d", lambda w: R.change("india_vix", w, 5), ("india_vix",), 5),
        Feature("put_call_ratio", _value("pcr_oi"), ("pcr_oi",), 1),
        Feature("oi_change_pct", lambda w: R.growth("total_oi", w), ("total_oi",), 1),
        Feature("global_overnight_cue", _value("us_futures_pct_change_overnight"), ("us_futures_pct_change_overnight",), 1),
        Feature(
            "earnings_event_flag",
            lambda w: F.coalesce(F.col("earnings_event_flag").cast("double"), F.lit(0.0)),
            ("earnings_event_flag",),
        ),
        Feature("sector_momentum_5d", past_return(5), ("close",), 5, per_symbol=True),
        Feature("sector_momentum_20d", past_return(20), ("close",), 20, per_symbol=True),
    ):
        r.register(f)
    return r


def exogenous_features(bars: DataFrame, sidecar: DataFrame, registry: Registry | None = None, apply_lookback: bool = False) -> DataFrame:
    """Bars with every enabled feature whose inputs exist.

    Sidecar features are computed on the sidecar's own dates, and each column's latest
    known value is carried to the trading dates. ``apply_lookback`` shifts a feature
    back by its declared lookback (sidecar rows) before that.
    """
    registry = registry or default_registry()
    daily = [f for f in registry.features() if not f.per_symbol and set(f.needs) <= set(sidecar.columns)]
    own = [f for f in registry.features() if f.per_symbol and set(f.needs) <= set(bars.columns)]
    out = bars
    if daily:
        w = by_date()
        built = sidecar.select("date", *[f.build(w).alias(f.name) for f in daily])
        if apply_lookback:
            built = built.select(
                "date", *[(F.lag(f.name, f.lookback_days).over(w) if f.lookback_days else F.col(f.name)).alias(f.name) for f in daily]
            )
        out = asof(out, built, [], [f.name for f in daily], each_column=True)
    if own:
        w = R.series()
        out = out.withColumns({f.name: f.build(w) for f in own})
    return out


def join_sources(panel: DataFrame, sources: dict[str, DataFrame | None]) -> DataFrame:
    """Carry several optional daily sources to the panel.

    A source with a symbol column is matched per symbol, others market-wide. Missing
    sources are skipped; a column name already taken gets the source name as suffix.
    """
    out = panel
    for name, source in sources.items():
        if source is None:
            continue
        by = ["symbol"] if "symbol" in source.columns else []
        values = [c for c in source.columns if c not in ("symbol", "date")]
        renamed = {c: f"{c}_{name}" for c in values if c in out.columns}
        source = source.withColumnsRenamed(renamed)
        out = asof(out, source, by, [renamed.get(c, c) for c in values])
    return out


def merge_sources(base: DataFrame, sources: dict[str, DataFrame | None], keys: list[str]) -> DataFrame:
    """Equality left joins with the same suffix rule; sources are unique per key."""
    out = base
    for name, source in sources.items():
        if source is None or not set(keys) <= set(source.columns):
            continue
        taken = {c: f"{c}_{name}" for c in source.columns if c in out.columns and c not in keys}
        out = out.join(source.withColumnsRenamed(taken), keys, "left")
    return out
