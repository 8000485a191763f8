"""Small hand-made frames."""

import datetime as dt

import numpy as np
import pandas as pd

BARS = "date date, symbol string, open double, high double, low double, close double, volume double"


def business_days(n: int, start: str = "2020-01-01") -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def price_frame(symbols=("AAA", "BBB"), n: int = 320, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        open_ = close * (1 + rng.normal(0, 0.005, n))
        high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n))
        low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
        volume = rng.integers(1_000, 5_000, n).astype(float)
        parts.append(pd.DataFrame(dict(date=business_days(n), symbol=s, open=open_, high=high, low=low, close=close, volume=volume)))
    return pd.concat(parts, ignore_index=True)


def bars(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf[["date", "symbol", "open", "high", "low", "close", "volume"]], BARS)


def to_pandas(df, *keys: str) -> pd.DataFrame:
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
