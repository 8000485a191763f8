"""Sentiment of articles aggregated per symbol, sector and market day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..functions.scalar import ratio
from ..functions.text import mentions, sector_of, sentiment
from .calendar import by_date

UP, DOWN = 0.1, -0.1


def score_articles(articles: DataFrame, text: str = "text", scorer=sentiment) -> DataFrame:
    """Add ``sentiment``; the scorer is any text -> Column function."""
    return articles.withColumn("sentiment", scorer(text))


def process_articles(articles: DataFrame, symbols: DataFrame, text: str = "text") -> DataFrame:
    """Score, tag a sector, and explode to one row per article and mentioned symbol."""
    tagged = score_articles(articles, text).withColumn("sector", sector_of(text))
    return mentions(tagged, symbols, text)


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def daily_sentiment(articles: DataFrame) -> DataFrame:
    """Article measures per (symbol, date) and their rolling forms over days with news.

    A score is a ratio of two small word counts, so the exact median keeps one entry
    per distinct ratio, not per article.
    """
    s = F.col("sentiment")
    daily = articles.groupBy("symbol", "date").agg(
        F.avg(s).alias("sentiment_mean"),
        F.median(s).alias("sentiment_median"),
        F.stddev_samp(s).alias("sentiment_std"),
        F.count(s).alias("article_count"),
        F.count_if(s > UP).alias("positive_count"),
        F.count_if(s < DOWN).alias("negative_count"),
    )
    daily = daily.withColumns(
        {f"{k}_ratio": ratio(f"{k}_count", "article_count") for k in ("positive", "negative")}
    ).withColumn("neutral_ratio", 1.0 - F.col("positive_ratio") - F.col("negative_ratio"))
    w = R.series()
    cols = {
        "sentiment_5d_ma": R.mean("sentiment_mean", w, 5, 3),
        "sentiment_20d_ma": R.mean("sentiment_mean", w, 20, 10),
        "article_count_5d_ma": R.mean("article_count", w, 5, 3),
        "article_count_20d_ma": R.mean("article_count", w, 20, 10),
        "news_volume_zscore_20d": R.zscore("article_count", w, 20, 10),
        "positive_ratio_5d_ma": R.mean("positive_ratio", w, 5, 3),
        "negative_ratio_5d_ma": R.mean("negative_ratio", w, 5, 3),
    }
    cols |= {f"sentiment_momentum_{n}d": R.change("sentiment_mean", w, n) for n in (5, 20)}
    cols |= {f"sentiment_zscore_{n}d": R.zscore("sentiment_mean", w, n, n // 2) for n in (20, 60)}
    return daily.withColumns(cols)


def sector_sentiment(articles: DataFrame) -> DataFrame:
    s = F.col("sentiment")
    daily = articles.where(F.col("sector").isNotNull()).groupBy("sector", "date").agg(
        F.avg(s).alias("sector_sentiment_mean"),
        F.median(s).alias("sector_sentiment_median"),
        F.count(s).alias("sector_article_count"),
        _share(s > UP).alias("sector_positive_ratio"),
        _share(s < DOWN).alias("sector_negative_ratio"),
        F.count_distinct("symbol").alias("unique_symbols"),
    )
    w = R.series("sector")
    return daily.withColumns(
        {
            "sector_sentiment_5d_ma": R.mean("sector_sentiment_mean", w, 5, 3),
            "sector_sentiment_20d_ma": R.mean("sector_sentiment_mean", w, 20, 10),
            "sector_news_volume_zscore": R.zscore("sector_article_count", w, 20, 10),
        }
    )


def market_sentiment(articles: DataFrame) -> DataFrame:
    """Per date over all articles, and the share of symbols whose own mean is positive."""
    s = F.col("sentiment")
    daily = articles.groupBy("date").agg(
        F.avg(s).alias("market_sentiment_mean"),
        F.median(s).alias("market_sentiment_median"),
        F.count(s).alias("market_article_count"),
        _share(s > UP).alias("market_positive_ratio"),
        _share(s < DOWN).alias("market_negative_ratio"),
        F.count_distinct("symbol").alias("unique_symbols"),
    )
    per_symbol = articles.groupBy("date", "symbol").agg(F.avg(s).alias("_mean"))
    breadth = per_symbol.groupBy("date").agg(
        _share(F.col("_mean") > UP).alias("market_breadth_positive"), F.count("symbol").alias("symbols_with_news")
    )
    w = by_date()
    cols = {
        "market_sentiment_5d_ma": R.mean("market_sentiment_mean", w, 5, 3),
        "market_sentiment_20d_ma": R.mean("market_sentiment_mean", w, 20, 10),
        "market_breadth_5d_ma": R.mean("market_breadth_positive", w, 5, 3),
    }
    cols |= {f"market_sentiment_zscore_{n}d": R.zscore("market_sentiment_mean", w, n, n // 2) for n in (20, 60)}
    return daily.join(breadth, "date", "left").withColumns(cols)
