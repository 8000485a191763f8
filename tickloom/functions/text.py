"""Text functions: lexicon sentiment, mentions, sector keywords, announcement kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .scalar import as_col

# The sentiment lexicon. Words that stand in both lists of one
# polarity count twice, so general and market terms are kept apart.
POSITIVE = """
surge rally gain rise jump climb soar rocket bullish optimistic positive strong growth profit
beat exceed outperform upgrade buy recommend record high breakthrough milestone expansion
acquisition merger partnership deal contract order dividend bonus split buyback investment
funding ipo
""".split()
NEGATIVE = """
fall drop decline slide plunge crash tumble sink bearish pessimistic negative weak loss miss
disappoint underperform downgrade sell reduce cut layoff bankruptcy default fraud scam
investigation probe lawsuit litigation penalty fine warning alert risk concern worry fear
uncertainty volatility
""".split()
MARKET_POSITIVE = "nifty sensex inflow investment reform liquidity stimulus".split()
MARKET_NEGATIVE = """
outflow withdrawal inflation deficit downgrade stress npa default haircut resolution insolvency
""".split()

# Sector keywords, tried in this order.
SECTOR_KEYWORDS = [
    ("bank", "Banks"),
    ("banking", "Banks"),
    ("financial", "Financials"),
    ("it", "IT"),
    ("technology", "IT"),
    ("software", "IT"),
    ("auto", "Auto"),
    ("automobile", "Auto"),
    ("vehicle", "Auto"),
    ("pharma", "Healthcare"),
    ("pharmaceutical", "Healthcare"),
    ("healthcare", "Healthcare"),
    ("fmcg", "FMCG"),
    ("consumer", "FMCG"),
    ("energy", "Energy"),
    ("oil", "Energy"),
    ("gas", "Energy"),
    ("metal", "Metals"),
    ("steel", "Metals"),
    ("aluminium", "Metals"),
    ("cement", "Cement"),
    ("construction", "CapitalGoods"),
    ("realty", "Realty"),
    ("real estate", "Realty"),
    ("telecom", "Telecom"),
    ("telecommunication", "Telecom"),
]

# Announcement patterns on the lower-cased subject.
ANNOUNCEMENT_PATTERNS = {
    "is_board_meeting": "board meeting|board_meeting",
    "is_results": "financial result|quarterly result|annual result|result",
    "is_dividend": "dividend",
    "is_bonus": "bonus",
    "is_split": "split|sub-division",
    "is_merger": "merger|amalgamation|scheme",
}


WORD = r"([\p{L}\p{N}_]+)"


def words(text: Column | str) -> Column:
    """Distinct lower-case word tokens of the whole text (letters of any script, digits, _)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(as_col(text)), F.lit(WORD), 1))


def _literal(words_: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in words_])


def sentiment(
    text: Column | str,
    positive: list[list[str]] = (POSITIVE, MARKET_POSITIVE),
    negative: list[list[str]] = (NEGATIVE, MARKET_NEGATIVE),
) -> Column:
    """(pos - neg) / (pos + neg) over distinct words, 0 when no word is listed.

    The whole text is tokenised once and cut down to the listed words (the intersection
    is distinct already); the lists are counted on that short array.
    """
    listed = list(dict.fromkeys(w for part in [*positive, *negative] for w in part))
    tokens = F.regexp_extract_all(F.lower(as_col(text)), F.lit(WORD), 1)
    found = F.array_intersect(tokens, _literal(listed))

    def score(hit: Column) -> Column:
        pos = sum((F.size(F.array_intersect(hit, _literal(part))) for part in positive), F.lit(0))
        neg = sum((F.size(F.array_intersect(hit, _literal(part))) for part in negative), F.lit(0))
        return F.coalesce(F.try_divide((pos - neg).cast("double"), (pos + neg).cast("double")), F.lit(0.0))

    # NULL text has no words; the one-element transform evaluates the tokens once
    return F.coalesce(F.element_at(F.transform(F.array(found), score), 1), F.lit(0.0))


def sector_of(text: Column | str, keywords: list[tuple[str, str]] = SECTOR_KEYWORDS) -> Column:
    """Sector of the first keyword, in list order, that occurs anywhere in the text."""
    lowered = F.lower(as_col(text))
    chain = F.when(lowered.contains(keywords[0][0]), F.lit(keywords[0][1]))
    for key, sector in keywords[1:]:
        chain = chain.when(lowered.contains(key), F.lit(sector))
    return chain


def announcement_flags(subject: Column | str) -> dict[str, Column]:
    lowered = F.lower(as_col(subject))
    return {name: F.coalesce(lowered.rlike(p), F.lit(False)) for name, p in ANNOUNCEMENT_PATTERNS.items()}


def _phrase_pattern(shape: str) -> str:
    """Regex for a symbol shape like W&W: overlapping matches of words with these separators."""
    parts = shape.split(" ")
    if parts[0] != "W" or parts[-1] != "W":
        raise ValueError(f"symbols must start and end with a letter or digit: {shape}")
    word = WORD.strip("()")
    body = "".join(word if p == "W" else re.escape(p) for p in parts)
    edge = word.rstrip("+")
    return f"(?<!{edge})(?=({body})(?!{edge}))"


SHAPES = 50  # kinds of separators inside symbols; each costs a pass over the text


def mentions(articles: DataFrame, symbols: DataFrame, text: str = "text", key: str = "symbol") -> DataFrame:
    """One row per article and listed symbol that stands in the text as a whole word.

    The whole text is cut into its distinct words, and into the multi-part words whose
    separators occur in the symbol list (M&M, BAJAJ-AUTO); these meet the symbols in an
    equality join, so the list may have any length; a short list is broadcast and the
    words are not shuffled at all. The text itself is not carried through the join.
    """
    listed = symbols.select(F.upper(F.trim(F.col(key))).alias(key)).where(F.col(key) != "").distinct()
    listed = stored(listed, "symbols")
    # the few kinds of separators in use, e.g. "W & W"
    shape = F.trim(F.regexp_replace(F.col(key), WORD, " W "))
    shapes = [r[0] for r in listed.select(shape.alias("s")).distinct().limit(SHAPES + 1).collect()]
    if len(shapes) > SHAPES:
        raise ValueError(f"the symbols use more than {SHAPES} kinds of separators")
    upper = F.upper(F.col(text))
    found = [F.regexp_extract_all(upper, F.lit(WORD), 1)]
    found += [F.regexp_extract_all(upper, F.lit(_phrase_pattern(s)), 1) for s in shapes if s != "W"]
    rest = [c for c in articles.columns if c != text]
    tokens = articles.select(*rest, F.explode(F.array_distinct(F.concat(*found))).alias(key))
    return tokens.join(listed, key).select(*rest, key)
