"""Lexicon sentiment (U1) as a native expression: summed valences s, normalised to s / sqrt(s^2 + 15)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Valences of the slang lexicon.
LEXICON = {
    "moon": 2.5, "mooning": 2.5, "rocket": 1.5, "tendies": 2.0, "calls": 1.5, "call": 0.8, "long": 1.0, "bull": 2.0, "bullish": 2.5,
    "buy": 1.0, "btfd": 2.0, "hodl": 1.5, "hold": 0.5, "stonks": 1.5, "lambo": 2.0, "printing": 1.5, "breakout": 1.5, "undervalued": 1.5,
    "squeeze": 1.0, "rip": 1.0, "ripping": 2.0, "pump": 0.5, "puts": -1.5, "put": -0.8, "short": -1.0, "bear": -2.0, "bearish": -2.5,
    "sell": -1.0, "dump": -2.0, "dumping": -2.5, "crash": -2.5, "tank": -2.0, "tanking": -2.5, "drill": -2.0, "drilling": -2.0,
    "bagholder": -2.5, "bagholders": -2.5, "bags": -1.5, "rug": -2.5, "rugged": -3.0, "rekt": -2.5, "overvalued": -1.5, "bubble": -1.5,
    "scam": -3.0, "worthless": -3.0, "delisted": -2.5, "bankrupt": -3.0, "bankruptcy": -3.0,
}
CHARS, BULL, BEAR = 300, 0.05, -0.05


def score(text: Column, lexicon: Mapping[str, float] = LEXICON, chars: int = CHARS) -> Column:
    """Compound score in [-1, 1] of the first `chars` characters; 0 for blank text."""
    valence = F.create_map(*[F.lit(x) for pair in lexicon.items() for x in pair])
    total = F.aggregate(tokens(F.substring(F.coalesce(text, F.lit("")), 1, chars)), F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(valence, w), F.lit(0.0)))
    return total / F.sqrt(total * total + 15)
