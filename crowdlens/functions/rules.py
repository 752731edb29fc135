"""Rule-based sentiment (U1): a lexicon's valences, changed by what stands around a word, summed and normalised.

The base lexicon, thousands of words, is a parameter: lines of word, tab, valence.  The slang lexicon goes on top of it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .sentiment import CHARS, LEXICON

# Fixed values of the published VADER rules (Hutto and Gilbert, 2014): words that strengthen or weaken what follows, words that turn it
# round, and by how much.
STRONGER = frozenset(
    """absolutely amazingly awfully completely considerable considerably decidedly deeply enormous enormously entirely especially exceptional
    exceptionally extreme extremely fabulously flipping fricking frigging fully fucking greatly hella highly hugely incredible incredibly
    intensely major majorly more most particularly purely quite really remarkably so substantially thoroughly total totally tremendous
    tremendously uber unbelievably unusually utter utterly very""".split()
)
WEAKER = frozenset("almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of".split())
NEGATIONS = frozenset(
    """aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt neither neednt never none nope nor not
    nothing nowhere oughtnt shant shouldnt wasnt werent without wont wouldnt rarely seldom despite""".split()
)
BOOST, CAPITALS, TURN, NEAR = 0.293, 0.733, -0.74, (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT, NORM = 0.5, 1.5, 15
EXCLAMATION, EXCLAMATIONS, QUESTION, QUESTIONS = 0.292, 4, 0.18, 0.96
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def read_lexicon(lines: Iterable[str]) -> dict[str, float]:
    """word, tab, valence, and whatever follows; other lines are passed over."""
    out = {}
    for line in lines:
        cells = line.rstrip("\n").split("\t")
        try:
            out[cells[0].strip().lower()] = float(cells[1])
        except (IndexError, ValueError):
            continue
    return out


def _negates(word: str) -> bool:
    return word.replace("'", "") in NEGATIONS or word.endswith("n't")


def compound(text: str | None, lexicon: Mapping[str, float]) -> float:
    """Score in [-1, 1], to four digits; 0 for blank text."""
    # short things that are all punctuation, such as emoticons, stay whole
    words = [w if len(w.strip(_EDGES)) <= 2 else w.strip(_EDGES) for w in (text or "").split()]
    low = [w.lower() for w in words]
    capitals = [w.isupper() and len(w) > 1 for w in words]
    shouts = any(capitals) and not all(capitals)
    scores = []
    for i, word in enumerate(low):
        x = 0.0 if word in STRONGER or word in WEAKER else lexicon.get(word, 0.0)
        if x:
            way = math.copysign(1, x)
            x += way * CAPITALS * (shouts and capitals[i])
            for back, share in enumerate(NEAR, 1):
                j = i - back
                if j < 0 or low[j] in lexicon:
                    continue
                if low[j] in STRONGER or low[j] in WEAKER:
                    by = BOOST + CAPITALS * (shouts and capitals[j])
                    x += way * share * (by if low[j] in STRONGER else -by)
                if _negates(low[j]):
                    x *= TURN
        scores.append(x)
    if "but" in low:
        at = low.index("but")
        scores = [x * (BEFORE_BUT if i < at else AFTER_BUT if i > at else 1) for i, x in enumerate(scores)]
    total = sum(scores)
    if not total:
        return 0.0
    asked = (text or "").count("?")
    total += math.copysign(min((text or "").count("!"), EXCLAMATIONS) * EXCLAMATION + (0 if asked < 2 else asked * QUESTION if asked <= 3 else QUESTIONS), total)
    return round(max(-1.0, min(1.0, total / math.sqrt(total * total + NORM))), 4)


def scorer(base: Mapping[str, float] | None = None, chars: int = CHARS) -> Callable[[Column], Column]:
    """A function of a text column: the score of its first `chars` characters, as the scorer of posts is defined, by the base
    lexicon with the slang on top.  Texts travel to Python in Arrow batches."""
    lexicon = dict(base or {}) | LEXICON

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compound(t, lexicon)).astype("float64")

    return lambda text: scored(F.substring(F.coalesce(text, F.lit("")), 1, chars))
