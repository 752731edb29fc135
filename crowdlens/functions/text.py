"""Entity, theme and term extraction as native expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lists import BARE_PROSE_STOP

# Symbols that are jargon rather than tickers.
STOP_TICKERS = tuple(
    "DD YOLO USA CEO CFO IPO ATH ITM OTM FOMO FUD ER EOD IMO IRL AI IT OK ALL NEW NOW BIG LOL WSB IV EOY ETF ROI FBI NYSE NASDAQ SEC EV USD GDP CPI".split()
)
# Words that are never emerging terms (boilerplate, function words, promotion).
TERM_STOP = tuple(
    """https http www com amp quot gt lt stock stocks market markets share shares price buy sell hold calls puts earnings portfolio
    trading trade invest investing investors investor money today tomorrow week year think thoughts
    the and for are but not you your all any can had has have him her his its our out she they them their this that these those
    was were will with would could should what when where which who why how than then there here from into onto over under about after
    before between through during against above below again once also just only even still while now right more most much many some same
    other another such very too been being does did doing because until both each own off
    doesn isn aren wasn weren hasn haven hadn wouldn couldn shouldn won don didn ain lot
    whatsapp telegram discord instagram tiktok youtube facebook snapchat linkedin twitter gmail email
    inbox website webinar zoom click link links subscribe follow followers join joined group groups channel channels community admin moderator
    giveaway promo promotion referral bonus signup register registration mentor mentorship guru coach coaching masterclass course courses ebook
    vip casino jackpot lottery winner congratulations guaranteed dms""".split()
)


def combined(title: Column, body: Column) -> Column:
    """Title and body in one text; null counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def cashtags(text: Column) -> Column:
    """Symbols after a dollar sign, upper case, repeats kept."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"(?U)\$([A-Z]{1,5})\b"), 1)


def bare_symbols(text: Column) -> Column:
    """Words of 4 or 5 capitals, cashtags left out."""
    return F.regexp_extract_all(F.regexp_replace(text, r"(?U)(?i)\$[A-Z]{1,5}\b", " "), F.lit(r"(?U)\b([A-Z]{4,5})\b"), 1)


def symbols(text: Column, cashtags_only: bool = False, bare_stop: Iterable[str] = BARE_PROSE_STOP, screened: Iterable[str] = ()) -> Column:
    """X3 without the universe (J6 is a join): cashtags, then bare symbols; the stop list holds for both, the other two for
    bare ones only."""
    without = lambda xs, stop: F.filter(xs, lambda s: ~s.isin(*stop)) if stop else xs
    tagged = without(cashtags(text), STOP_TICKERS)
    if cashtags_only:
        return tagged
    return F.concat(tagged, without(bare_symbols(text), (*STOP_TICKERS, *bare_stop, *screened)))


def tokens(text: Column) -> Column:
    """X4."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def is_phrase(keyword: str) -> bool:
    """X5."""
    return any(c in keyword for c in " -.")


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A pattern of empty matches, whose group 1 is the longest of the phrases that starts at a place.  It branches by character, so
    that a place costs a few comparisons however many phrases there are."""

    def branch(tails: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for t in tails:
            if t:
                heads.setdefault(t[0], []).append(t[1:])
        ways = "|".join((c if c.isalnum() else "\\" + c) + branch(rest) for c, rest in sorted(heads.items()))
        return f"(?:{ways})" + ("?" if "" in tails else "") if ways else ""

    return f"(?=({branch(sorted(set(phrases)))}))"


def themes(text: Column, keywords: Mapping[str, Iterable[str]]) -> Column:
    """Distinct themes whose words are among the tokens or whose phrases are in the lower-case text, sorted.

    The text is read once for all words and once for all phrases.  Where phrases begin alike only the longest is reported, which
    stands for those that it begins with."""
    lists = {theme: sorted({w.lower() for w in words} - {""}) for theme, words in sorted(keywords.items())}
    words, phrases = ([w for w in sorted({w for ws in lists.values() for w in ws}) if is_phrase(w) == p] for p in (False, True))
    none = F.array().cast("array<string>")
    found = F.array_intersect(tokens(text), F.array(*[F.lit(w) for w in words])) if words else none
    if phrases:
        found = F.concat(found, F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(phrase_pattern(phrases)), 1)))

    def of(x: Column) -> Column:
        hits = []
        for theme, own in lists.items():
            own = [w for w in own if not is_phrase(w)] + [q for q in phrases if q.startswith(tuple(w for w in own if is_phrase(w)))]
            hits.append(F.when(F.arrays_overlap(x, F.array(*[F.lit(w) for w in own])) if own else F.lit(False), F.lit(theme)))
        return F.array_compact(F.array(*hits)) if hits else none

    return F.element_at(F.transform(F.array(found), of), 1)  # a lambda's variable is found once


def terms(text: Column, stop: Iterable[str] = TERM_STOP) -> Column:
    """Distinct words of 3 or more, and pairs of neighbours, with no stop word among them."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]{2,}"), 0)
    kept = F.transform(words, lambda w: F.when(~w.isin(*stop), w))  # stop words become null, so neighbours stay known

    def of(kept: Column) -> Column:
        n = F.greatest(F.size(kept) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(kept, F.lit(1), n), F.slice(kept, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.array_compact(F.concat(kept, pairs)))

    # as a lambda's variable the words are found once, not at every mention
    return F.element_at(F.transform(F.array(kept), of), 1)


def compact(n: Column) -> Column:
    """950, 1.2k, 2.5M."""
    return F.when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("long").cast("string"))


def classify(caps: Column, lower: Column, zipf: Column, sightings: int = 30, share: float = 0.5, common: float = 3.5) -> Column:
    """The ladder of D21: (classification, decided_by)."""
    enough = caps + lower >= sightings
    demoted = F.when(enough, caps / F.nullif(caps + lower, F.lit(0)) < share).otherwise(F.coalesce(zipf, F.lit(0.0)) >= common)
    return F.struct(F.when(demoted, "cashtag_only").otherwise("normal").alias("classification"), F.when(enough, "case_ratio").otherwise("wordfreq").alias("decided_by"))
