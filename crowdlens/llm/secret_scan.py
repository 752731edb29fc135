r"""Secret scans; DataFrame functions only.

Patterns find what says that it is a secret or has a secret's form.  Sliding windows find the rest: runs of the characters that
keys are written in, in which the Shannon entropy of WINDOW characters reaches its class's bound.  A window moves on by one
character: it changes two counts, that of the character that leaves and that of the one that enters, and the sum of c log2(c)
by the differences of these two, so that no window is counted anew.  Sums are whole numbers (units of 2^-20), thus exact in any order.
Windows that overlap are one span.  Runs on the allow-list (alphabets, examples, UUIDs, checksums named as such) add none.

Spans are found where the text is: nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import tame

SPAN = "array<struct<start:int,end:int>>"
WINDOW = 24
#: Sums are in units of one millionth or so, as a power of two.
UNIT = 1 << 20


class Pattern(NamedTuple):
    """A kind of secret: matches of `regex`, leftmost and without overlap, whose `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int
    least: int


class CharClass(NamedTuple):
    """A class of characters: runs of at least WINDOW of `chars`, windows with at least `bits` of entropy and one of each `needs`."""

    kind: str
    chars: str
    bits: float
    needs: tuple[str, ...]


#: Letters stand in both cases one by one, since engines differ in what else they fold.
PATTERNS = (
    Pattern("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", r"[0-9a-f]+", 0, 24),
)
CLASSES = (
    CharClass("upperhex", "0-9A-F", 3.0, ("[0-9]", "[A-F]")),
    CharClass("base64", "A-Za-z0-9+/_=-", 4.0, ("[0-9]", "[A-Z]", "[a-z]")),
)
#: A run that one of these matches, or whose 40 characters before do, adds no span.
ALLOW_RUN = (r"(?i)example|placeholder|dummy", r"(?i)abcdefghijkl|0123456789ab|bcdefghijklm", r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
ALLOW_BEFORE = (r"(?i)(sha1|sha256|sha512|md5|checksum|integrity|commit)[-:= ]{0,3}$", r"(?i)https?://[^\x20\x09-\x0D]*$")


def weights(window: int = WINDOW) -> list[int]:
    """c log2(c) for counts 0 to window, in units."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, window + 1)]


def most(bits: float, window: int = WINDOW) -> int:
    """The largest sum of c log2(c) with which a window has this entropy, H = log2(W) - sum / W, with room for rounded weights."""
    return math.ceil((math.log2(window) - bits) * window * UNIT) + window


def located(text: Column, regex: str, group: int = 0) -> Column:
    """Array of (start, end, size) of all matches, in code points; size is the length of the group.

    The pieces between matches tell where they stand."""
    runs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,size:int>>").alias("out"))

    def step(state: Column, run: Column) -> Column:
        begin = state["at"] + F.length(run["gap"])
        end = begin + F.coalesce(F.length(run["hit"]), F.lit(0))
        found = F.struct(begin.alias("start"), end.alias("end"), F.length(run["part"]).alias("size"))
        return F.struct(end.alias("at"), F.when(run["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(found))).alias("out"))

    return F.when(text.rlike(regex), F.aggregate(runs, start, step, lambda s: s["out"])).otherwise(start["out"])


def pattern_spans(text: Column, pattern: Pattern) -> Column:
    """Spans (start, end) of the pattern's matches that are long enough; text must not be null."""
    # short matches of a single class needn't be located: a run that is too short holds no longer one
    regex = f"{pattern.regex[:-1]}{{{pattern.least},}}" if pattern.group == 0 and pattern.regex.startswith("[") else pattern.regex
    return F.transform(F.filter(located(text, regex, pattern.group), lambda x: x["size"] >= pattern.least), lambda x: F.struct(x["start"], x["end"]))


def entropy_spans(run: Column, kind: CharClass, window: int = WINDOW) -> Column:
    """Spans (start, end) within a run of the class's characters that windows of high entropy cover."""
    weight, bound = F.array(*[F.lit(w) for w in weights(window)]), most(kind.bits, window)
    count = lambda held, x: F.length(held) - F.length(F.replace(held, x, F.lit("")))
    state = F.struct(F.lit("").alias("held"), F.lit(0).cast("long").alias("total"), F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = F.length(s["held"]) == window
        leaves = F.substring(s["held"], 1, 1)
        c = count(s["held"], leaves)
        gone = F.when(full, F.element_at(weight, c + 1) - F.element_at(weight, c)).otherwise(F.lit(0))
        rest = F.when(full, F.substring(s["held"], 2, window)).otherwise(s["held"])
        d = count(rest, x)
        total = s["total"] - gone + F.element_at(weight, d + 2) - F.element_at(weight, d + 1)
        return F.struct(F.concat(rest, x).alias("held"), total.cast("long").alias("total"), (s["at"] + 1).alias("at"), s["out"].alias("out"))

    def note(s: Column) -> Column:
        high = (F.length(s["held"]) == window) & (s["total"] <= bound)
        for need in kind.needs:
            high &= s["held"].rlike(need)
        before = F.try_element_at(s["out"], F.lit(-1))
        joins = F.coalesce(before["end"] >= s["at"] - window, F.lit(False))
        longer = lambda start: F.array(F.struct(start.alias("start"), s["at"].alias("end")))
        out = F.when(~high, s["out"]).when(joins, F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), longer(before["start"]))).otherwise(F.concat(s["out"], longer(s["at"] - window)))
        return F.struct(s["held"], s["total"], s["at"], out.alias("out"))

    # in two steps a character: the state moves on, then its window is judged; a lambda in a lambda names the first one's result
    moved = lambda s, x: F.element_at(F.transform(F.array(step(s, x)), note), 1)
    return F.aggregate(F.filter(F.split(run, ""), lambda x: x != ""), state, moved, lambda s: s["out"])


def class_spans(text: Column, kind: CharClass, window: int = WINDOW, allow_run: Sequence[str] = ALLOW_RUN, allow_before: Sequence[str] = ALLOW_BEFORE) -> Column:
    """Spans (start, end) of high entropy in the text's runs of the class, but for runs on the allow-list."""
    regex = f"[{kind.chars}]{{{window},}}"

    def of_run(x: Column) -> Column:
        run = F.substr(text, x["start"] + 1, x["end"] - x["start"])
        before = F.substr(text, F.greatest(x["start"] - 39, F.lit(1)), F.least(x["start"], F.lit(40)))
        allowed = F.lit(False)
        for a in allow_run:
            allowed |= run.rlike(a)
        for a in allow_before:
            allowed |= before.rlike(a)
        return F.when(allowed, F.array().cast(SPAN)).otherwise(F.transform(entropy_spans(run, kind, window), lambda s: F.struct((s["start"] + x["start"]).alias("start"), (s["end"] + x["start"]).alias("end"))))

    return F.flatten(F.transform(located(text, regex), of_run))


def scan(docs: DataFrame, patterns: Sequence[Pattern] = PATTERNS, classes: Sequence[CharClass] = CLASSES, window: int = WINDOW) -> DataFrame:
    """The documents with secret_base and secret_spans: arrays of (start, rank, kind, end), by start, then kind as listed.

    Base spans are the patterns'; the others are those and the windows' that lie in none of them.  Null and empty texts have none;
    positions are code points, ends exclusive.  Columns named as the added ones are replaced; others may have any name."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(spans: Column, kind: str, rank: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    kept = [c for c in docs.columns if c.lower() not in ("secret_base", "secret_spans")]
    base = F.concat(*[named(pattern_spans(text, p), p.kind, i) for i, p in enumerate(patterns)])
    more = F.concat(*[named(class_spans(text, c, window), c.kind, len(patterns) + i) for i, c in enumerate(classes)])
    found = tame(docs).select(*[F.col(f"`{c}`") for c in kept], F.array_sort(base).alias("secret_base"), more.alias("secret_spans"))
    new = F.filter("secret_spans", lambda x: ~F.exists("secret_base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    return found.withColumn("secret_spans", F.array_sort(F.concat("secret_base", new)))


def digest(scanned: DataFrame, key: str = "doc_id", patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """The key, n_<kind> of each pattern, base_sha256 and spans (kind:start:end, joined by commas)."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long")
    counts = [number(p.kind).alias(f"n_{p.kind}") for p in patterns]
    return scanned.select(F.col(f"`{key}`"), *counts, F.sha2(joined(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
