"""Fill-in-middle transformation by succinct rank and select.

The units of a text (lines, words or code points) end at certain bytes.  These ends are the one bits of a packed bitvector over
the texts of an Arrow batch, with a directory of the one bits before each block of 512.  The number of one bits between a
text's first and last byte, two ranks, is its number of units n; the cuts after unit i and j are two selects.  No list of units
is ever made, so that a text needs an eighth more than its own memory, however many units it has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import SPACES, lean, pieces, tame, text_buffer, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "word", "char")
SEED, RATE, SPM = 7, 100, 50
_BLOCK = 8  # 64-bit words in a block of the directory


class BitVector:
    """Bits packed into 64-bit words, with a count of the one bits before each block of 512."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        room = (self.size // (64 * _BLOCK) + 1) * 8 * _BLOCK  # a whole block, and always one to end in
        self.words = np.pad(packed, (0, room - len(packed))).view("<u8")
        counts = np.bitwise_count(self.words).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """One bits before place i."""
        block, word = i >> 9, i >> 6
        out = self.before[block].copy()
        for k in range(_BLOCK - 1):  # whole words of the block
            at = (block << 3) + k
            out += np.where(at < word, np.bitwise_count(self.words[at]), 0)
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one bit number k, from 0."""
        block = np.searchsorted(self.before, k, "right") - 1
        left = k - self.before[block]
        inside = np.bitwise_count(self.words.reshape(-1, _BLOCK)[block]).astype(np.int64)
        upto = np.cumsum(inside, axis=1)
        word = (upto <= left[:, None]).sum(axis=1)
        left = left - np.take_along_axis(upto - inside, word[:, None], 1)[:, 0]
        at = (block << 3) + word
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return (at << 6) + (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)


def _ends(buf: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Whether each byte ends a unit: a line its line feed, a word the white space after it, a code point its last byte; and the
    last byte of each text ends one."""
    if unit == "line":
        ends = buf == 10
    elif unit == "word":
        space = np.isin(buf, np.frombuffer(SPACES, np.uint8))
        ends = space & ~np.append(space[1:], True)
    else:
        ends = np.append((buf[1:] & 0xC0) != 0x80, True)
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = True
    return ends


def fill_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, unit: str = "line", key: str = "doc_id") -> DataFrame:
    """The documents, all columns, with fim_units (n), fim_form, fim_prefix_chars, fim_middle_chars (code points) and fim_output.

    h1 to h4 are the first groups of 8 digits of the hex SHA-256 of seed:key.  The prefix ends after the smaller of h1 % (n+1)
    and h2 % (n+1) units, the middle after the larger.  Of 100 texts about `rate` are transformed, about `spm` of these with
    the suffix first.  A text that is null, empty or holds a mark stays plain, its lengths null; a null key counts as an empty
    one.  Equal rows get equal results.  Columns named as the added ones are replaced; others may have any name."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    added = [T.StructField("fim_units", T.LongType()), T.StructField("fim_form", T.StringType()), T.StructField("fim_prefix_chars", T.LongType()), T.StructField("fim_middle_chars", T.LongType()), T.StructField("fim_output", T.StringType())]
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in added}]
    hash_ = unused("hash", docs.columns)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    groups = F.array(*[F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, "text"):
                get = {f.name: b.column(i) for i, f in enumerate(b.schema)}
                buf, offsets = text_buffer(get["text"])
                h = get[hash_].flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                n, cuts = _cuts(buf, offsets, h[:, :2], unit)
                form, before, inside, out = [], [], [], []
                for i in range(b.num_rows):
                    text = buf[offsets[i] : offsets[i + 1]].tobytes()
                    x, y = (int(c - offsets[i]) for c in cuts[i])
                    if not text or h[i, 2] % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        form.append("plain")
                        before.append(None)
                        inside.append(None)
                        out.append(text)
                        continue
                    parts = {PREFIX: text[:x], MIDDLE: text[x:y], SUFFIX: text[y:]}
                    form.append("spm" if h[i, 3] % 100 < spm else "psm")
                    before.append(_chars(parts[PREFIX]))
                    inside.append(_chars(parts[MIDDLE]))
                    order = (SUFFIX, PREFIX, MIDDLE) if form[-1] == "spm" else (PREFIX, SUFFIX, MIDDLE)
                    out.append(b"".join(m.encode() + parts[m] for m in order))
                new = {"fim_units": pa.array(n, pa.int64()), "fim_form": pa.array(form, pa.string()), "fim_prefix_chars": pa.array(before, pa.int64()), "fim_middle_chars": pa.array(inside, pa.int64()), "fim_output": pa.array(out, pa.binary()).cast(pa.string(), safe=False)}
                yield pa.RecordBatch.from_arrays([new.get(c, get.get(c)) for c in [*kept, *new]], [*kept, *new])

    fields = [docs.schema[c] for c in kept] + added
    return tame(docs).select(*[F.col(f"`{c}`") for c in kept], groups.alias(hash_)).mapInArrow(lean(run), T.StructType(fields))


def _chars(part: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(part, np.uint8) & 0xC0 != 0x80))


def _cuts(buf: np.ndarray, offsets: np.ndarray, h: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The units of each text, and the bytes at which its prefix and its middle end."""
    bits = BitVector(_ends(buf, offsets, unit)) if len(buf) else BitVector(np.zeros(0, bool))
    rank = bits.rank(offsets)
    n = np.diff(rank)
    units = np.sort(h % (n[:, None] + 1), axis=1)
    wanted = units + rank[:-1, None]  # ends before the cut, counted from the batch's first byte
    cuts = np.repeat(offsets[:-1, None], 2, axis=1)
    inner = units > 0
    cuts[inner] = bits.select(wanted[inner] - 1) + 1
    return n, cuts


def restored(output: str | Column = "fim_output", form: str | Column = "fim_form") -> Column:
    """The text again.  Marks are found from the left: the parts hold none, and as only a mark's first character is <, no end of a
    part and beginning of a mark together form another."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def parts(first: str, second: str, third: str) -> dict[str, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, third, 1)
        return {first: a, second: b, third: F.substr(rest, F.length(b) + len(third) + 1)}

    whole = lambda p: F.concat(p[PREFIX], p[MIDDLE], p[SUFFIX])
    return F.when(form == "psm", whole(parts(PREFIX, SUFFIX, MIDDLE))).when(form == "spm", whole(parts(SUFFIX, PREFIX, MIDDLE))).otherwise(output)


def digest(filled: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, n, form, prefix_chars, middle_chars, and hex SHA-256 of output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select(F.col(f"`{key}`"), F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), sha(F.col("fim_output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
