"""Language ID by compression: a text belongs to the language whose dictionary and sample shorten it most.

Each language gets a zstandard raw-content dictionary of labelled text and a few slices more.  A text of any length is cut into
blocks of BLOCK bytes; every block is encoded behind each slice with the dictionary, and what the block adds to the output counts.
The slice primes the coder's letter statistics, so that letters cost what they cost in that language.  Texts for which the sums are
nearly equal in two languages are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import lean, tame

#: Bytes of labelled text per language: the dictionary and the slices behind which blocks are encoded.
DICTIONARY, SLICES, SLICE = 64 << 10, 2, 4 << 10
#: The training sample: about so many labelled rows per language, drawn by a hash of the id, and of all pieces of PIECE characters
#: of their whole texts, PIECES per language, drawn by a hash too.
SAMPLE_ROWS, PIECE, PIECES = 400, 256, 400
BLOCK = 16 << 10
#: A text is rejected if the second-best size exceeds the best by less than this share.
MARGIN = 0.01
#: Scale of the score: relative excess sizes are turned into weights exp(-excess / TEMPERATURE).
TEMPERATURE = 0.02
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """Lower case, and what isn't a letter as one space; empty if no letter is left."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return f" {out} ".encode("utf-8", "replace") if out else b""


def learn(docs: DataFrame, allowed: Column | None = None) -> dict[str, bytes]:
    """A sample for each non-null language of the allowed rows: at most DICTIONARY + SLICES * SLICE bytes, from about SAMPLE_ROWS
    rows of each.

    Which rows and pieces are drawn follows from doc_id alone.  Languages, 100 KB each, must fit the driver.  Null texts, null
    languages and texts without letters teach nothing; other columns are ignored."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if allowed is not None:
        rows = rows.where(allowed)
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return {}
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1.0, SAMPLE_ROWS / v))])
    drawn = rows.where(unit < share[F.col("lang")]).select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("no", "piece"))
    order = [F.xxhash64(F.col("doc_id").cast("string"), "no"), F.col("no"), F.col("piece")]
    best = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= PIECES).select("lang", "rank", "piece").collect()
    parts: dict[str, list[bytes]] = {k: [] for k in sorted(n)}
    for r in sorted(best, key=lambda r: (r.lang, r.rank)):
        parts[r.lang].append(letters(r.piece))
    return {k: b"".join(x)[: DICTIONARY + SLICES * SLICE] for k, x in parts.items()}


class Coder:
    """Sizes of a text under each language."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = list(samples)
        self.coders = []
        for raw in samples.values():
            own = min(SLICE, len(raw) // 3 // SLICES)  # a small sample is shared out
            at = len(raw) - own * SLICES
            coder = self._encoder(raw[:at])
            slices = [raw[at + i * own : at + (i + 1) * own] for i in range(SLICES)]
            self.coders.append((coder, [(s, len(coder.compress(s))) for s in slices]))

    @staticmethod
    def _encoder(raw: bytes) -> zstd.ZstdCompressor:
        raw = raw if len(raw) >= 8 else raw + b"        "  # the library refuses less than 8 bytes
        params = zstd.ZstdCompressionParameters.from_level(5, source_size=BLOCK + SLICE, dict_size=len(raw), write_content_size=0, write_checksum=0, write_dict_id=0, min_match=3)
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        return zstd.ZstdCompressor(dict_data=d, compression_params=params)

    def sizes(self, raw: bytes) -> np.ndarray:
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return np.array([sum(len(c.compress(s + b)) - alone for b in blocks for s, alone in slices) / SLICES for c, slices in self.coders])

    def best(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is rejected."""
        raw = letters(text or "")
        if not self.langs or not raw:
            return UNKNOWN, 0.0, True
        size = np.maximum(self.sizes(raw), 0.25)
        order = np.argsort(size, kind="stable")
        weights = np.exp(-(size / size[order[0]] - 1) / TEMPERATURE)
        narrow = len(size) > 1 and size[order[1]] < size[order[0]] * (1 + MARGIN)
        return self.langs[order[0]], float(1 / weights.sum()), bool(narrow)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows with lang_pred, lang_score and lang_rejected added; columns of these names are replaced.

    Null texts, texts without a letter and any text where no language was learned: 'und', score 0, rejected.  Ties go to
    the language that is first by code point."""
    added = ["lang_pred", "lang_score", "lang_rejected"]
    kept = [c for c in docs.columns if c.lower() not in added]
    docs = tame(docs).select(*[F.col(f"`{c}`") for c in kept])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            found = [coder.best(t.as_py()) for t in b.column(b.schema.get_field_index(text))]
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*kept, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()), T.StructField(added[2], T.BooleanType())])
    return docs.mapInArrow(lean(run), schema)
