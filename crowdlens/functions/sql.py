"""The extractors as functions of SQL (U3).  Their bodies are SQL, so that a query that calls them is planned as if it spelt them
out: no Python, and with `LATERAL explode(...)` no join either."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from .text import TERM_STOP, is_phrase


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def terms_body(stop: Iterable[str] = TERM_STOP) -> str:
    """X8 as SQL over `t`: see text.terms."""
    words = ", ".join(quoted(w) for w in stop) or "''"
    kept = f"transform(regexp_extract_all(lower(coalesce(t, '')), '[a-z][a-z0-9]{{2,}}', 0), w -> CASE WHEN w NOT IN ({words}) THEN w END)"
    rest = "greatest(size(k) - 1, 0)"
    pairs = f"zip_with(slice(k, 1, {rest}), slice(k, 2, {rest}), (a, b) -> concat(a, ' ', b))"
    return f"element_at(transform(array({kept}), k -> array_distinct(array_compact(concat(k, {pairs})))), 1)"


def themes_body(keywords: Mapping[str, Iterable[str]]) -> str:
    """X7 as SQL over `t`: the sorted themes of which a word is among the tokens or a phrase in the lower-case text."""
    lists = [{"theme": k, "words": [w for w in ws if not is_phrase(w)], "phrases": [w for w in ws if is_phrase(w)]} for k, v in sorted(keywords.items()) for ws in [sorted({w.lower() for w in v} - {""})]]
    table = f"from_json({quoted(json.dumps(lists))}, 'array<struct<theme:string,words:array<string>,phrases:array<string>>>')"
    found = f"transform(filter({table}, x -> arrays_overlap(x.words, p.words) OR exists(x.phrases, y -> contains(p.low, y))), x -> x.theme)"
    return f"element_at(transform(array(named_struct('low', lower(coalesce(t, '')), 'words', regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+', 0))), p -> {found}), 1)"


def register(spark: SparkSession, keywords: Mapping[str, Iterable[str]], stop: Iterable[str] = TERM_STOP) -> None:
    """Defines terms_in_text(text) and themes_in_text(text) -> array<string> for the session; null counts as empty.

        SELECT doc_id, term FROM (SELECT doc_id, terms_in_text(text) AS found FROM documents), LATERAL explode(found) AS x(term)
    """
    for name, body in (("terms_in_text", terms_body(stop)), ("themes_in_text", themes_body(keywords))):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS ARRAY<STRING> RETURN {body}")
