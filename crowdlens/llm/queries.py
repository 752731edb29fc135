"""The operators' registered queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, compression_lid, edit_match, lsh_forest, middle_fill, nn_descent, recompression, secret_scan, site_template, source_schedule, spelling_variants, suffix_tree, zip_archive
from .shared import hashed_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return suffix_tree.score_texts(docs, hashed_fold("doc_id", 7, 2))


def op2_site_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.extract_pages(_table(spark, sf_dir, "pages"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.format_chats(turns.unionByName(more)))


def op5_edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_match.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_zip_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_archive.archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.similar(_table(spark, sf_dir, "documents")).drop("body")


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_schedule.mix(_table(spark, sf_dir, "documents")).drop("source")


def op10_compression_lid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = hashed_fold("doc_id", 4, 2)
    found = compression_lid.identify(docs.select("doc_id", "text"), compression_lid.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op11_middle_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_fill.digest(middle_fill.fill_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"), drop_every=31)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_tree, op2_site_template, op3_nn_descent, op4_chat_format, op5_edit_match, op6_zip_archive, op7_lsh_forest, op8_recompression, op9_source_schedule, op10_compression_lid, op11_middle_fill, op12_spelling_variants, op13_secret_scan)}

def _secret_sql() -> str:
    """Matches located by the pieces between them, and windows each counted anew."""
    kinds = [(p.kind, i, p.regex, p.group, p.least) for i, p in enumerate(secret_scan.PATTERNS)]
    classes = [(c.kind, len(kinds) + i, f"[{c.chars}]{{{secret_scan.WINDOW},}}", secret_scan.most(c.bits), c.needs) for i, c in enumerate(secret_scan.CLASSES)]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    hits = " UNION ALL ".join(f"SELECT k, text, {quoted(kind)} AS kind, {rank} AS rank, string_split_regex(text, {quoted(regex)}) AS gaps, regexp_extract_all(text, {quoted(regex)}) AS hits, regexp_extract_all(text, {quoted(regex)}, {group}) AS parts, {least} AS least FROM t WHERE regexp_matches(text, {quoted(regex)})" for kind, rank, regex, group, least in [*kinds, *[(*c[:3], 0, secret_scan.WINDOW) for c in classes]])
    allowed = " OR ".join([*[f"regexp_matches(hit, {quoted(a)})" for a in secret_scan.ALLOW_RUN], *[f"regexp_matches(text[greatest(a - 39, 1) : a], {quoted(a)})" for a in secret_scan.ALLOW_BEFORE]])
    judged = " OR ".join(f"(kind = {quoted(kind)} AND total <= {bound}" + "".join(f" AND regexp_matches(w, {quoted(n)})" for n in needs) + ")" for kind, _, _, bound, needs in classes)
    n = secret_scan.WINDOW
    return rf"""
        WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
        m AS ({hits}),
        x AS (SELECT k, text, kind, rank, least, unnest(hits) AS hit, unnest(gaps[1 : len(hits)]) AS gap, unnest(parts) AS part, generate_subscripts(hits, 1) AS i FROM m),
        l AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY k, kind ORDER BY i) AS BIGINT) AS b FROM x),
        s AS (SELECT *, b - length(hit) AS a FROM l WHERE length(part) >= least),
        base AS (SELECT k, kind, rank, a, b FROM s WHERE rank < {len(kinds)}),
        c AS (SELECT k, kind, rank, a, unnest(generate_series(0, length(hit) - {n})) AS j, hit FROM s WHERE rank >= {len(kinds)} AND NOT ({allowed})),
        v AS (SELECT *, hit[j + 1 : j + {n}] AS w, list_sum(list_transform(list_distinct(string_split(hit[j + 1 : j + {n}], '')), lambda u: {secret_scan.weights()}[length(hit[j + 1 : j + {n}]) - length(replace(hit[j + 1 : j + {n}], u, '')) + 1])) AS total FROM c),
        h AS (SELECT *, coalesce(j - lag(j) OVER (PARTITION BY k, kind, a ORDER BY j) > {n}, TRUE) AS fresh FROM v WHERE {judged}),
        g AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY k, kind, a ORDER BY j) AS g FROM h),
        more AS (SELECT k, kind, rank, a + min(j) AS a, a + max(j) + {n} AS b FROM g GROUP BY k, kind, rank, a, g),
        every AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.k = more.k AND base.a <= more.a AND base.b >= more.b)),
        o AS (SELECT k, {", ".join(f"count(*) FILTER (kind = {quoted(kind[0])}) AS n_{kind[0]}" for kind in kinds)},
                     coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(kinds)}), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM every GROUP BY k)
        SELECT doc_id, {", ".join(f"coalesce(n_{kind[0]}, 0) AS n_{kind[0]}" for kind in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN o USING (k)"""


ORACLE: dict[str, str] = {
    "op3_nn_descent": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT x AS id, y AS other FROM l UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.other),
        c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
        FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.id = vec_id""",
    "op7_lsh_forest": r"""
        WITH RECURSIVE t AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * common >= 8 * (a.n + b.n - common)),
        r AS (SELECT x AS id, y AS other FROM l UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.other),
        p AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY id), k AS (SELECT x, count(*) AS links FROM l GROUP BY x)
        SELECT doc_id, CASE WHEN len(w) > 0 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS class_id, coalesce(links, 0) AS n_links,
               coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
        FROM t LEFT JOIN k ON k.x = doc_id LEFT JOIN p ON p.id = doc_id""",
    "op4_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        -- what the template adds: its own characters, and a backslash for each escaped one
        s AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\|]', '', 'g')) + length(text) + length(text) - length(replace(text, '\', ''))
                     + length(text) - length(replace(text, '<|', '<')) + CASE WHEN starts_with(text, '|') THEN 1 ELSE 0 END + length('<|turn:|><|end|>') + 1 AS n FROM t),
        a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
                     coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a""",
    "op6_zip_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest FROM p),
        f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= 100 AND page_id IS NOT NULL GROUP BY digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f USING (digest)""",
    "op8_recompression": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS p FROM t WHERE len(w) >= 50),
        h AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) AS h FROM s),
        m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
        r AS (SELECT doc_id, list(p) AS ps FROM h JOIN m USING (h) WHERE doc_id > least GROUP BY doc_id),
        e AS (SELECT doc_id, p + unnest(generate_series(0, 49)) AS i FROM h JOIN m USING (h) WHERE doc_id > least),
        g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM e GROUP BY doc_id),
        k AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN g USING (doc_id))
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' ')) AS kept_sha256
        FROM k""",
    "op11_middle_fill": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS w, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i : i + 7] AS BIGINT)) AS r FROM t),
        c AS (SELECT *, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b FROM u),
        p AS (SELECT *, array_to_string(w[1 : a], '') AS pre, array_to_string(w[a + 1 : b], '') AS mid, array_to_string(w[b + 1 :], '') AS suf,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE bits(i, b, c) AS (SELECT i, 0, CAST(i AS UBIGINT) FROM range(256) r(i) UNION ALL SELECT i, b + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE b < 8),
        tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE b = 8),
        runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        freq AS (SELECT id, w, count(*) AS times FROM runs WHERE length(w) >= 7 GROUP BY ALL),
        raw AS (SELECT *, list_transform(string_split(id || ':' || w, ''), lambda c: unicode(c)) AS codes FROM freq),
        h AS (SELECT w, times, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(flatten(list_transform(codes, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END)), lambda b: b::UBIGINT)),
                     lambda s, b: xor(s >> 8, tab[1 + (xor(s, b) & 255)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h FROM raw, tab),
        d AS (SELECT CASE WHEN h % 31 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, times FROM h),
        k AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
        m AS (SELECT word, n, p, word[1 : p - 1] || word[p + 1 :] AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS p FROM k)),
        e AS (SELECT a.word AS x, b.word AS y, b.n FROM m a JOIN m b ON a.less = b.less AND a.p = b.p WHERE a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM m a JOIN k b ON b.word = a.less UNION SELECT b.word, a.word, a.n FROM m a JOIN k b ON b.word = a.less),
        f AS (SELECT x, count(*) AS n_near, min((-n, encode(y))) AS best FROM e GROUP BY x),
        g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 10 * n THEN decode(best[2]) END AS form, CASE WHEN -best[1] >= 10 * n THEN -best[1] END AS form_n FROM k LEFT JOIN f ON x = word),
        r(word, node, depth) AS (SELECT word, word, 0 FROM g UNION ALL SELECT r.word, g.form, depth + 1 FROM r JOIN g ON g.word = r.node WHERE g.form IS NOT NULL)
        SELECT g.word, form, root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM g JOIN (SELECT word, arg_max(node, depth) AS root FROM r GROUP BY word) USING (word)""",
    "op13_secret_scan": _secret_sql(),
}
