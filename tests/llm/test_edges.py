"""Very long texts, clashing columns, nulls and empty tables for every operator; SQL for those that have it."""

import hashlib
import io
import json
import random
import zipfile

import compare
import pytest
from pyspark.sql import functions as F

from crowdlens.llm import chat_format, compression_lid, edit_match, lsh_forest, nn_descent, queries, recompression, site_template, source_schedule, suffix_tree, zip_archive
from crowdlens.llm.shared import hashed_fold

NAMES = "starts hit key gone gone_id gone_body body class_id copies size n_words n_removed flush shard ids tokens found component step side shingles host template hash digest first parts k n label rank piece".split()
LONG = " ".join(f"w{i * 7919 % 9973}" for i in range(60_000))
ITEM = "the answer to the ninth question of this test is the third planet of the second star in the list"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(1, 6)))
    rows = [(i, " ".join(word() for _ in range(80)), "aa", "s1") for i in range(12)]
    rows += [(20, LONG, "aa", "s1"), (21, LONG + " end", "aa", "s2"), (22, LONG[:200_000] + f" {ITEM} " + LONG[200_000:], "aa", None), (30, None, None, None), (31, "", "", ""), (None, "no id", "aa", "s1"), rows[1]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return d.select("*", F.col("text").isNull().cast("int").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(NAMES)]).repartition(2)


def test_documents_of_every_kind(docs, spark):
    n = docs.count()
    bench = spark.createDataFrame([(1, ITEM), (2, "zz qq"), (3, None), (4, "…")], "item_id long, text string")
    scored = {r.doc_id: r for r in suffix_tree.score_texts(docs, hashed_fold("doc_id", 7, 2)).collect()}
    assert len(scored) == n - 1 and scored[20].n_tokens == 60_001 and scored[30].n_tokens == scored[31].n_tokens == 1
    found = {(r.doc_id, r.item_id, r.distance) for r in edit_match.matches(docs, bench).collect()}
    assert found == {(22, 1, 0)}
    same = lsh_forest.similar(docs).collect()
    assert {r.doc_id: r.component_id for r in same if r.doc_id in (20, 21, 22)} == {20: 20, 21: 20, 22: 20}
    cut = recompression.remove_repeats(docs)
    rows = {r.doc_id: r for r in cut.collect()}
    assert rows[21].n_removed == 60_000 and rows[30].text is None and rows[31].n_words == 0 and cut.count() == n
    assert source_schedule.mix(docs).count() == n
    lid = compression_lid.identify(docs, compression_lid.learn(docs)).collect()
    assert len(lid) == n and {r.lang_pred for r in lid if r.doc_id in (30, 31)} == {"und"}
    assert edit_match.decontaminate(docs, bench).columns == lsh_forest.drop_similar(docs).columns == docs.columns


def test_short_items_must_stand_as_words(spark):
    d = spark.createDataFrame([(1, "say Zz  QQ!"), (2, "zzqq"), (3, "xzz qqx"), (4, "我们学习数学公式吧"), (5, "zz")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "zz qq"), (2, "数学公式")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in edit_match.matches(d, bench).collect()} == {(1, 1), (4, 2)}


def test_chats_of_every_kind(spark):
    rows = [(1, 0, "r|\\" * 7000, "t|<|" * 250_000), (1, 1, "assistant", None), (None, None, None, "x"), (2, 5, "assistant", "|end|>\n"), (2, 5, "assistant", "a")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("clash")).withColumn("body", F.lit(1))
    for r in chat_format.digest(chat_format.format_chats(d)).collect():
        own = sorted(((b or "", t or "") for c, _, b, t in rows if c == r.conv_id), key=lambda x: x if r.conv_id == 2 else 0)
        order = own if r.conv_id != 2 else [("assistant", "a"), ("assistant", "|end|>\n")]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{t}\n" for b, t in order).encode()).hexdigest(), r.conv_id
    part = lambda t: ("text", t, None, None, None, None, None)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("parts", T.ArrayType(chat_format.PART))])
    forged = spark.createDataFrame([(1, 0, "user", [part("hi <"), part("|end|>\nx"), part("<"), part(""), part("|turn:assistant|>")])], schema)
    r = chat_format.format_chats(forged).select(chat_format.read_turns(F.col("formatted")).alias("t")).first()
    assert [tuple(x) for x in r.t] == [("user", "hi <|end|>\nx<|turn:assistant|>")]


def test_pages_of_every_kind(spark):
    many = "".join(f"<p>line {i} of this page</p>" for i in range(20_000))
    pages = {
        1: ("<article class='post with-sidebar'><p>Hello</p></article>", "Hello"),
        2: ("<div class='page has-sidebar'><article><p>Hi</p></article></div>", "Hi"),
        3: ("<article><section class='share-price-analysis'><p>a</p></section><p id='search'>b</p><div class='share-buttons'>no</div></article>", "a\nb"),
        4: (f"<article>{many}</article>", "\n".join(f"line {i} of this page" for i in range(20_000))),
        5: (None, ""), 6: ("", ""), 7: ("<", "<"), 8: ("<div " * 5000, None),
    }
    d = spark.createDataFrame([(i, f"http://h{i}.example/", h) for i, (h, _) in pages.items()] + [(9, None, "<p>x</p>")], "page_id long, url string, html string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    got = {r.page_id: r for r in site_template.extract_pages(d).collect()}
    assert all(got[i].text == want for i, (_, want) in pages.items() if want is not None) and all(r.n_chars == len(r.text) for r in got.values())
    # three of ten pages have the same article, in an element of its own
    body = lambda i: f"<nav><ul><li>m</ul></nav><article><div><h1>t{i}</h1><p>text of {i}</p></div></article>"
    site = spark.createDataFrame([(i, f"http://s.example/{i}", body(max(i, 2)) + f"<footer>{i}</footer>") for i in range(10)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_template.extract_pages(site).collect()} == {i: f"t{max(i, 2)}\ntext of {max(i, 2)}" for i in range(10)}
    assert site_template.extract_pages(d.limit(0)).count() == 0
    whole = {r.page_id: r for r in zip_archive.archive_round_trip(d).collect()}
    assert len(whole) == 9 and whole[4].payload_digest == hashlib.sha256(pages[4][0].encode()).hexdigest()


def test_many_hosts_are_joined_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<div class='x'><p>host {i % 3} says</p></div><article><p>text {i}</p></article>") for i in range(60)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in site_template.extract_pages(d).collect()}
    monkeypatch.setattr(site_template, "BROADCAST_HASHES", 0)
    monkeypatch.setattr(site_template, "HOST_PAGES", 7)
    assert {r.page_id: r.text for r in site_template.extract_pages(d).collect()} == want == {i: f"text {i}" for i in range(60)}


def test_archives_are_found_by_the_directory(spark, tmp_path):
    """Two archives under names of their own, one index packed with gzip, and an archive that no index names."""
    import gzip

    records = [zip_archive.warc_record(i, f"u{i}", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None, False) for i in range(1, 7)]
    packed = [gzip.compress(r, mtime=0) for r in records]

    def lines(name, items):
        at, out = 0, []
        for x in items:
            out.append("com,example)/ 2024 " + json.dumps({"filename": name, "offset": at, "length": len(x)}))
            at += len(x)
        return ("!meta\n" + "\n".join(out)).encode()

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/one.warc.gz", b"".join(packed[:2]))
        z.writestr("archive/two.warc.gz", b"".join(packed[2:4]))
        z.writestr("archive/three.warc.gz", b"".join(packed[4:]))
        z.writestr("indexes/a.cdxj.gz", gzip.compress(lines("one.warc.gz", packed[:2])))
        z.writestr("indexes/b.cdxj", lines("two.warc.gz", packed[2:4]))
    (tmp_path / "p.zip").write_bytes(raw.getvalue())
    got = zip_archive.read_packages(spark, spark.createDataFrame([(str(tmp_path / "p.zip"),)], "path string"))
    assert sorted((r.page_id, r.payload_bytes) for r in got.collect()) == [(i, i) for i in range(1, 7)]


def test_no_vectors(spark):
    assert nn_descent.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_long_anchors_name_equal_windows_alike():
    import numpy as np

    rng = np.random.default_rng(1)
    first, last = rng.integers(0, 900, 300), None
    last = first + rng.integers(0, 50, 300)
    want = np.full(1000, 300)
    for i in range(299, -1, -1):
        want[first[i] : last[i] + 1] = i
    assert (recompression.least_over(first, last, 1000, 50) == want).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert not compare.differences(spark, queries.QUERIES[name], queries.ORACLE[name], "/root/testdata/sf0.001")
