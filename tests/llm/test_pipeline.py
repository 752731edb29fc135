"""The pipeline against a plain version of its stages, and on rows of every kind."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crowdlens.llm import compression_lid, source_schedule

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, starts string, gone_id string, hit string, parts string"
ITEM = "Which of these seven rivers flows through the northern province before it reaches the shallow inland sea of the east"


def made():
    rng = random.Random(11)
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(400)] for lang, letters in (("aa", "etaoinsh"), ("bb", "rdlucmwk"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    passage = text("aa", 80)
    rows = [(i, text("aa" if i % 3 else "bb", rng.choice([30, 90, 200, 2500 if i == 7 else 60])), "aa" if i % 3 else "bb", None if i % 13 == 0 else f"s{i % 4}") for i in range(90)]
    edit = lambda t, n: " ".join(w if k % n else "changed" for k, w in enumerate(t.split(), 1))
    rows += [(100 + i, edit(rows[i][1], 70), rows[i][2], "s1") for i in range(6)]  # near copies
    rows += [(110, rows[3][1], "aa", "s2"), (111, rows[3][1], "aa", "s2"), (112, rows[4][1].upper(), "aa", "s0")]
    rows += [(120 + i, f"{text('aa', 60)} {passage} {text('aa', 40)}", "aa", "s3") for i in range(3)]
    rows += [(130, f"{text('aa', 50)} {ITEM}. {text('aa', 20)}", "aa", "s0"), (131, f"{text('bb', 30)} {ITEM.replace('seven', 'sevn').lower()}", "bb", "s0"), (132, f"{text('aa', 1500)} {ITEM} {text('aa', 1500)}", "aa", "s1")]
    rows += [(140, None, None, None), (141, "", "aa", "s1"), (142, "  \t", "aa", "s1"), (143, "12 34 !", None, "s1"), (None, text("aa", 70), "aa", "s1"), rows[5]]
    return [(*r, len(r[1] or ""), "x", None, "y", "z") for r in rows]


def plain(rows, samples):
    """doc_id and text of what the first four stages keep."""
    coder = compression_lid.Coder(samples)
    kept = [r for r in rows if not coder.best(r[1])[2]]

    def sets(t):
        w = WORDS.findall(t.lower())
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    own = [(r[0], r[1], sets(r[1])) for r in kept]
    group = {r[0]: r[0] for r in kept if r[0] is not None}
    changed = True
    links = [(a, b) for a, _, x in own for b, _, y in own if a is not None and b is not None and a < b and len(x & y) >= 0.8 * len(x | y) > 0]
    while changed:
        changed = False
        for a, b in links:
            least = min(group[a], group[b])
            changed |= group[a] != least or group[b] != least
            group[a] = group[b] = least
    kept = [(r[0], r[1]) for r in kept if r[0] is None or group[r[0]] == r[0]]

    first = {}
    for i, t in sorted((x for x in kept if x[0] is not None), key=lambda x: x[0]):
        w = WORDS.findall(t)
        for p in range(len(w) - 49):
            first.setdefault(tuple(w[p : p + 50]), i)
    left = []
    for i, t in kept:
        w = WORDS.findall(t)
        keep = [True] * len(w)
        for p in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[p : p + 50])] < i:
                keep[p : p + 50] = [False] * 50
        if all(keep):
            left.append((i, t))
        elif any(keep):
            left.append((i, " ".join(x for x, k in zip(w, keep) if k)))

    def distance(item, t):
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in t:
            old, row = row, [0]
            for k, x in enumerate(item, 1):
                row.append(min(old[k - 1] + (x != c), old[k] + 1, row[k - 1] + 1))
            best = min(best, row[-1])
        return best

    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    item = norm(ITEM)
    # a budget of 5 edits leaves one of 6 pieces whole, so that texts without any are clean
    pieces = [item[k * len(item) // 6 : (k + 1) * len(item) // 6] for k in range(6)]
    assert int(len(item) * 0.05) == 5
    return [(i, t) for i, t in left if not any(x in norm(t) for x in pieces) or distance(item, norm(t)) > 5]


def test_pipeline_equals_a_plain_version(spark, tmp_path):
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = plain(rows, compression_lid.learn(docs))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(i), len(WORDS.findall(t))) for i, t in want)
    ids = {r.doc_id for r in out}
    assert {110, 111, 112, 130, 131, 132, 140, 141, 142, 143}.isdisjoint(ids) and {120, 121, 122, 7, 8}.issubset(ids)
    # the mix of what is left, computed on its own
    left = spark.createDataFrame([(i, t, next(r[3] for r in rows if r[0] == i)) for i, t in want], "doc_id long, text string, source string")
    plain_mix = {(r.doc_id, r.taken) for r in source_schedule.mix(left).collect()}
    assert {(r.doc_id, r.taken) for r in out} == plain_mix


def test_pipeline_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_stage_keeps_further_columns(spark, tmp_path):
    docs = spark.createDataFrame(made()[:30], SCHEMA)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.where("starts = 'x' and gone_id is null and hit = 'y' and parts = 'z'").count() == out.count() > 0, name


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_keeps_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "size", "taken"} <= set(out.columns)
    n = out.count()
    assert 0.5 * docs.count() < n <= docs.count() and out.select("doc_id").distinct().count() == n
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    left = [i for (i,) in out.select("doc_id").where(F.col("size") > 0).collect()]
    assert not [i for i in left if any(b in texts[i] for b in benchmark)]
