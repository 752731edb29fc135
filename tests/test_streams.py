"""Streams that stop, fail and resume: the fold's log and ledger, flips in shuffled batches, the paged source."""

import datetime as dt
import json
import random

import pages_stub
import pytest
from pyspark.sql import functions as F

from crowdlens.functions import text
from crowdlens.operators import series as ts
from crowdlens.sources import manifest, paged, store
from crowdlens.streaming import fold, state

D = dt.date
POSTS = "id string, date date, t string"


def counted(spark, folder):
    return {(str(r.date), r.ticker): r.mention_count for r in fold.folded_counts(spark, folder).collect()}


def test_a_batch_killed_anywhere_counts_once(spark, tmp_path, monkeypatch):
    folder, symbols = str(tmp_path / "f"), text.cashtags(F.col("t"))
    batches = [spark.createDataFrame([(f"{i}", D(2024, 1, 1 + i % 3), "$GME $AMC" if i % 2 else "$GME") for i in range(a, b)] + [(None, D(2024, 1, 1), "$X"), ("n", None, "$X")], POSTS) for a, b in ((0, 10), (5, 15), (12, 20))]
    real, calls = manifest.write_part, []

    def failing(rows, *args, **facts):  # fails once at each step: before the counts, before the ids, before the version
        calls.append(1)
        if len(calls) in (1, 3, 6):
            raise OSError("killed")
        return real(rows, *args, **facts)

    monkeypatch.setattr(manifest, "write_part", failing)
    for i, b in enumerate(batches):
        for _ in range(3):
            try:
                fold.fold_batch(b, i, folder, symbols)
                break
            except OSError:
                assert manifest.load(spark, folder)["batch"] == i - 1
    monkeypatch.setattr(manifest, "write_part", real)
    fold.fold_batch(batches[2], 2, folder, symbols)  # done, but the checkpoint doesn't know
    posts = [(D(2024, 1, 1 + i % 3), i) for i in range(20)]
    want = {(str(d), "GME"): sum(x == d for x, _ in posts) for d, _ in posts} | {(str(d), "AMC"): sum(x == d and i % 2 for x, i in posts) for d, _ in posts}
    assert counted(spark, folder) == want
    assert manifest.vacuum(spark, folder, 1) and counted(spark, folder) == want


def test_live_start_is_frozen(spark, tmp_path):
    folder = str(tmp_path / "f")
    old = spark.createDataFrame([(D(2024, 1, 2), 5)], "date date, mention_count long")
    rows = spark.createDataFrame([("1", D(2024, 1, 2), "$A"), ("2", D(2024, 1, 3), "$A")], POSTS)
    fold.start(spark, folder, old)
    fold.start(spark, folder, old.select(F.lit("2030-01-01").cast("date").alias("date")))
    fold.fold_batch(rows, 0, folder, text.cashtags(F.col("t")))
    assert counted(spark, folder) == {("2024-01-03", "A"): 1}


def test_the_ledger_stays_bounded(spark, tmp_path):
    folder, symbols = str(tmp_path / "f"), text.cashtags(F.col("t"))
    read = []
    for i in range(24):
        rows = spark.createDataFrame([(f"{k}", D(2024, 1, 1), "$A") for k in (3 * i, 3 * i + 1, 3 * i + 2, 3 * i - 1)], POSTS).where("id <> '-1'").coalesce(1)
        now = fold.fold_batch(rows, i, folder, symbols, most=9)
        assert len(now["ledger"]) <= fold.PARTS and len(now["parts"]) <= fold.PARTS
        read.append(fold.ledger(spark, folder, now, 9).count())
    # the repeated id of the batch before is always known
    assert counted(spark, folder) == {("2024-01-01", "A"): 72} and max(read) <= 9 + 3 and read[-1] == read[5]
    old = spark.createDataFrame([("0", D(2024, 1, 1), "$A")], POSTS)
    fold.fold_batch(old, 24, folder, symbols, most=9)
    assert counted(spark, folder) == {("2024-01-01", "A"): 73}  # so old an id is forgotten, as the bound says


def test_flips_in_shuffled_batches_equal_the_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(e, D(2024, 1, 1) + dt.timedelta(i), rng.gauss(0, 1) if i % 5 else None) for e in ("a", "b", "c") for i in range(120)]
    table = ts.levelled(spark.createDataFrame(rows, "e string, date date, x double"), "e", 0.5).collect()
    want = sorted(map(tuple, ts.flips(spark.createDataFrame(rows, "e string, date date, x double"), eps=0.5, gap=6).collect()))
    rng.shuffle(table)
    schema = "e string, date date, x double, level double"
    for i in range(4):
        spark.createDataFrame([tuple(r) for r in table[i::4]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def run():
        q = state.flips(stream, gap=6, late="200 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    state.rocksdb_state(spark)
    try:
        run()
        # the end of the days: a row far on moves the watermark, in a run that resumes from the checkpoint
        spark.createDataFrame([("end", D(2034, 1, 1), 9.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted((e, d, s) for e, d, s in got) == [(e, d, s) for e, d, s in want] and len(want) > 20


def test_months():
    at = lambda *d: int(dt.datetime(*d, tzinfo=dt.timezone.utc).timestamp())
    assert list(paged.months(at(2023, 11, 5), at(2024, 1, 2))) == [(at(2023, 11, 5), at(2023, 12, 1)), (at(2023, 12, 1), at(2024, 1, 1)), (at(2024, 1, 1), at(2024, 1, 2))]
    assert list(paged.months(5, 5)) == []


def test_paged_stream_resumes_without_loss_or_repeats(spark, tmp_path):
    spark.dataSource.register(paged.PagedPosts)
    spark.sparkContext.addPyFile(pages_stub.__file__)

    def run(queries, before):
        stream = spark.readStream.format("paged_posts").options(fetch="pages_stub:fetch", queries=json.dumps(queries), after="0", before=str(before), page="100", wait="0").load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.query, r.id) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    every = lambda before, *queries: sorted((q, r["id"]) for q in queries for r in pages_stub.records(q) if r["created_utc"] < before)
    assert run(["a"], 2000) == every(2000, "a")
    assert run(["a"], 2000) == every(2000, "a")
    assert run(["a", "b"], 10**6) == every(10**6, "a", "b")


def test_a_failed_append_leaves_the_store_readable(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    post = lambda i, s="x": (f"{i}", D(2024, 1, 1), "a", 0, "s", f"title {i}", "", 0, s)
    frame = lambda rows: spark.createDataFrame(rows, store.POSTS)
    assert store.append(frame([post(1), post(2)]), folder) == 2
    real = manifest.commit
    monkeypatch.setattr(manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.append(frame([post(3)]), folder)
    monkeypatch.setattr(manifest, "commit", real)
    assert sorted(r.id for r in store.read(spark, folder).collect()) == ["1", "2"]
    stale = manifest.load(spark, folder)
    assert store.append(frame([post(2), post(3), post(4, "y")]), folder) == 2
    with pytest.raises(manifest.Conflict):  # another writer that began from the version before
        manifest.commit(spark, folder, stale)
    store.replace_sources(frame([post(9, "y")]), folder)
    assert sorted(r.id for r in store.read(spark, folder).collect()) == ["1", "2", "3", "9"]
    assert sorted(r.id for r in store.read(spark, folder, 2).collect()) == ["1", "2", "3", "4"]
    assert len(manifest.vacuum(spark, folder, 1)) == 1 and store.read(spark, folder).count() == 4
