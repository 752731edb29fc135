"""Windows over streams, files, cursors and the state of single entities."""

import datetime as dt

import pytest

from crowdlens.operators import frames as fr
from crowdlens.sources import files
from crowdlens.streaming import windows as win


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, "ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * (i // 2))) for i in range(60)] + [(3, "b", dt.datetime(2024, 1, 1, 7))]
    table = spark.createDataFrame(rows, "id long, e string, ts timestamp")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")

    def drained(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()))

    for name, f in (("tumbling", win.tumbling), ("sliding", win.sliding), ("sessions", lambda d, e: win.sessions(d, e, gap="2 days"))):
        assert drained(f(stream(), "e"), name) == sorted(map(tuple, f(table, "e").collect())), name
    assert len(drained(win.without_repeats(stream()), "once", "append")) == win.without_repeats(table).count() == 60


def test_cooldown_keeps_its_state_between_batches(spark, tmp_path):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    spark.createDataFrame([("x", day(n)) for n in (0, 9, 21)], "e string, date date").coalesce(1).write.parquet(f"{tmp_path}/in/b=1")
    spark.createDataFrame([("x", day(n)) for n in (41, 42)] + [("y", day(1))], "e string, date date").coalesce(1).write.parquet(f"{tmp_path}/in/b=2")
    kept = []
    for b in (1, 2):
        stream = spark.readStream.schema("e string, date date").parquet(f"{tmp_path}/in/b={b}" if b == 1 else f"{tmp_path}/in/b=*")
        if b == 2:  # both files in one stream, one a batch, in the order of their names
            stream = spark.readStream.schema("e string, date date").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b=*")
        q = win.cooldown(stream).writeStream.foreachBatch(lambda d, i: kept.append(sorted(map(tuple, d.collect())))).option("checkpointLocation", f"{tmp_path}/c{b}").trigger(availableNow=True).start()
        q.awaitTermination(120)
    flat = sorted(x for part in kept[-2:] for x in part)
    assert flat == [("x", day(0)), ("x", day(21)), ("x", day(42)), ("y", day(1))]


def test_files_are_found_and_read_by_extension(spark, tmp_path):
    for name in ("b.csv", "a.jsonl", "c.txt", "d.ndjson"):
        (tmp_path / name).write_text("id,text\n007,\"a, \"\"b\"\"\"\n")
    (tmp_path / "e.parquet").mkdir()
    assert [f.rpartition("/")[2] for f in files.find_inputs(spark, str(tmp_path))] == ["a.jsonl", "b.csv", "d.ndjson"]
    assert files.find_inputs(spark, f"{tmp_path}/b.csv")[0].endswith("b.csv") and files.find_inputs(spark, f"{tmp_path}/none") == []
    assert [tuple(r) for r in files.read_table(spark, f"{tmp_path}/b.csv").collect()] == [("007", 'a, "b"')]
    t = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "id long, t string")
    for kind in ("csv", "parquet"):
        files.write_table(t, f"{tmp_path}/out.{kind}")
        assert files.read_table(spark, f"{tmp_path}/out.{kind}", "id long, t string").exceptAll(t).count() == 0
    assert files.footer_rows(spark, f"{tmp_path}/out.parquet") == 50


def test_settings_cursors_and_gaps(spark, tmp_path):
    s = files.read_settings(["# a", "A = '1'", "export B=two", "C=", "none"])
    assert s == {"A": "1", "B": "two", "C": ""} and files.enabled_sources(s, {"p": ("A", "B"), "q": ("A", "C"), "r": ("D",)}) == {"p": True, "q": False, "r": False}
    folder = str(tmp_path / "cursors")
    assert files.cursor(spark, folder, "p") is None
    for at in (5, 9, 7):
        files.move_cursor(spark, folder, "p", at)
    assert files.cursor(spark, folder, "p") == 9
    months = spark.createDataFrame([("p", "2024-01"), ("p", "2024-02"), ("q", "2024-01")], "source string, month string")
    assert sorted(map(tuple, files.gaps(months, months.limit(0)).collect())) == sorted(map(tuple, months.collect()))
    assert [tuple(r) for r in files.gaps(months, months.where("source = 'p'")).collect()] == [("q", "2024-01")]


@pytest.mark.parametrize("left, near", [("2024-01-03", "2024-01-01"), ("2024-01-06", "2024-01-09"), ("2024-01-05", "2024-01-01"), ("2023-01-01", "2024-01-01"), ("2025-01-01", "2024-01-09")])
def test_nearest_takes_the_earlier_of_two(spark, left, near):
    line = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0), ("s", dt.date(2024, 1, 9), 2.0)], "symbol string, date date, px_last double")
    got = fr.nearest(spark.createDataFrame([("s", dt.date.fromisoformat(left)), ("t", dt.date.fromisoformat(left))], "symbol string, at date"), line)
    assert {r.symbol: str(r.near) for r in got.collect()} == {"s": near, "t": "None"}


def test_small_columns(spark):
    c = spark.createDataFrame([(3, None)], "keyword_count long, inferred_count long")
    assert fr.with_mentions(c).first().mention_count == 3 and fr.with_mentions(c.withColumnRenamed("keyword_count", "mention_count")).columns == ["mention_count", "inferred_count"]
    assert fr.market_symbol is not None and spark.createDataFrame([("A",)], "s string").select(fr.market_symbol(fr.F.col("s"), {}).alias("m")).first().m == "A US Equity"


def test_an_interrupted_publication_is_finished(spark, tmp_path):
    from crowdlens.plans.tables import files as paths
    from crowdlens.sources import publish

    folder = str(tmp_path / "published")
    table = lambda n: spark.createDataFrame([(n,)], "mention_count long")
    publish.publish({"a": table(1), "b": table(1)}, folder)
    # stopped after the mark, with one table moved
    for name in ("a", "b"):
        table(2).write.parquet(f"{folder}/_next/{name}")
    fs, at = paths(spark, folder)
    fs.create(at("_next/_ready")).close()
    fs.delete(at("a"), True)
    fs.rename(at("_next/a"), at("a"))
    got = publish.hydrate(spark, folder, ["a", "b"])
    assert [t.first().mention_count for t in got.values()] == [2, 2] and not fs.exists(at("_next"))
    publish.publish({"a": got["a"]}, folder)  # from the table that it replaces
    assert publish.hydrate(spark, folder, ["a"])["a"].first().mention_count == 2
    with pytest.raises(ValueError):
        publish.publish({"a": table(1).withColumnRenamed("mention_count", "Title")}, folder)
