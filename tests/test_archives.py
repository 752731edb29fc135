"""zstd archives in ranges, and footers."""

import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from crowdlens.sources import archives, files

SCHEMA = "id bigint, t string"


def written(path, frames, **options):
    with open(path, "wb") as f:
        for data in frames:
            f.write(data if isinstance(data, bytes) and data[1:4] == archives.SKIPPABLE else zstandard.ZstdCompressor(write_content_size=False, **options).compress(data))


@pytest.mark.parametrize("split", [1, 700, 5_000, 1 << 30])
def test_any_split_reads_each_line_once(spark, tmp_path, split):
    rng = random.Random(split)
    rows = [{"id": i, "t": "".join(rng.choice("abc é€") for _ in range(rng.randint(0, 200)))} for i in range(300)]
    text = "\n".join([*(json.dumps(r, ensure_ascii=False) for r in rows[:150]), "not json", "", *(json.dumps(r) for r in rows[150:])]).encode()
    cuts = sorted(rng.sample(range(1, len(text)), 12))
    skippable = b"\x50" + archives.SKIPPABLE + (9).to_bytes(4, "little") + b"\x28\xb5\x2f\xfdxxxxx"
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    written(tmp_path / "a.zst", [*parts[:4], skippable, *parts[4:]])
    written(tmp_path / "b.zst", [b'{"id": 900, "t": "one frame"}\n' * 3], write_checksum=True)
    got = archives.read_zstd_json(spark, [str(tmp_path / "a.zst"), (tmp_path / "b.zst").as_uri()], SCHEMA, max(split, (tmp_path / "a.zst").stat().st_size // 60)).collect()
    assert sorted((r.id, r.t) for r in got) == sorted([(r["id"], r["t"]) for r in rows] + [(900, "one frame")] * 3)
    assert archives.read_zstd_json(spark, [], SCHEMA).count() == 0


def test_every_range_of_bytes(tmp_path):
    text = b"".join(b"%d %s\n" % (i, b"x" * (i % 40)) for i in range(200)) + b"last"
    parts = [text[i : i + 97] for i in range(0, len(text), 97)]
    written(tmp_path / "a.zst", parts)
    with archives.opened(str(tmp_path / "a.zst")) as f:
        size = f.size()
        for step in (1, 13, 50, 111, 1000):
            got = [x for a in range(0, size, step) for x in archives.lines(f, a, min(a + step, size), size)]
            assert got == text.split(b"\n")
        # a magic number within data is no frame
        assert not archives.is_frame(f, 1, size) and archives.is_frame(f, 0, size)


def test_a_cut_file_is_an_error(tmp_path):
    written(tmp_path / "a.zst", [b"x\n" * 100_000])
    (tmp_path / "b.zst").write_bytes((tmp_path / "a.zst").read_bytes()[:-9])
    with archives.opened(str(tmp_path / "b.zst")) as f, pytest.raises(EOFError):
        list(archives.lines(f, 0, f.size(), f.size()))


def test_footers(spark, tmp_path):
    t = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id").cast("string")).alias("s"))
    t.repartitionByRange(4, "id").write.parquet(f"{tmp_path}/p")
    rows = archives.footers(spark, f"{tmp_path}/p").collect()
    assert len(rows) == 4 and sum(r.rows for r in rows) == 1000 == files.footer_rows(spark, f"{tmp_path}/p")
    ids = sorted((int(c.least), int(c.most)) for r in rows for c in r.columns if c.name == "id")
    assert ids[0][0] == 0 and ids[-1][1] == 999 and all(a[1] < b[0] for a, b in zip(ids, ids[1:]))
    assert sum(c.nulls for r in rows for c in r.columns if c.name == "s") == 100 and all(r.row_groups == 1 and "id: int64" in r.schema for r in rows)
