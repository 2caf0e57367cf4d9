"""Assets as a data source: what is written is read back, and a job that fails leaves nothing."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.sources import asset_source, catalog


@pytest.fixture(scope="module")
def images(spark):
    asset_source.register(spark)
    rows = [(d, f"r{d % 3}", f"doc {d}.pdf", p, n, "PNG", bytes([d, p, n]) * 50 if n < 3 else None) for d in range(6) for p in (1, 2) for n in (1, 2, 3)]
    return catalog.assets(spark.createDataFrame(rows, "doc_id long, run_id string, filename string, page int, image_number int, ext string, bytes binary")).repartition(4)


def files(root):
    return sorted(str(x.relative_to(root)) for x in root.rglob("*") if x.is_file())


def settled(root, before):
    """Assets are as ``before`` at once; the staging folder is gone when the last task has noticed that its job is over."""
    end = time.time() + 30
    while files(root) != before and time.time() < end:
        assert [x for x in files(root) if not x.startswith("_staging/")] == before
        time.sleep(0.5)
    assert files(root) == before


def test_round_trip(spark, images, tmp_path):
    out = images.select("path", "bytes")
    out.write.format("lectern_assets").mode("append").save(str(tmp_path))
    want = sorted((r.path, bytes(r.bytes)) for r in out.where("bytes IS NOT NULL").collect())
    assert files(tmp_path) == [p for p, _ in want] and len(want) == 24
    back = spark.read.format("lectern_assets").load(str(tmp_path))
    assert sorted((r.path, bytes(r.bytes)) for r in back.collect()) == want and back.rdd.getNumPartitions() == 3
    assert {r.size_bytes for r in back.collect()} == {150}
    # Again: the same files. Overwriting removes what is not written.
    out.write.format("lectern_assets").mode("append").save("file://" + str(tmp_path))
    assert files(tmp_path) == [p for p, _ in want]
    out.where("path LIKE 'assets/r1/%'").write.format("lectern_assets").mode("overwrite").save(str(tmp_path))
    assert files(tmp_path) == [p for p, _ in want if "/r1/" in p]


def test_a_failed_task_leaves_no_file(spark, images, tmp_path):
    """One task fails after the others have put their files in place, another within its rows; earlier files stay."""
    images.where("doc_id = 0").select("path", "bytes").write.format("lectern_assets").mode("append").save(str(tmp_path))
    before = files(tmp_path)
    late = F.udf(lambda p: __import__("time").sleep(2) or 1 / 0, "string")
    bad = images.where("doc_id > 0 AND bytes IS NOT NULL").select(F.when(F.col("path").endswith("doc 5_p2_img2.png"), late("path")).otherwise(F.col("path")).alias("path"), "bytes")
    with pytest.raises(Exception):
        bad.write.format("lectern_assets").mode("append").save(str(tmp_path))
    settled(tmp_path, before)
    outside = spark.createDataFrame([("assets/../x", b"1")], "path string, bytes binary")
    with pytest.raises(Exception):
        outside.write.format("lectern_assets").mode("append").save(str(tmp_path))
    settled(tmp_path, before)


def test_a_task_that_outlives_its_job(tmp_path):
    """It finds the job closed, before it begins or when it ends, and leaves nothing; nothing is in place before the commit."""
    from types import SimpleNamespace

    row = SimpleNamespace(path="assets/r/a.png", bytes=b"1")
    writer = asset_source.AssetWriter(str(tmp_path), False)
    done = writer.write(iter([row, SimpleNamespace(path=None, bytes=b"2")]))
    assert done.files == 1 and not (tmp_path / "assets").exists()

    def late():
        yield row
        writer.abort([done])

    with pytest.raises((RuntimeError, OSError)):
        writer.write(late())
    with pytest.raises(RuntimeError):
        writer.write(iter([row]))
    assert files(tmp_path) == []


def test_empty(spark, tmp_path):
    asset_source.register(spark)
    spark.createDataFrame([], "path string, bytes binary").write.format("lectern_assets").mode("append").save(str(tmp_path))
    assert spark.read.format("lectern_assets").load(str(tmp_path)).count() == 0 and files(tmp_path) == []
