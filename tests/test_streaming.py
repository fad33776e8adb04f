import gzip
import os

from fixtures import tar

from lumenstrata.streaming.watch import watch


def test_new_archives_are_read_once(spark, tmp_path):
    folder = tmp_path / "in"
    os.mkdir(folder)
    (folder / "a.tgz").write_bytes(gzip.compress(tar([("x", b"NEEDLE\nb\n")])))
    query = watch(spark, str(folder)).filter("rec_type = 'line'").writeStream.format("memory").queryName("seen").start()
    try:
        query.processAllAvailable()
        assert spark.table("seen").count() == 2
        (folder / "b.zst").write_bytes(__import__("zstandard").compress(b"NEEDLE\n"))
        query.processAllAvailable()
        assert spark.table("seen").count() == 3
    finally:
        query.stop()


def test_many_small_archives_take_few_batches(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    os.mkdir(folder)
    for k in range(50):
        (folder / f"{k}.tgz").write_bytes(gzip.compress(tar([("x", b"NEEDLE\nb\n")])))
    for more, batches, limit in ((0, 1, None), (4, 3, 2)):
        for k in range(more):
            (folder / f"again-{k}.tgz").write_bytes(gzip.compress(tar([("x", b"NEEDLE\nb\n")])))
        query = watch(spark, str(folder), files_per_trigger=limit).filter("rec_type = 'line'").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len([n for n in os.listdir(f"{out}-state/commits") if n.isdigit()]) == batches
    assert spark.read.parquet(str(out)).count() == 108
