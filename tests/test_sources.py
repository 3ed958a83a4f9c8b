import numpy as np
import pytest

from gridloom.sources import files as S
from gridloom.streaming import events as E

rng = np.random.default_rng(4)
GREY = rng.integers(0, 256, (7, 9))


@pytest.mark.parametrize("kind", ["npy", "png", "tiff", "ics"])
def test_round_trips(kind):
    data = S.WRITERS[kind](GREY)
    assert np.array_equal(S.READERS[kind](data), GREY)
    assert S.INFOS[kind](data)[0] == (9, 7)
    assert S.kind_of("x", data[:16]) == kind


def test_deeper_and_coloured():
    deep, colour = GREY * 200, rng.integers(0, 256, (5, 6, 3))
    assert np.array_equal(S.read_png(S.write_png(deep)), deep)
    assert np.array_equal(S.read_png(S.write_png(colour)), colour)
    assert np.array_equal(S.read_tiff(S.write_tiff(deep, "deflate")), deep)
    assert np.array_equal(S.read_tiff(S.write_tiff(colour)), colour)
    assert np.allclose(S.read_ics(S.write_ics(GREY / 7)), GREY / 7)


def test_png_rules_are_undone():
    import struct
    import zlib

    rows, before = [], np.zeros(9, np.int64)
    for y, line in enumerate(GREY):
        rule = y % 5
        left = np.concatenate([[0], line[:-1]])
        up, corner = before, np.concatenate([[0], before[:-1]])
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        take = [0, left, up, (left + up) // 2, paeth][rule]
        rows.append(bytes([rule]) + ((line - take) % 256).astype(np.uint8).tobytes())
        before = line
    plain = S.write_png(GREY)
    body = zlib.compress(b"".join(rows))
    head = plain[:33]
    chunk = struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body))
    assert np.array_equal(S.read_png(head + chunk + plain[-12:]), GREY)


def test_files_as_rasters(spark, tmp_path, image):
    for k in range(3):
        (tmp_path / f"{k}.npy").write_bytes(S.write_npy(GREY + k))
    r = S.image_read(spark, f"{tmp_path}/*.npy", (9, 7))
    sums = {x["image_id"]: x["s"] for x in r.df.groupBy("image_id").agg({"v": "sum"}).withColumnRenamed("sum(v)", "s").collect()}
    assert sums == {k: float(GREY.sum() + k * 63) for k in range(3)}
    info = S.image_information(spark, str(tmp_path)).collect()
    assert all(list(i["sizes"]) == [9, 7] for i in info)
    region = S.image_read(spark, f"{tmp_path}/*.npy", (9, 7), roi=[(1, 3), (2, 5)])
    assert region.sizes == (3, 4) and region.df.count() == 36
    S.image_write(image(GREY), f"file://{tmp_path}/out", "png", integer=True)
    assert np.array_equal(S.read_png((tmp_path / "out" / "0.png").read_bytes()), GREY)
    for k in range(2):
        (tmp_path / f"{k}.tif").write_bytes(S.write_tiff(GREY + k))
    stack = S.image_read_tiff_series(spark, f"{tmp_path}/*.tif", (9, 7))
    assert stack.sizes == (9, 7, 2) and stack.df.where("x = 0 AND y = 0 AND z = 1").first()["v"] == GREY[0, 0] + 1


def test_names(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a/b.TIF", "a/b")], "p string, q string").select(
        S.get_extension(F.col("p")).alias("a"), S.compare_extension(F.col("p"), "tif").alias("b"), S.add_extension(F.col("q"), "ics").alias("c"), S.has_extension(F.col("q")).alias("d")
    ).first()
    assert tuple(row) == ("TIF", True, "a/b.ics", False)


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = E.windowed_statistics(E.read_events(spark, f"{tmp_path}/in"), "1 day", late="3650 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = E.windowed_statistics(source, "1 day")
    keys = ["start", "event_type", "n"]
    assert {tuple(r) for r in spark.table("windows").select(*keys).collect()} == {tuple(r) for r in batch.select(*keys).collect()}
    h = E.streaming_histogram(E.read_events(spark, f"{tmp_path}/in"), 0.0, 100.0, 10)
    q = h.writeStream.format("memory").queryName("bins").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").groupBy().sum("count").first()[0] == source.count()
