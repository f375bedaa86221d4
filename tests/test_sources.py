import numpy as np
from gridloom.operators.partition import Grid
from gridloom.sources import generators, readers
from gridloom.streaming.joins import stream_join


def test_text_reader_skips_counts_and_broken_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3\n0 0 0 0 0\n1 1.5 2 3 4\nx 1 2 3 4\n2 1 2\n")
    assert [tuple(r) for r in readers.rects_text(spark, str(tmp_path / "a.txt"), drop_zero_rows=True).collect()] == [(1, 1.5, 2.0, 3.0, 4.0)]


def test_binary_reader(spark, tmp_path):
    record = np.dtype([("id", "<i4"), ("a", "<f4"), ("b", "<f4"), ("c", "<f4"), ("d", "<f4")])
    rows = np.array([(i, i, i + 1, i, i + 1) for i in range(4)], record).tobytes()
    pages = rows[:60] + b"\0" * 4 + rows[60:] + b"\0" * 44
    (tmp_path / "a.bin").write_bytes(np.array([4], "<i4").tobytes() + b"\0" * 60 + pages)
    assert [r["id"] for r in readers.rects_binary(spark, str(tmp_path / "a.bin")).orderBy("id").collect()] == [0, 1, 2, 3]


def test_export_reads_back(spark, tmp_path):
    a = generators.uniform(spark, 20, seed=3)
    readers.export(a, str(tmp_path))
    assert readers.rects_text(spark, f"{tmp_path}/text").count() == 20
    assert readers.wkt_csv(spark, f"{tmp_path}/semicolon", sep=";").count() == 20
    assert readers.wkt_csv(spark, f"{tmp_path}/comma").where("wkt LIKE 'POLYGON%'").count() == 20
    assert readers.wkt_lines(spark, f"{tmp_path}/wkt").where("size(ring) = 5").count() == 20


def test_wkt_lines_keep_other_kinds(spark, tmp_path):
    good = ["POINT(1 2)", "POLYGON((0 0, 9 0, 9 9, 0 0))", "POLYGON((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 0, 21 0, 21 1, 20 0)))", "linestring(0 0, -1.5e3 2)", "MULTIPOINT((1 2), (3 4))", "LINESTRING(" + ", ".join(f"{i} {i}" for i in range(20000)) + ")"]
    bad = ["", "hello", "LINESTRING(0 0, x 1)", "POLYGON((0 0, 1 1)", "MULTIPOLYGON((0 0, 1 1))", "LINESTRING(0 0,, 1 1)"]
    (tmp_path / "a.wkt").write_text("\n".join(good + bad) + "\n")
    rows = {r["id"]: r for r in readers.wkt_lines(spark, str(tmp_path / "a.wkt")).collect()}
    assert {i: r["wkt"] for i, r in rows.items()} == dict(enumerate(good))
    assert [rows[i]["ring"] is not None for i in range(len(good))] == [False, True] + [False] * 5


def test_osm(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("1\tPOLYGON((0 0, 2 0, 2 3, 0 3, 0 0))\t[]\n2\tPOLYGON((0 0, 2 0, 0 0))\t[]\n3\tGEOMETRYCOLLECTION EMPTY\t[]\n")
    assert [tuple(r) for r in readers.osm_polygons(spark, str(tmp_path / "p.tsv")).collect()] == [(1, 0.0, 2.0, 0.0, 3.0)]
    (tmp_path / "n.tsv").write_text("10\t9.3\t51.3\t[]\nx\t1\t2\t[]\n")
    assert readers.osm_points(spark, str(tmp_path / "n.tsv")).count() == 1


def test_generators(spark):
    assert generators.gaussian(spark, 50, angle=0.3).count() == generators.exponential(spark, 50).count() == 50
    a, b = generators.selective(spark, 10, 0.3)
    from gridloom.operators.join import spatial_join

    assert spatial_join(a, b).count() == 30


def test_rotating(spark):
    from gridloom.sources.readers import rotating

    assert {r["file"]: r["count"] for r in rotating(generators.uniform(spark, 25), 10).groupBy("file").count().collect()} == {0: 10, 1: 10, 2: 5}


def test_stream_join(spark, tmp_path):
    a = generators.uniform(spark, 30, map_edge=20.0, edge=2.0, seed=5)
    a.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(a.schema).parquet(f"{tmp_path}/in")
    a = spark.read.parquet(f"{tmp_path}/in")
    q = stream_join(stream, a, Grid(0.0, 22.0, 0.0, 22.0, 4, 4)).writeStream.format("memory").queryName("joined").trigger(availableNow=True).start()
    q.awaitTermination()
    from gridloom.operators.join import spatial_join

    assert sorted(map(tuple, spark.table("joined").collect())) == sorted(map(tuple, spatial_join(a, a).collect()))


def test_paged_files_are_read_in_ranges_and_written_by_tasks(spark, tmp_path):
    import os

    import pytest
    from gridloom.sources import readers

    rect = "id long, low0 double, high0 double, low1 double, high1 double"
    rows = [(i, float(i), float(i + 1), 2.0 * i, 2.0 * i + 3) for i in range(1000)]
    for where in (f"file://{tmp_path}/one", f"{tmp_path}/two"):
        readers.write_binary(spark.createDataFrame(rows, rect).repartition(7), where, per_file=400)
        folder = where.removeprefix("file://")
        assert sorted(os.listdir(folder)) == ["part-00000.bin", "part-00001.bin", "part-00002.bin"]
        for pages in (1 << 20, 50, 1):
            got = readers.rects_binary(spark, where, pages_per_task=pages)
            assert sorted(map(tuple, got.collect())) == rows
            assert got.rdd.getNumPartitions() >= {1 << 20: 3, 50: 8, 1: 334}[pages]
        assert readers.rects_binary(spark, f"{where}/part-00002.bin").count() == 200 and readers.rects_binary(spark, f"{where}/*1.bin").count() == 400
    readers.write_binary(spark.createDataFrame([], rect), f"{tmp_path}/none")
    assert readers.rects_binary(spark, f"{tmp_path}/one").where("id < 0").count() == 0
    with pytest.raises(Exception, match="32 bits"):
        readers.write_binary(spark.createDataFrame([(1 << 40, 0.0, 1.0, 0.0, 1.0)], rect), f"{tmp_path}/large")
    with pytest.raises(Exception, match="nowhere"):
        readers.rects_binary(spark, f"{tmp_path}/nowhere").count()
