"""Windows over saved trees, and spatial joins in SQL text."""

import contextlib
import io

import pytest
from gridloom.functions.predicates import valid
from gridloom.operators import index
from gridloom.plans.catalog import lateral_join
from pyspark.sql import functions as F
from tests.test_joins import boxes, brute, closed, opened, pairs, some


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("ranges", [2, 64])
def test_windows_over_a_saved_tree(spark, tmp_path, ranges, monkeypatch):
    monkeypatch.setattr(index, "RANGES", ranges)
    rows = some(1, 400, 5) + [(900, None, 1.0, 0.0, 1.0)]
    index.save(index.build(valid(boxes(spark, rows)), 4), f"{tmp_path}/t")
    tree = index.load(spark, f"{tmp_path}/t")
    for w in ((10.0, 30.0, 40.0, 60.0), (50.0, 50.0, 50.0, 50.0), (-9.0, 200.0, -9.0, 200.0), (150.0, 160.0, 0.0, 1.0), (30.0, 10.0, 0.0, 100.0), (float("nan"), 1.0, 0.0, 1.0)):
        for boundary, test in (("closed", closed), ("open", opened)):
            want = [r for r in rows[:-1] if w[0] <= w[1] and test(r, (0, *w))]
            assert pairs(index.selected(tree, w, boundary=boundary)) == sorted(want), (w, boundary)
    few = index.build(valid(boxes(spark, some(2, 3))), 4)
    assert index.selected(few, (0.0, 200.0, 0.0, 200.0)).count() == 3
    assert index.selected(index.build(valid(boxes(spark, []))), (0.0, 1.0, 0.0, 1.0)).count() == 0


def test_a_window_reads_few_row_groups(spark, tmp_path):
    rows = spark.range(40_000).select("id", *(F.expr(f"CAST(id * {m} % 10007 AS DOUBLE)").alias(c) for c, m in (("low0", 7919), ("high0", 7919), ("low1", 6151), ("high1", 6151))))
    tree = index.build(valid(rows))
    (tree.objects.repartitionByRange("leaf").sortWithinPartitions("leaf").write.option("parquet.block.size", 65536).parquet(f"{tmp_path}/objects"))
    saved = index.Tree(spark.read.parquet(f"{tmp_path}/objects"), tree.levels)
    got = index.selected(saved, (100.0, 600.0, 100.0, 600.0))
    plan = plan_of(got)
    assert "PushedFilters: [" in plan and "LessThanOrEqual(leaf," in plan
    import pyarrow.dataset as ds

    leaves = {r["leaf"] for r in saved.objects.join(got.select("id"), "id", "left_semi").select("leaf").distinct().collect()}
    groups = [g.statistics["leaf"] for f in ds.dataset(f"{tmp_path}/objects").get_fragments() for g in f.split_by_row_group() for g in g.row_groups]
    read = sum(any(g["min"] <= x <= g["max"] for x in leaves) for g in groups)
    assert len(groups) > 8 and read < len(groups) / 2
    assert got.count() == rows.where("low0 BETWEEN 100 AND 600 AND low1 BETWEEN 100 AND 600").count() > 50


def test_a_lateral_join_in_sql_is_an_equi_join(spark):
    a, b = some(1, 60), some(2, 90)
    bad = [(900, None, 1.0, 0.0, 1.0), (901, 0.0, float("nan"), 0.0, 1.0), (902, float("nan"), 1.0, 0.0, 1.0), (903, 5.0, 1.0, 0.0, 9.0)]
    df = lateral_join(boxes(spark, a + bad), boxes(spark, b + bad))
    assert pairs(df) == brute(a, b, closed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(lateral_join(boxes(spark, a), boxes(spark, b)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert pairs(lateral_join(boxes(spark, []), boxes(spark, b))) == []
