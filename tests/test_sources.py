import pytest
from pyspark.sql import functions as F

from hitloom.operators.selection import query_filter, select_tracks
from hitloom.runtime import Scratch
from hitloom.sources import tables as T
from hitloom.sources import views


def test_views_keep_their_sums(spark):
    h = views.hits(spark, "/root/testdata/sf0.001")
    assert h.agg(F.sum("ordinal"), F.sum(31 * F.col("column") + 7 * F.col("row") + F.col("dut")), F.sum("charge")).first()[:] == (10162, 1786478, 152257.0)
    t = views.tracks(spark, "/root/testdata/sf0.001")
    assert t.agg(F.count("*"), F.count("x"), F.sum(F.floor(1000 * F.col("x") + 0.5))).first()[:] == (36000, 32830, -149325436250)


def test_positions_are_resolved(spark):
    for cols, want in ((["x", "y", "column", "row"], ("x", True)), (["mean_x", "mean_y"], ("mean_x", True)), (["column", "row"], ("column", False))):
        a, _, is_position = T.position_columns(spark.createDataFrame([(1,) * len(cols)], cols))
        assert want[0] in str(a) and is_position == want[1]
    with pytest.raises(ValueError):
        T.position_columns(spark.createDataFrame([(1,)], ["q"]))


def test_extra_columns_pass(spark):
    df = spark.createDataFrame([(1, 0, 2, 3, 4, 5, "e")], "event_number int, dut int, frame int, column int, row int, charge int, more string")
    assert dict(T.as_hits(df).dtypes) == T.CORE | {"more": "string"}


def test_runs_follow_each_other(spark):
    run = lambda *e: spark.createDataFrame([(v,) for v in e], "event_number long")
    got = sorted(r.event_number for r in T.combine_runs([run(0, 4), run(2), run(0, 1)]).collect())
    assert got == [0, 4, 7, 8, 9]
    assert T.combine_runs([run(), run(3)]).first().event_number == 3


def test_event_filter_reaches_the_files(spark, tmp_path):
    rows = views.hits(spark, "/root/testdata/sf0.001")
    T.write_by_plane(rows, str(tmp_path / "h"))
    read = T.event_range(spark.read.parquet(str(tmp_path / "h")), 10, 20).where("dut = 1").select("charge")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_number,10)" in plan and "isnotnull(dut" in plan and "column" not in plan.split("ReadSchema")[1]


def test_only_predicates(spark):
    df = spark.range(3)
    assert query_filter(df, "(id == 1) | (id > 1) & (id < 3)").count() == 2
    for bad in ("id = 1; drop table x", "id in (select id from t)"):
        with pytest.raises(ValueError):
            query_filter(df, bad)


def test_quality_only_where_there_is_a_hit(spark):
    rows = [(0b11, 0b11, 0, 0), (0b01, 0b01, 0, 0), (0b11, 0b01, 0, 0), (0b111, 0b11, 0, 0b100)]
    df = spark.createDataFrame(rows, "hit_flag long, quality_flag long, isolated_hit_flag long, isolated_track_flag long")
    assert select_tracks(df, hit=[0], quality=[0, 1]).count() == 3
    assert select_tracks(df, hit=[0], no_hit=[2], quality=[0, 1]).count() == 2
    assert select_tracks(df, isolated_track=[2]).count() == 1


def test_scratch(spark, tmp_path):
    s = Scratch(spark, "t")
    t = s.table(spark.range(5))
    assert t.count() == 5
    s.release(t)
    with pytest.raises(Exception):
        s.spark.read.parquet(t.inputFiles()[0]).count()


def test_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from hitloom.runtime import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    for master, fails in (("local[4]", False), ("local", False), ("yarn", True), ("local-cluster[3,2,1000]", True), ("spark://host:7077", True)):
        session = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master))
        if fails:
            with pytest.raises(RuntimeError):
                shared_dir(session)
        else:
            assert shared_dir(session).startswith("file:/")
    assert shared_dir(SimpleNamespace(conf=Conf({"spark.checkpoint.dir": "hdfs://x/y/"}))) == "hdfs://x/y"
