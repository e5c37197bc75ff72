"""Tables kept by ranges: slices, and writes that leave other ranges' files alone."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators.ranges import RangedTable


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_ranges_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("emb"), F.lit("x").alias("note"))
    t = RangedTable(spark, path, 100).create(rows)
    with pytest.raises(FileExistsError):
        RangedTable(spark, path, 100).create(rows)
    before = files(path)
    few = spark.createDataFrame([(205, [9.0, 9.0]), (206, [8.0, 8.0]), (206, [1.0, 1.0]), (5000, [0.0, 0.0])], "id long, emb array<double>")
    t.add(few)
    after = files(path)
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "range=2/" not in f}
    got = {r["id"]: r["emb"] for r in t.read().collect()}
    assert len(got) == 1000 and got[205] == [214.0, 10.0] and got[206] == [215.0, 10.0] and got[207] == [207.0, 1.0]
    t.put(few.where("id = 205"))
    assert sorted(tuple(r) for r in t.range_read(204, 3).collect()) == [(204, [204.0, 1.0], "x"), (205, [9.0, 9.0], "x"), (206, [215.0, 10.0], "x")]
    assert t.range_read(150, 100).count() == 100 and t.range_read(990, 100).count() == 10 and t.range_read(0, 0).count() == 0
    assert "range" in t.range_read(0, 10)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    t.range_put(995, rows.where("id >= 995").withColumn("note", F.lit("y")).unionByName(rows.limit(1).withColumn("id", F.lit(1001).cast("long"))))
    assert t.read().where("note = 'y'").count() == 5 and t.read().count() == 1001
    t.append(rows.limit(3))
    assert sorted(r["id"] for r in t.read().where("id > 1000").collect()) == [1001, 1002, 1003, 1004]
    with pytest.raises(ValueError):
        t.range_put(10, rows.limit(1))
    with pytest.raises(ValueError):
        t.range_read(-1, 5)
