"""Publication of month documents: versions, half runs, empty months, carried parts."""

import os

import pytest
from pyspark.sql import functions as F

from tallyweave.plans import monthly
from tallyweave.plans.publish import Publication


def rows(spark, *items):
    return spark.createDataFrame(list(items), "month string, id long, v double")


def held(df):
    return sorted((r.month, r.id, r.v) for r in df.collect())


def test_versions_and_half_runs(spark, tmp_path):
    p = Publication(spark, str(tmp_path / "pub"))
    assert p.versions() == [] and p.months("entries") == []
    with pytest.raises(ValueError):
        p.read("entries")
    assert p.publish({"entries": rows(spark, ("2024-01", 1, 1.0), ("2024-02", 2, 2.0)), "stats": rows(spark, ("2024-01", 9, 0.5))}, ["2024-01", "2024-02"]) == 1
    staged = p.stage({"entries": rows(spark, ("2024-01", 1, 7.0))}, ["2024-01"])
    # a run that stops here has changed nothing
    assert held(p.read("entries")) == [("2024-01", 1, 1.0), ("2024-02", 2, 2.0)] and p.versions() == [1]
    assert p.commit(staged) == 2
    # the month is replaced whole, the other month and the other part are carried over, the version before stays readable
    assert held(p.read("entries")) == [("2024-01", 1, 7.0), ("2024-02", 2, 2.0)] and held(p.read("stats")) == [("2024-01", 9, 0.5)]
    assert held(p.read("entries", version=1)) == [("2024-01", 1, 1.0), ("2024-02", 2, 2.0)]
    # a month without rows is replaced by nothing, also when nothing is left at all
    p.publish({"entries": rows(spark).limit(0)}, ["2024-02"])
    assert held(p.read("entries")) == [("2024-01", 1, 7.0)] and p.months("entries") == ["2024-01"]
    p.publish({"entries": rows(spark).limit(0)}, ["2024-01"])
    assert held(p.read("entries")) == [] and p.read("entries").columns == ["month", "id", "v"] and held(p.read("stats")) == [("2024-01", 9, 0.5)]


def test_failed_writes_and_foreign_months(spark, tmp_path):
    p = Publication(spark, str(tmp_path / "pub"))
    p.publish({"entries": rows(spark, ("2024-01", 1, 1.0))}, ["2024-01"])
    for bad in (rows(spark, ("2024-03", 1, 1.0)), rows(spark, (None, 1, 1.0))):
        with pytest.raises(Exception, match="not published"):
            p.publish({"entries": bad}, ["2024-01"])
    broken = rows(spark, ("2024-01", 1, 2.0)).withColumn("v", F.raise_error(F.lit("stopped half-way")).cast("double"))
    with pytest.raises(Exception, match="half-way"):
        p.publish({"stats": rows(spark, ("2024-01", 1, 1.0)), "entries": broken}, ["2024-01"])
    assert held(p.read("entries")) == [("2024-01", 1, 1.0)] and p.versions() == [1]
    one, two = p.stage({"entries": rows(spark, ("2024-01", 1, 3.0))}, ["2024-01"]), p.stage({"entries": rows(spark, ("2024-01", 1, 4.0))}, ["2024-01"])
    assert p.commit(one) == 2 and p.commit(two) == 3 and held(p.read("entries")) == [("2024-01", 1, 4.0)]


def test_only_the_months_asked_for_are_opened(spark, tmp_path):
    p = Publication(spark, str(tmp_path / "pub"))
    p.publish({"entries": rows(spark, *[(f"2024-{m:02d}", m, 0.0) for m in range(1, 13)])}, [f"2024-{m:02d}" for m in range(1, 13)])
    some = p.read("entries", ["2024-03", "2025-01"])
    assert held(some) == [("2024-03", 3, 0.0)] and all("_m=2024-03" in f for f in some.inputFiles()) and len(p.read("entries").inputFiles()) >= 12
    p.publish({"entries": rows(spark, ("2024-03", 3, 1.0))}, ["2024-03"])
    assert p.drop_old(1) == 1 and p.versions() == [2] and p.read("entries").count() == 12
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "pub" / "manifests")) < 10


def test_cleared_month_of_a_table(spark, tmp_path):
    path = str(tmp_path / "by-month")
    monthly.write_month(rows(spark, ("2024-01", 1, 1.0), ("2024-02", 2, 2.0)), path)
    monthly.write_month(rows(spark, ("2024-01", 1, 5.0)), path, ["2024-01", "2024-02"])
    assert held(monthly.read_month(spark, path)) == [("2024-01", 1, 5.0)]
    read = monthly.read_month(spark, path, "2024-01")
    assert "PartitionFilters: [isnotnull(month" in read._jdf.queryExecution().toString()
