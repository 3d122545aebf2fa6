"""Queries without SQL at several numbers of shuffle partitions: rows don't depend on the shape of the plan."""

import pytest

from tidemark.plans import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["retrieval_scores", "rank_agreement"])
def test_rows_at_several_partition_counts(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (3, 24):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(str, engine.QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] and found[0] == found[1]


def test_question_thresholds_are_of_other_rows(spark):
    det, ref = engine._question_detector(engine.chunks(spark, SF))
    t = det.thresholds
    assert t["query_knn_high"] > t["query_knn_near"] > 0.1 and t["query_energy_high"] > t["query_energy_near"]


def test_plan_of_nested_holdouts_stays_small(spark):
    """The driver keeps a plan's description with each of its updates; a hold-out of a hold-out
    repeated its lineage in each of its parts."""
    e = spark.createDataFrame([(i, "id") for i in range(40)], "id long, grp string")
    once = engine.D.holdout(e, 0.2)
    twice = engine.D.holdout(once.filter("not is_eval").drop("is_eval"), 0.25, 1)
    assert (once.filter("is_eval").count(), twice.filter("is_eval").count(), twice.count()) == (8, 8, 32)
    assert twice._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4
