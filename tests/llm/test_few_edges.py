"""Rounds over few edges run in few tasks, whatever the number of shuffle partitions; components are those of brute force."""

import random

import pytest

from cipherledger.llm import common as C


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    return {x: root(x) for x in nodes}


def graph():
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(60)]
    hub = [(1000 + k, 2000) for k in range(50)]
    return [*chain, *hub, *((rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(150)), (-5, -(2**62)), (7, 7), (9999, 9999), (1, 0)]


@pytest.mark.parametrize(("heavy", "edges"), [(100_000, 10_000), (100_000, 9), (0, 10_000), (0, 9)])
def test_components(spark, monkeypatch, heavy, edges):
    monkeypatch.setattr(C, "HEAVY", heavy)
    monkeypatch.setattr(C, "EDGES", edges)
    rows = C.components(spark.createDataFrame(graph(), "a long, b long")).collect()
    assert len(rows) == len({r.node for r in rows})
    assert {r.node: r.component for r in rows} == brute(graph())


def tasks(spark, name, run):
    """The tasks that ``run`` starts."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for s in stages if (i := told.getStageInfo(s)))


def test_few_edges_take_few_tasks(spark):
    own = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    df = spark.createDataFrame(graph(), "a long, b long")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        n = tasks(spark, "few edges", lambda: C.components(df).collect())
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    assert n < 400  # the first list of edges is made in 40; in as many each, rounds took thousands
