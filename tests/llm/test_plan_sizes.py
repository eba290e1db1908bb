"""Stages with many joins are written in parts: the driver holds each exchange of a plan that runs at once."""

import re

SF = "/root/testdata/sf0.001"
MOST = 8


def exchanges(df):
    return len(re.findall(r"\b(?:Exchange|BroadcastExchange)\b", df._jdf.queryExecution().executedPlan().toString()))


def test_no_plan_with_many_exchanges(spark, monkeypatch):
    from gatewarden.llm import common, graph, jaccard, packing, stages

    seen = []

    def noted(df, *more):
        seen.append(exchanges(df))
        return common.saved(df, *more)

    for module in (graph, jaccard, packing, stages):
        monkeypatch.setattr(module, "saved", noted, raising=False)
    docs = common.table(spark, SF, "documents")
    for stage in (stages.keep_one_of_each_group, stages.pack):
        seen.append(exchanges(stage(spark, docs, SF)))
        assert max(seen) <= MOST, seen


def test_components_by_union_find(spark):
    import random

    from gatewarden.llm import graph

    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 130)] + [(7, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (101, 100), (7, 200)]
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    got = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert sorted((r.node, r.root) for r in got) == sorted((x, top(x)) for x in linked)
