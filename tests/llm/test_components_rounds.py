import random

from claimloom.llm import components as module


def test_few_edges_need_no_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(module, "checkpoint", lambda df: written.append(1) or df.localCheckpoint())
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)]
    got = {r.node: r.root for r in module.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {k: 0 if k < 100 else 100 for k in [*range(41), *range(100, 140)]}
    assert len(written) <= 2


def test_edges_over_many_tasks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(module, "HELD", 8)
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, -k) for k in range(1, 30)] + [(None, 3), (3, None)]
    root = {x: x for e in edges[:-2] if e[0] != e[1] for x in e}
    for _ in root:
        for u, v in edges[:-2]:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    got = module.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert module.components(spark.createDataFrame([], "u long, v long")).count() == 0
