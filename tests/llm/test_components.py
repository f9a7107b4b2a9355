import random

from quirefold.llm.components import connected_components
from quirefold.llm.scratch import Scratch


def run(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    return {r.node: r.component for r in connected_components(df, Scratch(spark, "t")).collect()}


def test_chain_star_and_random_edges(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(r.randrange(1000, 1060), r.randrange(1000, 1060)) for _ in range(45)]
    edges += [(7, 7), (None, 3), (3, None), (101, 100)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    assert run(spark, edges) == {x: find(x) for x in label}


def test_no_edges(spark):
    assert run(spark, []) == {}
