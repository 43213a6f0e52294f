import random

from ledgerscope.llm.ngram_join import components


def test_components_of_chains_stars_and_random_graphs(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(500, 500), (601, 600), (600, 601)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
