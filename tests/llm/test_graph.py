import random

from plainlens.llm.graph import components


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500, 500 + i) for i in range(1, 90)] + [(600 + i, 601 + i) for i in range(40)] + [(7, 7)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    label = {n: n for e in links for n in e}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if any(a != b and n in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
