"""Components of links against plain relaxation."""

import random

import pytest

from tessera.operators import graph


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(x, x) == label[x] for x in label)


@pytest.mark.parametrize("small", [0, 1000])
def test_contracted(spark, small):
    rng = random.Random(9)
    links = [(i, 1000 + i % 3) for i in range(60)] + [(i, 1000 + rng.randrange(12)) for i in range(40, 60)] + [(1002, 1005), (70, 71), (71, 72), (72, 70), (73, 73)]
    label = {x: x for e in links for x in e}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in graph.contracted(spark.createDataFrame(links, "a long, b long").repartition(3), small).collect()}
    own = {x: got.get(x, x) for x in label}
    assert len({(own[x], label[x]) for x in label}) == len(set(own.values())) == len(set(label.values()))
    assert all(label[own[x]] == label[x] for x in label)
    assert graph.contracted(spark.createDataFrame([], "a long, b long"), small).count() == 0
    names = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in ((1, 2), (3, 2), (9, 8))], "a binary, b binary")
    held = {bytes(r.node): bytes(r.root) for r in graph.contracted(names, small).collect()}
    assert held.get(b"\x01", b"\x01") == held.get(b"\x03", b"\x03") == held.get(b"\x02", b"\x02") != held.get(b"\x09", b"\x09")
