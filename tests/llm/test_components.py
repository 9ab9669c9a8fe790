"""Connected components against a plain search, in one task and in many."""

import random

import pytest

from textloom.llm import components


def plain_components(links):
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        open_nodes = [] if start in out else [start]
        while open_nodes:
            x = open_nodes.pop()
            if x not in out:
                out[x] = start
                open_nodes += near[x]
    return out


@pytest.mark.parametrize("task_links", [1 << 18, 9])
def test_components_of_numbers_and_structs(spark, monkeypatch, task_links):
    monkeypatch.setattr(components, "TASK_LINKS", task_links)
    rng = random.Random(4)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(60)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 901 + i) for i in range(30)] + [(-5, -5), (7, 8), (8, 7)]
    wanted = plain_components(links)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r["node"]: r["component"] for r in found} == wanted and len(found) == len(wanted)

    def node(x):
        return (x % 3 == 0, None if x % 3 == 0 else x, x)

    kind = "struct<none:boolean,id:long,set:long>"
    named = [(node(a), node(b)) for a, b in links]
    found = components.connected_components(spark.createDataFrame(named, f"a {kind}, b {kind}")).collect()
    assert {tuple(r["node"]): tuple(r["component"]) for r in found} == plain_components(named) and len(found) == len(wanted)


def test_components_without_links(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
    assert components.connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).collect() == []
