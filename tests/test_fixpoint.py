import random

from caseweave.plans.fixpoint import components, transitive_closure


def test_closure_of_a_chain_and_a_diamond(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(20)] + [
        ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"),
    ]
    got = {tuple(r) for r in transitive_closure(spark.createDataFrame(edges, "child string, parent string")).collect()}
    want = {(f"c{i}", f"c{j}") for i in range(21) for j in range(i + 1, 21)}
    assert got == want | {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")}


def test_closure_of_a_cycle_ends(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "x")], "child string, parent string")
    assert {tuple(r) for r in transitive_closure(edges).collect()} == {("x", "y"), ("y", "x")}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges = [(a, b) for a, b in edges if a != b]
    edges += [(200 + i, 201 + i) for i in range(30)] + [(500, 501 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = dict(
        (r["node"], r["component"])
        for r in components(spark.createDataFrame(edges, "src int, dst int")).collect()
    )
    assert got == {x: find(x) for x in parent}
