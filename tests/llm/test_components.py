import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tripweave.llm.components import Forest, components


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


@pytest.mark.parametrize("seed", range(2))
def test_random_links(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2)) if a != b]
    assert rows(components(spark.createDataFrame(edges, "a long, b long"))) == sorted(brute(edges), key=lambda r: tuple((False, str(v)) for v in r))


def test_path_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 200)]
    found = dict(components(spark.createDataFrame(path + star + [(7, 7), (None, 3)], "a long, b long").filter("a is not null")).collect())
    assert set(found.values()) == {0, 100} and len(found) == 141
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    text = components(spark.createDataFrame([("b", "c"), ("a", "b")], "a string, b string"))
    assert text.agg(F.min("root"), F.max("root"), F.count("*")).first() == ("a", "a", 3)


def test_forest_in_a_task():
    f = Forest(6)
    f.join(np.array([1, 4]), np.array([2, 5]))
    f.join(np.array([2]), np.array([5]))
    node, root = f.edges()
    assert node.tolist() == [2, 4, 5] and root.tolist() == [1, 1, 1]
