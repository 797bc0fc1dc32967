"""Components by both ways against a plain union-find."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airgrid.llm.graph import components, contract, local_roots
from airgrid.llm.storage import Workspace


def _want(edges):
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {n: i for i, n in enumerate(nodes)}
    find, union = local_roots(len(nodes))
    for x, y in edges:
        if x != y:
            union(at[x], at[y])
    return {n: nodes[find(at[n])] for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-30, 30), st.integers(-30, 30)), max_size=60))
def test_contract(edges):
    edges = [e for e in edges if e[0] != e[1]]
    u, v = contract(np.array([e[0] for e in edges], dtype=np.int64), np.array([e[1] for e in edges], dtype=np.int64))
    got = dict(zip(u.tolist(), v.tolist(), strict=True))
    want = _want(edges)
    assert got == {n: c for n, c in want.items() if n != c}


@pytest.mark.parametrize("most", [-1, 1_000])
def test_components(spark, most):
    edges = [(i, i + 1) for i in range(40)] + [(100, 5), (200, 201), (200, 201), (201, 200), (7, 7)] + [(300, 300 + i) for i in range(1, 60)] + [(900 - i, 899 - i) for i in range(30)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = components(Workspace(spark, "test"), df, most_edges=most).collect()
    assert len(got) == len({r["node"] for r in got})
    assert {r["node"]: r["component"] for r in got} == _want(edges)


@pytest.mark.parametrize("most", [-1, 1_000])
def test_no_edges(spark, most):
    assert components(Workspace(spark, "test"), spark.createDataFrame([(1, 1)], "a long, b long"), most_edges=most).count() == 0
