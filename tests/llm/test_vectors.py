"""Near-duplicate vectors against every pair compared by brute force."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from chronoloom.llm import embeddings

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        # names that the operator uses within
        *[T.StructField(c, T.StringType()) for c in ("id", "v", "class", "tile", "n_links", "kept", "cell")],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *"jjjjjjj") for r in rows], SCHEMA)


def brute(rows, threshold):
    """Links by the cosine of every two rows, components by walking them."""

    def usable(r):
        v = r[1]
        return None not in (r[0], r[2], v) and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    real = [np.array(r[1], np.float32).astype(float) if usable(r) else None for r in rows]
    near = [[] for _ in rows]
    for i, a in enumerate(real):
        for j, b in enumerate(real):
            if i == j or a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if embeddings.cosine(a, b) >= threshold:
                near[i].append(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        least = min(rows[k][0] for k in seen) if r[0] is not None else None
        out.append((r[0], len(near[i]), least, least is not None and least == r[0]))
    return sorted(out, key=str)


def clouds(seed, groups=12, each=9, size=16):
    """Groups about a centre: tight ones, loose ones and chains, over three labels, ids in no order."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre, spread = rng.normal(size=size), (0.02, 0.2, 0.45)[g % 3]
        for _ in range(each):
            v = centre / np.linalg.norm(centre) + rng.normal(size=size) * spread / math.sqrt(size) * 2
            rows.append((v * rng.uniform(0.1, 30)).tolist())
    ids = rng.permutation(len(rows)).tolist()
    return [(i, v, (i * 7) % 3 if k % 5 else 1) for k, (i, v) in enumerate(zip(ids, rows, strict=True))]


def awkward():
    v = [0.5, -1.0, 2.0, 0.25]
    return [
        (1, v, 0), (2, v, 0), (3, [2 * x for x in v], 0), (4, v, None), (5, v, 1), (6, None, 0), (7, [0.0] * 4, 0),
        (8, [0.5, None, 2.0, 0.25], 0), (9, [float("nan"), 1.0, 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0, 1.0], 0),
        (None, v, 0), (None, None, None), (11, [], 0), (12, v[:3], 0), (13, v[:3], 0), (14, [-x for x in v], 0),
        (15, [1e30, 0.0, 0.0, 0.0], 0), (16, [1e-30, 0.0, 0.0, 1e-32], 0), (2, v, 0), (17, [3.0], 2), (18, [5.0], 2), (19, [-5.0], 2),
    ]


def run(spark, rows, threshold=0.93, tile_rows=embeddings.TILE):
    found = embeddings.vector_links(table(spark, rows), threshold, tile_rows=tile_rows)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("tile_rows", [7])
def test_against_every_pair(spark, tile_rows):
    rows = clouds(1) + [(i + 1000 if i is not None else None, v, lab) for i, v, lab in awkward()]
    assert run(spark, rows, tile_rows=tile_rows) == brute(rows, 0.93)


def test_awkward_and_empty_tables(spark):
    assert run(spark, awkward()) == brute(awkward(), 0.93)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 0)]) == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        embeddings.vector_links(table(spark, []), threshold=0.0)


def test_a_group_of_near_copies_is_counted_and_not_compared(spark):
    """A third of all rows about one vector, another tenth its exact copies: tiles of the group are linked whole."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=24)
    rows = [(k, (centre + rng.normal(size=24) * 0.01).tolist(), 3) for k in range(200)]
    rows += [(200 + k, centre.tolist(), 3) for k in range(60)]
    rows += [(300 + k, rng.normal(size=24).tolist(), 3) for k in range(340)]
    random.Random(1).shuffle(rows)
    df = table(spark, rows)
    got = {r.vec_id: r for r in embeddings.vector_links(df, tile_rows=20).collect()}
    assert {(got[k].n_links, got[k].component_id) for k in range(260)} == {(259, 0)}
    assert sorted((tuple(r) for r in got.values()), key=str) == brute(rows, 0.93)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.sampled_from([0.5, 0.93, 1.0]))
def test_stopping_early_loses_no_pair(seed, m, n, size, threshold):
    rng = np.random.default_rng(seed)
    a = embeddings.units(rng.normal(size=(m, size)) + 0.01)
    b = embeddings.units(np.concatenate([a[: n // 2], rng.normal(size=(n - min(n // 2, m), size))])[:n] + 1e-3)
    exact = lambda i, j: embeddings.cosine(a[i], b[j]) >= threshold
    got = {(int(x), int(y)) for i, j in embeddings.linked_rows(a, b, threshold, False, exact) for x, y in zip(i, j)}
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if embeddings.cosine(a[i], b[j]) >= threshold}
    assert got == want
