"""The epsilon grid order join against all pairs."""

import math

import numpy as np
import pytest

from playmetrics.llm import grid


def plain(rows, threshold):
    """(vec_id, n_links, component_id, kept) by comparing all pairs and walking the links."""

    def fine(row):
        v = row[1]
        return row[2] is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def near(x, y):
        if not (fine(x) and fine(y)) or x[2] != y[2] or len(x[1]) != len(y[1]):
            return False
        a, b = np.array(x[1], float), np.array(y[1], float)
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold

    n = len(rows)
    links = [[j for j in range(n) if i != j and near(rows[i], rows[j])] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def found(spark, rows, threshold, kind="float"):
    schema = f"vec_id long, embedding array<{kind}>, label int, copies string, low double"
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], schema)
    return sorted(map(tuple, grid.join(df, threshold).collect()), key=str)


def made(seed, n, width, labels, groups):
    """Random vectors, groups of near copies (one of a third of all), exact copies and chains."""
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(groups, width))
    for k in range(n):
        g = 0 if k % 3 == 0 else int(rng.integers(groups))
        v = centres[g] + rng.normal(size=width) * rng.choice([0, 0.02, 0.1, 0.3, 2])
        rows.append((int(k) if k % 7 else int(k) + 100_000, np.float32(v * rng.choice([1, 3])).tolist(), int(rng.integers(labels)) if k % 3 else 0))
    return rows


AWKWARD = [
    (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0),
    (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (10, [2.0, 4.0], 0), (11, [1.0, 2.0], 1),
    (12, [1.0, 2.0, 0.0], 0), (13, [-1.0, -2.0], 0), (None, [1.0, 2.0], 0), (None, [5.0, -3.0], 0), (14, [1.0], 0), (15, [2.0], 0),
    (16, [0.0, 1.0], 2), (17, [-0.0, 1.0], 2), (2**63 - 1, [3.0, 1.0], 5),
]


def test_awkward_rows(spark):
    assert found(spark, AWKWARD, 0.98) == plain(AWKWARD, 0.98)


@pytest.mark.parametrize("width, block, threshold", [(5, 16, 0.98), (40, 256, 0.98), (3, 20, 0.9)])
def test_same_as_all_pairs(spark, monkeypatch, width, block, threshold):
    monkeypatch.setattr(grid, "BLOCK_BYTES", block * width * 4)
    rows = made(width, 500, width, 3, 12)
    assert found(spark, rows, threshold) == plain(rows, threshold)


def test_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e-200, 1e-200], 0), (3, [1e200, -1e200], 0)]
    assert found(spark, rows, 0.98, "double") == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_far_blocks_are_skipped(spark):
    """Three well separated groups: no pair of blocks from two of them is compared."""
    rng = np.random.default_rng(5)
    centres = np.eye(8)[:3]
    rows = [(k, (centres[k // 600] + rng.normal(size=8) * 0.005).tolist(), 0) for k in range(1800)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>, label string")
    raw = grid.as_bytes(df, "<f8").selectExpr("*", "sha2(vector, 256) AS key", "1L AS copies", "row_id AS first_id")
    directions = grid.fit_directions(raw, "<f8")
    made_blocks = grid.blocks(grid.placed(raw.drop("row_id"), directions, 0.2, "<f8"), "<f8")
    heads = made_blocks.selectExpr("1L AS seq_id", "row_number() OVER (ORDER BY part, seq) - 1L AS nth", "low", "high")
    heads = heads.withColumn("nth", heads["nth"].cast("long"))
    n = heads.count()
    pairs = grid.near_pairs(heads, 0.2).count()
    assert pairs < 0.7 * n * (n + 1) / 2
    wide = heads.selectExpr("size(low) AS k").distinct().collect()
    assert [r.k for r in wide] == [grid.DIRECTIONS + 1]


def test_empty_table(spark):
    assert found(spark, [], 0.98) == []
    assert found(spark, [(1, None, None)], 0.98) == [(1, 0, 1, True)]
