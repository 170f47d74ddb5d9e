"""Links of embeddings: rows that share an id, cells of every size, large buckets."""

import numpy as np
import pytest

from ledgerloom.llm import embeddings


def plain_links(rows):
    """n_links and component_id of each row by brute force."""
    x = np.array([r[1] for r in rows], "f8")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    group = np.arange(len(rows))
    while True:
        new = np.minimum(group, np.where(near, group[None, :], len(rows)).min(1))
        if (new == group).all():
            break
        group = new
    least = [min((rows[j][0] for j in np.flatnonzero(group == g) if rows[j][0] is not None), default=None) for g in group]
    return sorted(zip([r[0] for r in rows], near.sum(1).tolist(), least, strict=True), key=repr)


def found(spark, rows):
    return sorted(map(tuple, embeddings.grouped(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)


def test_rows_of_one_id_with_two_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    assert found(spark, rows) == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)], key=repr) == plain_links(rows)
    more = rows + [(1, [1.0, 0.0]), (None, [1.0, 0.02]), (None, [-1.0, 0.0]), (9, [-1.0, 0.01])]
    assert found(spark, more) == plain_links(more)


@pytest.mark.parametrize(("small", "block"), [(16, 1024), (2, 8), (1, 1024)])
def test_groups_of_every_size(spark, monkeypatch, small, block):
    monkeypatch.setattr(embeddings, "SMALL", small)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(6)
    rows = []
    for size in [1, 2, 3, 5, 16, 17, 40, 90]:
        base = rng.standard_normal(24)
        rows += [(int(rng.integers(0, 120)), (base + 0.05 * rng.standard_normal(24)).tolist()) for _ in range(size)]
    assert found(spark, rows) == plain_links(rows)
