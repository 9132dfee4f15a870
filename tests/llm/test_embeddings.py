"""Vectors: where copies are sent, sizes at the ends of the number range, odd tables."""

import numpy as np
import pytest

from marlstone.llm import embeddings


@pytest.mark.parametrize(("width", "pivots", "spread"), [(2, 7, 0.0), (8, 40, 0.3), (64, 200, 0.1)])
def test_partners_live_in_a_cell_that_the_vector_reaches(width, pivots, spread):
    rng = np.random.default_rng(width)
    base = rng.normal(size=(30, width))
    x = np.concatenate([base + spread * rng.normal(size=base.shape) for _ in range(70)] + [rng.normal(size=(100, width))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = np.concatenate([x[:pivots], x[:1]])           # one pivot twice
    reach = float(np.sqrt(2 - 2 * embeddings.MIN_COSINE))
    row, cell, home = embeddings._reached(x, centres, reach)
    own = np.full(len(x), -1)
    own[row[home]] = cell[home]
    reached = np.zeros((len(x), len(centres)), bool)
    reached[row, cell] = True
    assert home.sum() == len(x) and (own >= 0).all()
    for i, j in zip(*np.nonzero(x @ x.T >= embeddings.MIN_COSINE), strict=True):
        assert reached[i, own[j]]
    assert spread or reached.sum() < reached.size


def test_sizes_at_the_ends_of_the_number_range(spark):
    one, other = [3.0, 4.0, 0.5], [4.0, -3.0, 0.5]
    sizes = [1.0, 1e-170, 1e-300, 1e170, 1e300]
    rows = [(i, [s * c for c in (one if i % 2 else other)], 1) for i, s in enumerate(s for s in sizes for _ in range(2))]
    got = {r["id"]: (r["n_links"], r["component"]) for r in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (len(sizes) - 1, i % 2) for i in range(len(rows))}


def test_empty_table_and_columns_with_the_names_used_inside(spark):
    schema = "vec_id long, embedding array<float>, label int, c string, k int, id string, weight string, v int, rep int"
    assert embeddings.link_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(i, [1.0, 0.0] if i < 3 else [0.0, 1.0], 0, "c", 1, "x", "w", 2, 3) for i in range(4)] + [(None, None, None, None, None, None, None, None, None)] * 2
    got = sorted((r["id"] if r["id"] is not None else -1, r["n_links"], r["component"]) for r in embeddings.link_vectors(spark.createDataFrame(rows, schema)).where("id is not null").collect())
    assert got == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]
    alone = embeddings.link_vectors(spark.createDataFrame(rows, schema)).where("id is null").collect()
    assert [(r["n_links"], r["component"]) for r in alone] == [(0, None)] * 2
