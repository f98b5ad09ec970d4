"""The links of vectors with the cells, bundles and chunks they are found in, and what that leaves on disk."""

from pathlib import Path

import numpy as np
import pytest

from treelens.llm import vectors
from treelens.llm.vectors import VectorRules, near_vectors


def frame(spark, rows, kind="float"):
    numbered = [(i, [float(x) for x in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, f"vec_id long, embedding array<{kind}>").repartition(4)


def brute(rows):
    """Number of links and smallest id of the group of every row."""
    unit = rows.astype(np.float64)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        after = np.minimum(label, np.where(link, label, len(rows)).min(axis=1))
        if np.array_equal(after, label):
            return link.sum(axis=1).tolist(), label.tolist()
        label = after


@pytest.mark.parametrize(
    ("n", "size", "spread", "kind", "part"),
    # More than a chunk in a bundle, several bundles, longer and shorter than a shadow's leading coordinates.
    [(1500, 64, 0.3, "float", 4096), (1200, 40, 0.4, "double", 100), (600, 7, 0.4, "float", 50)],
)
def test_links_are_those_of_brute_force(spark, n, size, spread, kind, part):
    rng = np.random.default_rng(n)
    rows = rng.normal(size=(12, size))[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, size))
    rows = rows.astype("f4" if kind == "float" else "f8")
    rows[-4:] = rows[:4]
    found = near_vectors(frame(spark, rows, kind), VectorRules(part=part)).orderBy("vec_id").collect()
    links, label = brute(rows)
    assert 0 < sum(links) < n * (n - 1)
    assert [r.n_links for r in found] == links
    assert [r.component_id for r in found] == label


def test_lengths_that_no_sample_has_seen(spark, monkeypatch):
    monkeypatch.setattr(vectors, "fitted", lambda good, total, rules: {})
    rng = np.random.default_rng(3)
    rows = [*rng.normal(size=(300, 20)), *rng.normal(size=(5, 9))]
    rows += [rows[0] * 1.01, rows[302] * 2 + 0.001]
    found = near_vectors(frame(spark, rows)).where("n_links > 0").orderBy("vec_id").collect()
    assert [(r.vec_id, r.component_id) for r in found] == [(0, 0), (302, 302), (305, 0), (306, 302)]


def test_signs_of_zero_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-0.0, 2.0])]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False),
    ]


@pytest.mark.parametrize("fit", [True, False])
def test_shadows_are_never_less_alike_than_their_vectors(fit):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 70)) @ rng.normal(size=(70, 70))
    turn = np.linalg.eigh(np.cov(x.T))[1][:, ::-1] if fit else None
    unit, points = vectors.unit(x), vectors.shadows(x, turn, VectorRules())
    assert points.shape[1] < 70
    assert (points @ points.T >= unit @ unit.T - vectors.COARSE_SLACK / 2).all()


def test_vectors_are_not_copied_for_every_tile(spark, monkeypatch):
    env, real, seen = spark._jvm.org.apache.spark.SparkEnv.get(), vectors.written, []
    folders = list(env.blockManager().diskBlockManager().localDirsString())

    def used():
        return sum(p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data"))

    def watched(df, name):
        table = real(df, name)
        seen.append(used())
        return table

    monkeypatch.setattr(vectors, "written", watched)
    rows = np.random.default_rng(4).normal(size=(1500, 64))
    df = frame(spark, rows)
    before = used()
    found = near_vectors(df, VectorRules(part=30))
    assert found.where("n_links > 0").count() == 0
    # 34 MB when each vector was shuffled for every part of its cell and of the next ones.
    assert max(seen) - before < 8 * rows.size * 4
