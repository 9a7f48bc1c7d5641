"""Queries without SQL take all dimensions of their table and the operators' own draws."""

import random

import pytest

from urbanpulse.catalog import anomalies, spatial


@pytest.fixture
def folder(spark, tmp_path):
    """Vectors that are alike in all dimensions but the sixth; one of them far off there."""
    rng = random.Random(1)
    rows = [(i, [rng.random() * 1e-3 if d != 5 else 10.0 * (i % 2) for d in range(8)], 0) for i in range(300)]
    rows[7] = (7, [*rows[7][1][:5], 500.0, *rows[7][1][6:]], 0)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_forest_over_all_dimensions(spark, folder):
    scores = {r.vec_id: r.if_score for r in anomalies.iforest_vectors(spark, folder).collect()}
    assert len(scores) == 300 and min(scores.values()) < max(scores.values())
    assert scores[7] in (min(scores.values()), max(scores.values()))


def test_zones_over_all_dimensions(spark, folder):
    sizes = [r.n_stops for r in spatial.kmeans_stop_zones(spark, folder).collect()]
    assert sum(sizes) == 300 and 1 in sizes  # the far one is a zone of its own


def test_reports_use_the_operators_draws(spark, monkeypatch):
    asked = []
    for name in ("spatial_report", "zonal_correlations"):
        monkeypatch.setattr(spatial, name, lambda *a, **k: asked.append(k) or {"global": None, 0: None})
    spatial.zonal_report(spark, "/root/testdata/sf0.001")
    spatial.city_window_report(spark, "/root/testdata/sf0.001")
    assert len(asked) == 2 and not {"starts", "permutations"} & {x for k in asked for x in k}
