"""Clusters of separate groups by each kind."""

import numpy as np
import pytest

from tessera.operators import rules as X


@pytest.mark.parametrize("kind", ["kmeans", "bisecting", "mixture"])
def test_clusters_part_separate_groups(spark, kind):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (20, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    got = {r.id: r.cluster for r in X.clustered(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>"), "v", kind, 3).collect()}
    groups = [{got[i] for i in range(k * 20, k * 20 + 20)} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        X.clustered(spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), "v", "other", 2)
