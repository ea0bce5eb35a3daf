"""Queries of a single forest fit the published number of trees, at MLlib's full depth."""

import pytest

from casesignal.catalog import modeling
from casesignal.plans import train


class Found(Exception):
    pass


@pytest.mark.parametrize(("name", "trees", "leaf"), [("forest_report", 400, 2), ("forest_top_importances", 400, 2), ("forest_multi_vs_single", 500, 1)])
def test_single_forests_have_the_published_size(spark, monkeypatch, name, trees, leaf):
    def caught(*args, **kwargs):
        raise Found(args)

    monkeypatch.setattr(modeling, "_fit_v1", caught)
    monkeypatch.setattr(train, "tune_and_refit", caught)
    with pytest.raises(Found) as found:
        getattr(modeling, name)(spark, "/root/testdata/sf0.001")
    (forest,) = [a for a in found.value.args[0] if hasattr(a, "getNumTrees")]
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (trees, 30, leaf)
