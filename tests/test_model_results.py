"""Model queries return what their operators compute, not only that they did."""
import pytest

from conftest import rows
from tools.check import compare, connect
from tripwright import fixtures as fx
from tripwright.plans import load_registry, q_models

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["m16_platt_calibration_result", "m17_isotonic_calibration_result"])
def test_calibrated_scores_equal_sql(spark, name):
    status, _, note = compare(spark, connect(SF), load_registry()[name], SF)
    assert status == "ok", note


def test_every_claim_has_its_result_beside_it():
    registry = load_registry()
    claimed = [n for n, q in registry.items() if q.build.__module__ == q_models.__name__ and not n.endswith("_result") and q.sql]
    assert len(claimed) == 10 and all(f"{n}_result" in registry for n in claimed)


def test_searches_have_the_declared_size_and_all_seeds():
    assert q_models.TREES == (10, 25, 50, 75, 100, 150, 300, 600)
    assert q_models.FOREST_SIZE == {"trees": 300, "depth": 12} and len(q_models.TUNING_GRID) == 24
    assert fx.SEEDS == (42, 1, 7)


def test_a_search_returns_its_grid_losses_and_threshold(spark):
    losses = spark.createDataFrame([(3, 0, 0.6), (3, 1, 0.5)], "slot int, config int, log_loss double")
    choices = spark.createDataFrame([(3, 1, 0.3)], "slot int, config int, threshold double")
    names = spark.createDataFrame([(3, 42, 4)], "slot int, seed int, fold int")
    got = q_models.search_rows(losses, choices, names, [{"C": 0.1}, {"C": 1.0}])
    assert rows(got) == [(42, 4, 0, "C=0.1", 0.6, False, 0.3), (42, 4, 1, "C=1.0", 0.5, True, 0.3)]
