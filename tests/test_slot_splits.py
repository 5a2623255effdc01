"""Splits and encodings of all slots: what they cost, and that they are the plain ones."""
import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripwright import fixtures as fx
from tripwright.operators import slots
from tripwright.plans.phases import PHASES, encode_variants


@pytest.fixture(scope="module")
def labeled(spark):
    return spark.createDataFrame([(i, int(i % 3 == 0), i % 4 if i % 9 else None) for i in range(400)], "flight_id long, y int, tail int")


def plain_slots(seed, k, inner, fraction):
    def order(ids, salt):
        return sorted(ids, key=lambda i: (hashlib.sha256(f"{i}:{salt}".encode()).hexdigest(), i))

    out, classes = set(), {y: [i for i in range(400) if int(i % 3 == 0) == y] for y in (0, 1)}
    for y, ids in classes.items():
        fold = {i: at % k for at, i in enumerate(order(ids, f"fold:{seed}"))}
        for o in range(k):
            outer = [i for i in ids if fold[i] != o]
            held = set(order(outer, f"holdout:{seed + o}")[:round(len(outer) * fraction)])
            train = order([i for i in outer if i not in held], f"fold:{seed}")
            out |= {(i, y, o, "valid", None) for i in ids if fold[i] == o} | {(i, y, o, "holdout", None) for i in held}
            out |= {(i, y, o, "train", at % inner) for at, i in enumerate(train)}
    return out


@pytest.mark.parametrize("fraction", [0, 0.001, 0.3])
def test_slots_equal_plain_hash_orders(labeled, fraction):
    got = slots.nested_slots(labeled, [7, 42], k=4, inner_splits=3, fraction=fraction)
    for at, seed in enumerate((7, 42)):
        mine = got.filter(F.col("seed") == seed)
        assert {tuple(r) for r in mine.select("flight_id", "y", "outer_fold", "part", "inner").collect()} == plain_slots(seed, 4, 3, fraction)
        assert mine.filter(F.col("slot") != F.col("outer_fold") + 4 * at).count() == 0 and mine.count() == 1600


def test_entries_look_their_encodings_up(labeled):
    entries = slots.nested_slots(labeled, [7], k=4)
    encoded = slots.encode_slots(labeled, entries, ["tail"], digits=4)
    whole = slots.encode_slots(labeled, entries, ["tail"])
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    assert rows(encoded, "slot", "flight_id", "te_tail") == rows(whole, "slot", "flight_id", F.round("te_tail", 4))


def test_variants_share_one_split(spark, monkeypatch):
    calls, plain = [], slots.nested_slots
    monkeypatch.setattr(slots, "nested_slots", lambda *a, **k: calls.append(k) or plain(*a, **k))
    out = encode_variants(fx.flights(spark, "/root/testdata/sf0.001"), {n: PHASES[n] for n in ("P3", "P4_te0", "P4_clean")}, seeds=[42], digits=9)
    assert len(calls) == 1 and out.select("variant").distinct().count() == 3
