"""Rows of all slots are coded once per row: what that writes, and that the codes are the plain ones."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tripwright import fixtures as fx
from tripwright.operators import boosting, clean, models, slots
from tripwright.plans import q_models
from tripwright.plans.phases import build_features

COLS = ("tail", "airline")


@pytest.fixture(scope="module")
def labeled(spark):
    data = [(i, i % 4 if i % 9 else None, i % 3 if i % 5 else None, i * i % 97 / 7 if i % 8 else None, float("nan") if i % 30 == 1 else i % 6 / 2, int(i % 3 == 0)) for i in range(300)]
    return spark.createDataFrame(data, "flight_id long, tail int, airline int, x double, z double, y int")


def plain(encoded, coding):
    frame = encoded.toPandas()
    return sorted(zip(frame.slot, frame.part, frame.flight_id, frame.y, (r.tobytes() for r in coding.codes(frame))))


@pytest.mark.parametrize("cols", [COLS, ()])
def test_codes_equal_those_of_encoded_entries(labeled, cols):
    entries = slots.packed_slots(labeled, [42, 7], k=3, fraction=0.25)
    single = entries.select("flight_id", "y", F.inline("entries"))
    encoded = slots.encode_slots(labeled, single, cols) if cols else labeled.join(single.drop("y"), "flight_id")
    for given in (entries, single, slots.crossfit_slots(labeled, [7], k=3, parts=2)):
        learning = models.learning_rows(labeled, given, cols)
        if "part_of" in given.columns:
            encoded = slots.encode_slots(labeled, given, cols) if cols else labeled.join(given.drop("y"), "flight_id")
        got = rows(learning.coded.select("slot", "part", "flight_id", "y", F.col("codes").cast("binary")))
        assert sorted((*r[:4], bytes(r[4])) for r in got) == plain(encoded, learning.coding)
        train = encoded.filter("part = 'train'").toPandas()
        for name, of_slot in learning.coding.of_slot.items():
            assert of_slot == {s: exact_edges(own[name]) for s, own in train.groupby("slot")}
        assert all(learning.coding.shared[c] == exact_edges(train[c]) for c in ("x", "z"))
        assert learning.coding == boosting.fit_coding(encoded.filter("part = 'train'"), learning.coding.features, [c for c in ("tail", "airline")], [f"te_{c}" for c in cols])


def exact_edges(values):
    known = np.sort(values[~np.isnan(values)].to_numpy())
    return sorted({known[math.ceil((i + 1) / 63 * len(known)) - 1] for i in range(62)})


def test_rows_meet_python_and_disk_once_and_not_once_a_slot(labeled, monkeypatch):
    written = {}
    entries = slots.packed_slots(labeled, [42], k=5)

    def counted(df, stem, write=models.materialize):
        out = write(df, stem)
        written[stem] = out.count()
        return out

    monkeypatch.setattr(models, "materialize", counted)
    models.learning_rows(labeled, entries, COLS)
    assert written.pop("coded") == 5 * 300 and entries.count() == 300
    assert written and max(written.values()) <= 300


def test_only_labeled_rows_become_features_but_all_rows_teach_them(spark):
    sf = "/root/testdata/sf0.001"
    got = q_models.labeled_features(spark, sf)
    whole = clean.labeled_rows(build_features(fx.flights(spark, sf), q_models.SPEC, keep=("flight_id",)))
    assert rows(got) == rows(whole) and got.count() < fx.flights(spark, sf).count()


def test_the_whole_hash_decides_where_its_start_is_shared(labeled, monkeypatch):
    one = rows(slots.nested_slots(labeled, [42], k=3))
    monkeypatch.setattr(slots, "START", 3)
    assert rows(slots.nested_slots(labeled, [42], k=3)) == one
