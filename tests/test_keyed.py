"""Status changes in operator state: equal to the last-write-wins view after every batch and restart."""

import random

import pytest

from gleanery.operators.state import latest_state
from gleanery.streaming.keyed import read_keyed_state, start_keyed_state

CHANGES = "space string, id string, status string, ts long, arrival long"


def state(df):
    return sorted((tuple(r) for r in df.select("space", "id", "status", "ts").collect()), key=repr)


def batches():
    rng = random.Random(5)
    out, arrival = [], 0
    for n in range(4):
        rows = []
        for _ in range(60):
            arrival += 1
            key = "hot" if rng.random() < 0.4 else rng.choice("abcdef")
            # few instants, so that many are equal; later batches bring old ones too
            rows.append((rng.choice(["s", "t"]), key, rng.choice(["seen", "saved", None]), rng.randint(0, 6), arrival))
        rows.append(("s", "late", f"batch {n}", 100 - n, arrival + 1))
        rows.append(("s", "tie", f"batch {n}", 7, arrival + 2))
        rows.append(("s", f"only {n}", "", None, arrival + 3))
        arrival += 3
        out.append(rows)
    return out


def test_equals_the_batch_view_after_every_restart(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    provider = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(provider, None)
    assert state(read_keyed_state(spark, checkpoint)) == []
    came, after = [], []
    for rows in batches():
        came += rows
        spark.createDataFrame(rows, CHANGES).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(CHANGES).parquet(folder)
        start_keyed_state(stream, checkpoint).awaitTermination()  # each start goes on from the checkpoint
        after.append(state(latest_state(spark.createDataFrame(came, CHANGES))))
        assert state(read_keyed_state(spark, checkpoint)) == after[-1]
    kept = {r[1]: r[2] for r in after[-1]}
    assert kept["late"] == "batch 0" and kept["tie"] == "batch 0"
    assert state(read_keyed_state(spark, checkpoint, batch=1)) == after[1]
    assert spark.conf.get(provider, None) == own


def test_a_start_without_new_rows_changes_nothing(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    spark.createDataFrame(batches()[0], CHANGES).write.parquet(folder)
    for _ in range(2):
        start_keyed_state(spark.readStream.schema(CHANGES).parquet(folder), checkpoint).awaitTermination()
    assert state(read_keyed_state(spark, checkpoint)) == state(latest_state(spark.createDataFrame(batches()[0], CHANGES)))


@pytest.mark.parametrize("key", [None, "a"])
def test_null_keys_are_keys(spark, tmp_path, key):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows = [(None, key, "x", 1, 1), (None, key, "y", 2, 2), ("s", key, "z", 1, 3)]
    spark.createDataFrame(rows, CHANGES).write.parquet(folder)
    start_keyed_state(spark.readStream.schema(CHANGES).parquet(folder), checkpoint).awaitTermination()
    assert set(state(read_keyed_state(spark, checkpoint))) == {(None, key, "y", 2), ("s", key, "z", 1)}
