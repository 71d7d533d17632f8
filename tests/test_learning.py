"""Recurrent model, scaling, splits, evaluation."""

import numpy as np
import pytest

from fairlead.config import Settings, Training, override, snapshot
from fairlead.operators import evaluate, learn, lstm


def test_gradient():
    draw = np.random.default_rng(1)
    model, x, y = lstm.Lstm.fresh(3, 2), draw.normal(size=(5, 4, 4)), draw.normal(size=(5, 4))
    guess, memory = model.forward(x)
    grads = model.backward(2 * (guess - y) / guess.size, memory)
    for name, w in model.weights.items():
        at = tuple(draw.integers(s) for s in w.shape)
        kept = w[at]
        w[at] = kept + 1e-5
        up = lstm.loss(model, x, y)
        w[at] = kept - 1e-5
        down = lstm.loss(model, x, y)
        w[at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-8)


def test_training_lowers_the_loss_and_packs():
    draw = np.random.default_rng(1)
    x = draw.random((200, 6, 4))
    y = x[:, -1] * 0.5 + 0.2
    model = lstm.Lstm.fresh(8, 1)
    before = lstm.loss(model, x, y)
    log = lstm.fit(model, (x, y), (x[:0], y[:0]), Training(epochs=30, dropout=0.0, rate=0.01))
    assert log["best_loss"] < before / 5
    again = lstm.Lstm.unpack(8, model.pack())
    assert np.array_equal(again.forward(x)[0], model.forward(x)[0]) and model.predict(x[0], 15).shape == (15, 4)


@pytest.mark.parametrize("steps", [8, 10, 12, 14])
def test_output_shape(steps):
    assert lstm.Lstm.fresh(16, 0).forward(np.zeros((16, steps, 4)))[0].shape == (16, 4)


def test_no_training_data_leaves_the_model():
    model = lstm.Lstm.fresh(4, 0)
    kept, none = model.pack(), (np.zeros((0, 3, 4)), np.zeros((0, 4)))
    assert lstm.fit(model, none, none, Training())["epochs"] == 0 and model.pack() == kept


def test_random_split_follows_the_seeded_permutation(spark):
    members = spark.createDataFrame([(0, 10 * k) for k in range(23)] + [(1, 5)], "cluster_id int, pos long")
    got = {(r["cluster_id"], r["pos"]): r["split"] for r in learn.split_at_random(members).collect()}
    order = np.random.RandomState(42).permutation(23)
    for k, who in enumerate(order):
        assert got[0, 10 * who] == ("train" if k < 16 else "validation" if k < 19 else "test")


def test_scaling_of_one_value(spark):
    points = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0), (0, 1.0, 4.0, 3.0, 5.0)], "cluster_id int, lon double, lat double, sog double, cog double")
    params = learn.norm_params(points)
    rows = learn.normalize(points, params).orderBy("lat").collect()
    assert rows[0]["lon"] == 0.5 and rows[0]["lat"] == 0 and rows[1]["lat"] == pytest.approx(1)
    back = learn.denormalize(learn.normalize(points, params), params).orderBy("lat").collect()
    assert [r["lat"] for r in back] == pytest.approx([2, 4]) and back[0]["lon"] == 1


def test_equal_tracks_have_no_error(spark):
    df = spark.createDataFrame([(1, k, 0.1 * k, 0.2, 5.0, 350.0) for k in range(3)], "traj_id int, step int, lon double, lat double, sog double, cog double")
    r = evaluate.by_trajectory(evaluate.step_errors(df, df.where("step < 2"))).first()
    assert r["ade"] == r["mde"] == 0 and r["norm_space_fit"] == 1
    assert "ade" in evaluate.markdown({"cluster_id": 1, "ade": 0.5})


def test_settings():
    fresh = override(Settings(), {"cleaning": {"sog_max": 30.0, "nothing": 1}, "unknown": 2, "domain": {"enabled": True}})
    assert fresh.cleaning.sog_max == 30.0 and fresh.with_domain_box().cleaning.box == fresh.domain.box
    assert Settings().with_domain_box() == Settings() and Settings().with_interval(60.0).resampling.seconds == 60.0
    assert '"sog_max": 30.0' in snapshot(fresh)


def test_unequal_and_empty_tracks(spark):
    import math

    from fairlead.operators import evaluate

    rows = "traj_id long, step int, lon double, lat double, sog double, cog double"
    guess, truth = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0, 4.0), (1, 2, 1.0, 2.0, 3.0, 4.0)], rows), spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0, 4.0)], rows)
    assert evaluate.step_errors(guess, truth).count() == 1 and evaluate.step_errors(truth, truth, strict=True).count() == 1
    with pytest.raises(Exception, match="differ in length"):
        evaluate.step_errors(guess, truth, strict=True).collect()
    named = spark.createDataFrame([(1,), (9,)], "traj_id long")
    got = {r["traj_id"]: r for r in evaluate.by_trajectory(evaluate.step_errors(guess, truth), trajectories=named).collect()}
    assert got[1]["ade"] == 0 and math.isnan(got[9]["ade"]) and math.isnan(got[9]["norm_space_fit"])


def test_training_in_single_precision_and_bounded_memory():
    import tracemalloc

    draw = np.random.default_rng(2)
    x, y = draw.random((4000, 8, 4)), draw.random((4000, 4))
    model = lstm.Lstm.fresh(32, 1)
    kinds = set()
    step = model.forward
    model.forward = lambda *a, **b: kinds.add((a[0].dtype.name, len(a[0]) <= 1024)) or step(*a, **b)
    tracemalloc.start()
    lstm.fit(model, (x, y), (x[:0], y[:0]), Training(epochs=1))
    assert kinds == {("float32", True)} and tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    assert all(w.dtype == float for w in model.weights.values())


def test_each_route_trains_in_a_task_of_its_own(spark):
    from pyspark.sql import functions as F

    rows = [(c, ("train", "validation", "test")[k % 3], [[k / 9, 0.5, None if k == 4 else 0.1, c / 5.0]] * (2 + c % 2), [0.1, 0.2, 0.3, k / 9]) for c in range(5) for k in range(9)]
    samples = spark.createDataFrame(rows, "cluster_id int, split string, x array<array<double>>, y array<double>")
    shapes = spark.createDataFrame([(c, 2 + c % 2, 3 + c) for c in range(5)], "cluster_id int, steps int, width int")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 12)  # a hash puts routes 0 and 3 into one task, 2 and 4 into another
    try:
        got = {r["cluster_id"]: r for r in lstm.train_routes(samples, shapes, Training(epochs=2)).withColumn("task", F.spark_partition_id()).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert len({r["task"] for r in got.values()}) == len(got) == 5
    for c, r in got.items():
        assert (r["steps"], r["width"], r["n_train"], r["n_validation"], r["n_test"], r["epochs"]) == (2 + c % 2, 3 + c, 3, 3, 3, 2)
        model = lstm.Lstm.unpack(r["width"], r["weights"])
        own = [(x, y) for g, s, x, y in rows if g == c and s == "test"]
        assert r["test_loss"] == pytest.approx(lstm.loss(model, np.array([x for x, _ in own], float), np.array([y for _, y in own])))
