"""Training of the network: gradients, the optimiser, partitions, checkpoints."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.operators import model, training

SMALL = model.Shape(3, ((4, 2, 1), (4, 1, 2)), 5, 2, 40)


def made(n, length=40, seed=1):
    """Signals of two kinds: slow and fast ones."""
    rng = np.random.default_rng(seed)
    t = np.arange(length)
    return [(f"r{i}", int(i % 2), [float(v) for v in np.sin(t * (0.3 if i % 2 else 1.4) + rng.uniform(0, 6)) + rng.normal(0, 0.3, length)]) for i in range(n)]


SCHEMA = "id string, label int, x array<double>"


@pytest.mark.parametrize("shape", [SMALL, model.Shape(3, ((6, 2, 1),), 0, 3, 40)])
@pytest.mark.parametrize("dropped", [False, True])
def test_gradients_equal_finite_differences(shape, dropped):
    rng = np.random.default_rng(2)
    w = {k: v + rng.normal(0, 0.2, v.shape) for k, v in training.started(shape, 3).items()}
    x, label, weight = rng.normal(size=(5, 40)), rng.integers(0, shape.classes, 5), np.arange(1.0, shape.classes + 1)
    kept = (rng.random((5, shape.blocks[-1][0])) > 0.3) / 0.7 if dropped else None
    p = training.Pass(w, shape)
    p.run(x, label, weight, kept)
    assert sorted(p.grad) == training.learned(w)
    loss = lambda v: training.Pass(v, shape).run(x, label, weight, kept)[0]
    for k, g in p.grad.items():
        assert g.shape == w[k].shape
        for i in rng.choice(g.size, min(4, g.size), replace=False):
            step = np.zeros(g.size)
            step[i] = 1e-6
            up, down = (loss(w | {k: w[k] + s * step.reshape(g.shape)}) for s in (1, -1))
            assert abs((up - down) / 2e-6 - g.ravel()[i]) < 1e-4 * (1 + abs(g.ravel()[i])), (k, i)


def test_scored_form_is_the_network_at_rest():
    """By the running statistics of the very rows, forward gives what the trained layers give."""
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(30, 40)), rng.integers(0, 2, 30)
    w = training.started(SMALL, 4)
    for _ in range(2):
        p = training.Pass(w, SMALL)
        loss, _ = p.run(x, label, np.ones(2))
        w |= {f"{n}.{k}": v for n, both in p.seen.items() for k, v in zip(("mean", "var"), both)}
        for n, (_, var) in p.seen.items():  # the loss of the pass is by the biased variance
            w[f"{n}.var"] = var * (1 - 1 / (30 * {"stem": 20}.get(n, 10)))
    chance = model.forward(training.scored_form(w), SMALL, x)
    assert abs(-np.log(chance[np.arange(30), label]).sum() - loss) < 1e-3


def test_optimiser_follows_its_formulas():
    s = training.Settings(rate=0.1, decay=0.2)
    st = training.State({"a": np.array([1.0, -2.0])}, {}, rate=0.1)
    w, m, v = np.array([1.0, -2.0]), 0.0, 0.0
    for t, g in enumerate((np.array([0.5, 1.0]), np.array([-3.0, 0.0]), np.array([0.1, 0.2])), 1):
        training.stepped(st, {"a": g}, s)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * 0.2 * w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(st.weights["a"], w, atol=1e-12)
    st = training.State({}, {}, rate=1.0)
    rates = []
    for loss in [1.0, *[0.99995] * 6, 0.5, *[0.6] * 12]:
        training.scheduled(st, loss, training.Settings())
        rates.append(st.rate)
    assert rates == [1.0] * 6 + [0.5] * 7 + [0.25] * 6 + [0.125]


def test_training_learns_and_no_partition_shows(spark, tmp_path):
    s = training.Settings(batch=32, group=8, epochs=6, rate=0.03, seed=5, save_every=1)
    rows = spark.createDataFrame(made(120), SCHEMA)
    val = spark.createDataFrame(made(40, seed=9), SCHEMA)
    whole = training.fit(rows.repartition(3), val, "x", "label", "id", SMALL, s, checkpoints=str(tmp_path / "a"))
    losses = [h["train_loss"] for h in whole.history]
    assert losses[-1] < 0.5 * losses[0] and whole.history[-1]["val_acc"] > 0.9 and len(losses) == 6
    # two epochs, then the rest from the checkpoint, over other partitions
    two = training.Settings(batch=32, group=8, epochs=2, rate=0.03, seed=5, save_every=1)
    training.fit(rows.repartition(1), val, "x", "label", "id", SMALL, two, checkpoints=str(tmp_path / "b"))
    again = training.fit(rows.orderBy(F.desc("id")).repartition(7), val.repartition(2), "x", "label", "id", SMALL, s, checkpoints=str(tmp_path / "b"), resume=True)
    assert again.history == whole.history and all(np.array_equal(again.weights[k], whole.weights[k]) for k in whole.weights)
    assert all(np.array_equal(training.restored(str(tmp_path / "b/best.npz")).best[k], whole.best[k]) for k in whole.best)
    scored = model.score(training.scored_form(whole.best), F.col("x"), SMALL)
    right = val.select(((scored >= 0.5).cast("int") == F.col("label")).cast("int").alias("y")).agg(F.avg("y")).first()[0]
    assert right > 0.9


def test_training_stops_early_and_weighs_classes(spark):
    odd = [("a", 0, None), ("b", 1, []), ("c", 1, [1.0] * 100), ("c", 0, [0.5] * 3)]  # no signal, a long one, a repeated key
    rows = spark.createDataFrame(made(20) + odd, SCHEMA).withColumns({"group": F.lit(1), "place": F.lit("p"), "y": F.lit(2)})
    s = training.Settings(batch=16, group=8, epochs=50, rate=0.0, dropout=0.0, patience=3, seed=1)
    done = training.fit(rows, rows, "x", "label", "id", SMALL, s, classes=[1.0, 0.0])
    assert 3 < len(done.history) < 50 and done.bad == 3  # only running statistics move, and the loss is at rest soon
    with pytest.raises(ValueError, match="no rows"):
        training.fit(rows.limit(0), rows, "x", "label", "id", SMALL, s)
    alone = training.fit(rows, rows.limit(0), "x", "label", "id", SMALL, training.Settings(batch=16, group=8, epochs=1))
    assert alone.history[0]["val_loss"] == alone.history[0]["train_loss"]


def test_shape_from_weights():
    for shape in (model.Shape(length=22050), model.LARGE, model.Shape(8, ((16, 2, 1), (32, 2, 1)), 0, 4)):
        assert model.shape_of(model.initial(shape, 1), shape.length) == shape
    w = model.initial(model.Shape(), 1)
    with pytest.raises(ValueError, match="no known network"):
        model.shape_of(w | {"b0.1.w": w["b0.1.w"][:, :3]})
