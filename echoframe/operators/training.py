"""Training of the convolutional network: gradients where the rows are, one step of the optimiser on the driver.

Rows are dealt once, by seeded ranks, to groups of ``group`` rows and to batches of whole groups; a group is one row of a table
that is partitioned by batch, so a step reads its batch and nothing else. Each task adds up the gradients of its groups, and
tasks' sums meet in a few partial sums before they come to the driver; only numbers of the model's size do. Sums are of
fixed-point numbers and a group is normalised by its own statistics, so the weights are the same for any partitioning.

Layers are trained as they are scored (``model.forward``): convolution, normalisation by channel, rectifier, residual blocks,
the mean over time, dropout and the head. The normalisation's running statistics are folded into scale and shift at the end.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import waves
from ..sources.ranges import located
from ..stages import folder, removed
from .model import Shape, Weights, convolved, folded, forward
from .samples import spread

#: Of fixed-point numbers: sums of gradients are whole multiples of 1 / UNIT.
UNIT = float(1 << 36)
EPS = 1e-5


@dataclass(frozen=True)
class Settings:
    batch: int = 128
    group: int = 32
    epochs: int = 100
    rate: float = 1e-3
    decay: float = 1e-4
    betas: tuple[float, float] = (0.9, 0.999)
    dropout: float = 0.3
    momentum: float = 0.1
    #: Epochs without a better loss before the rate is cut by ``cut``, and before training ends.
    plateau: int = 5
    cut: float = 0.5
    patience: int = 10
    #: A loss below the best by this share is better, for the rate.
    margin: float = 1e-4
    seed: int = 0
    save_every: int = 10


@dataclass
class State:
    """Everything that the next epoch depends on."""

    weights: Weights
    best: Weights
    moments: dict[str, np.ndarray] = field(default_factory=dict)
    step: int = 0
    epoch: int = 0
    rate: float = 1e-3
    plateau_best: float = float("inf")
    plateau_bad: int = 0
    best_loss: float = float("inf")
    bad: int = 0
    history: list[dict] = field(default_factory=list)


# Layers


def started(shape: Shape, seed: int) -> Weights:
    """Seeded weights in the form that is trained: .w, .gamma, .beta and the running .mean and .var of each convolution."""
    from .model import initial

    out: Weights = {}
    for k, v in initial(shape, seed).items():
        name, _, kind = k.rpartition(".")
        if kind == "scale":
            out |= {f"{name}.gamma": np.ones(len(v)), f"{name}.beta": np.zeros(len(v)), f"{name}.mean": np.zeros(len(v)), f"{name}.var": np.ones(len(v))}
        elif kind != "shift":
            out[k] = v.astype(np.float64)
    return out


def scored_form(w: Weights) -> Weights:
    """The weights that ``model.forward`` reads: running statistics folded into scale and shift."""
    out = {k: v.astype(np.float32) for k, v in w.items() if k.endswith((".w", ".b"))}
    for name in sorted(k[: -len(".gamma")] for k in w if k.endswith(".gamma")):
        out = folded(out, name, 0.0, *(w[f"{name}.{x}"] for x in ("gamma", "beta", "mean", "var")), EPS)
    return out


def learned(w: Weights) -> list[str]:
    """Names of what the optimiser changes, in a fixed order."""
    return sorted(k for k in w if not k.endswith((".mean", ".var")))


class Pass:
    """One group's way through the network and back: the loss's gradient of each weight, and the statistics met."""

    def __init__(self, w: Weights, shape: Shape):
        self.w, self.shape, self.grad, self.seen = w, shape, {}, {}

    def conv(self, name: str, x: np.ndarray, step: int = 1, dilation: int = 1):
        """The normalised convolution, and the function from its gradient to that of ``x``."""
        w, gamma = self.w[f"{name}.w"], self.w[f"{name}.gamma"][:, None]
        k = w.shape[2]
        pad = (k - 1) * dilation // 2
        xp = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
        v = np.lib.stride_tricks.sliding_window_view(xp, (k - 1) * dilation + 1, axis=2)[:, :, ::step, ::dilation]
        y = np.einsum("bctk,ock->bot", v, w, optimize=True)
        mean, var = y.mean(axis=(0, 2)), y.var(axis=(0, 2))
        n = y.shape[0] * y.shape[2]
        self.seen[name] = (mean, var * n / max(1, n - 1))
        root = 1 / np.sqrt(var + EPS)[:, None]
        unit = (y - mean[:, None]) * root

        def back(d: np.ndarray) -> np.ndarray:
            self.grad[f"{name}.gamma"], self.grad[f"{name}.beta"] = (d * unit).sum(axis=(0, 2)), d.sum(axis=(0, 2))
            e = d * gamma
            dy = root * (e - e.mean(axis=(0, 2), keepdims=True)[0] - unit * (e * unit).mean(axis=(0, 2), keepdims=True)[0])
            self.grad[f"{name}.w"] = np.einsum("bctk,bot->ock", v, dy, optimize=True)
            dx = np.zeros_like(xp)
            for t in range(k):
                a = t * dilation
                dx[:, :, a : a + step * (dy.shape[2] - 1) + 1 : step] += np.einsum("bot,oc->bct", dy, w[:, :, t], optimize=True)
            return dx[:, :, pad : pad + x.shape[2]]

        return unit * gamma + self.w[f"{name}.beta"][:, None], back

    def rectified(self, name: str, x: np.ndarray, step: int = 1, dilation: int = 1):
        y, back = self.conv(name, x, step, dilation)
        return np.maximum(y, 0), lambda d: back(d * (y > 0))

    def block(self, b: int, x: np.ndarray, step: int, dilation: int):
        h, first = self.rectified(f"b{b}.1", x, step, dilation)
        y, second = self.conv(f"b{b}.2", h, 1, dilation)
        side, across = self.conv(f"b{b}.skip", x, step) if f"b{b}.skip.w" in self.w else (x, lambda d: d)
        y = y + side

        def back(d: np.ndarray) -> np.ndarray:
            d = d * (y > 0)
            return first(second(d)) + across(d)

        return np.maximum(y, 0), back

    def dense(self, name: str, x: np.ndarray):
        w = self.w[f"{name}.w"]

        def back(d: np.ndarray) -> np.ndarray:
            self.grad[f"{name}.w"], self.grad[f"{name}.b"] = d.T @ x, d.sum(axis=0)
            return d @ w

        return x @ w.T + self.w[f"{name}.b"], back

    def run(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray, kept: np.ndarray | None = None) -> tuple[float, int]:
        """Sum of the weighted losses (whose gradients are then in ``grad``) and number of right answers."""
        h, back = self.rectified("stem", x[:, None, :], 2)
        backs = [back]
        for b, (_, step, dilation) in enumerate(self.shape.blocks):
            h, back = self.block(b, h, step, dilation)
            backs.append(back)
        length = h.shape[2]
        p = h.mean(axis=2)
        heads = []
        if kept is not None:
            p = p * kept
        if self.shape.hidden:
            y, back = self.dense("hidden", p)
            p = np.maximum(y, 0)
            heads.append(lambda d, back=back, y=y: back(d * (y > 0)))
        logits, back = self.dense("out", p)
        heads.append(back)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        chance = e / e.sum(axis=1, keepdims=True)
        at = np.arange(len(x))
        each = weight[label]
        loss = float(-(each * np.log(np.maximum(chance[at, label], 1e-300))).sum())
        d = chance.copy()
        d[at, label] -= 1
        d *= each[:, None]
        for back in heads[::-1]:
            d = back(d)
        if kept is not None:
            d = d * kept
        d = np.repeat(d[:, :, None] / length, length, axis=2)
        for back in backs[::-1]:
            d = back(d)
        return loss, int((chance.argmax(axis=1) == label).sum())


# Steps


def vector(parts: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.ravel(parts[k]) for k in sorted(parts)])


def parted(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def group_sums(w: Weights, shape: Shape, x: np.ndarray, label: np.ndarray, weight: np.ndarray, s: Settings, epoch: int, group: int) -> np.ndarray:
    """One group's gradients, statistics, loss, weight, right answers and rows as fixed-point numbers."""
    kept = None
    if s.dropout:
        rng = np.random.default_rng([s.seed, epoch, group])
        channels = shape.blocks[-1][0] if shape.blocks else shape.base
        kept = (rng.random((len(x), channels)) >= s.dropout) / (1 - s.dropout)
    p = Pass(w, shape)
    loss, right = p.run(x, label, weight, kept)
    stats = {f"{n}.{k}": v for n, both in p.seen.items() for k, v in zip(("mean", "var"), both)}
    out = np.concatenate([vector(p.grad), vector(stats), [loss, weight[label].sum(), right, len(x), 1]])
    if not np.isfinite(out).all():
        raise FloatingPointError("training left the range of numbers; lower the rate")
    return np.round(out * UNIT).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for v in b.column("v"):
            x = np.frombuffer(v.as_py(), np.int64)
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def batch_sums(rows: DataFrame, w: Weights, shape: Shape, weight: np.ndarray, s: Settings, epoch: int) -> np.ndarray:
    """The sums over all groups of ``rows`` (group, label, x)."""
    known = rows.sparkSession.sparkContext.broadcast((w, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, weight = known.value
        total = None
        for b in batches:
            for g, y, x in zip(b.column("group").to_pylist(), b.column("label"), b.column("x")):
                label = y.values.to_numpy()
                m = np.frombuffer(x.as_py(), np.float32).astype(np.float64).reshape(len(label), -1)
                v = group_sums(w, shape, m, label, weight, s, epoch, g)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sums = rows.mapInArrow(run, "v binary")
    if (tasks := rows.rdd.getNumPartitions()) > 32:
        sums = sums.repartition(max(8, int(tasks**0.5))).mapInArrow(_sums, "v binary")
    out = sum(np.frombuffer(r.v, np.int64) for r in sums.collect())
    known.destroy()
    return out


def stepped(st: State, grad: dict[str, np.ndarray], s: Settings) -> None:
    """AdamW: moments of the gradients, and decay apart from them."""
    st.step += 1
    a, b = s.betas
    for k, g in grad.items():
        m = st.moments[f"m.{k}"] = a * st.moments.get(f"m.{k}", 0.0) + (1 - a) * g
        v = st.moments[f"v.{k}"] = b * st.moments.get(f"v.{k}", 0.0) + (1 - b) * g * g
        st.weights[k] = st.weights[k] * (1 - st.rate * s.decay) - st.rate * (m / (1 - a**st.step)) / (np.sqrt(v / (1 - b**st.step)) + 1e-8)


def scheduled(st: State, loss: float, s: Settings) -> None:
    """The rate is cut after more than ``plateau`` epochs without a better loss."""
    if loss < st.plateau_best * (1 - s.margin):
        st.plateau_best, st.plateau_bad = float(loss), 0
    else:
        st.plateau_bad += 1
    if st.plateau_bad > s.plateau:
        st.rate, st.plateau_bad = st.rate * s.cut, 0


# Data


@dataclass
class Dealt:
    """Groups in a table with a folder for each batch."""

    spark: SparkSession
    path: str
    batches: int
    schema: str = "group long, label array<int>, x binary"

    def batch(self, b: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={b}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(self.path)


def dealt(rows: DataFrame, samples: str, label: str, key: str, length: int, s: Settings, tasks: int = 8) -> Dealt:
    """``rows`` in groups and batches by seeded ranks, written to the shared folder; signals centred in ``length`` samples with
    zeros around, longer ones by their head. ``tasks``: files of a batch at most."""
    spark = rows.sparkSession
    places = spread(rows.select(key).distinct(), s.seed, key).select(key, F.col("_r").alias("place"))
    x = waves.padded(F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")), length)
    flat = rows.select(key, F.col(label).cast("int").alias("y"), x.cast("array<float>").alias("x")).join(places, key)
    flat = flat.withColumn("group", F.floor(F.col("place") / s.group).cast("long"))
    packed = flat.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "y", "x"))).alias("r"))  # ``group`` rows each

    @F.arrow_udf("binary")
    def flatten(r: pa.Array) -> pa.Array:
        x = r.values.field("x")
        at = x.offsets.to_numpy()[r.offsets.to_numpy()]
        flat = x.values.to_numpy()
        return pa.array([flat[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())

    per = max(1, s.batch // s.group)
    table = packed.select("group", F.col("r.y").alias("label"), flatten("r").alias("x"), F.floor(F.col("group") / per).cast("long").alias("batch"))
    path = folder(spark, "training")
    table.repartition("batch", (F.col("group") % tasks).alias("part")).write.partitionBy("batch").parquet(path)
    top = spark.read.schema("group long, batch long").parquet(path).agg(F.max("batch")).first()[0]
    return Dealt(spark, path, 0 if top is None else int(top) + 1)


def validated(val: DataFrame, w: Weights, shape: Shape, weight: np.ndarray) -> tuple[float, float]:
    """Weighted mean loss and share of right answers of all groups, without dropout and by running statistics."""
    form = scored_form(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4)
        for b in batches:
            for y, x in zip(b.column("label"), b.column("x")):
                label = y.values.to_numpy()
                p = forward(form, shape, np.frombuffer(x.as_py(), np.float32).astype(np.float64).reshape(len(label), -1))
                each = weight[label]
                total += [-(each * np.log(np.maximum(p[np.arange(len(label)), label], 1e-300))).sum(), each.sum(), (p.argmax(axis=1) == label).sum(), len(label)]
        yield pa.RecordBatch.from_arrays([pa.array([np.round(total * UNIT).astype(np.int64).tobytes()], pa.binary())], ["v"])

    rows = [np.frombuffer(r.v, np.int64) for r in val.mapInArrow(run, "v binary").collect()]  # four numbers a task
    loss, total, right, n = sum(rows) / UNIT if rows else np.zeros(4)
    return (loss / total if total else float("nan")), (right / n if n else float("nan"))


# Training


def fit(train: DataFrame, val: DataFrame, samples: str, label: str, key: str, shape: Shape, s: Settings = Settings(), classes: np.ndarray | None = None, checkpoints: str | None = None, resume: bool = False) -> State:
    """Trains to the last epoch or until ``patience`` epochs brought no better loss over ``val``; ``best`` has the weights of the
    best epoch. ``classes``: each class's weight in the loss (1 without). With ``checkpoints`` the state goes to
    ``last.npz`` there every ``save_every`` epochs and at the end, the best one to ``best.npz``; ``resume`` goes on from the last.

    Repeated keys are one place of the order, so a row that is repeated stays in its group; no row is an error.
    """
    weight = np.ones(shape.classes) if classes is None else np.asarray(classes, float)
    w = started(shape, s.seed)
    st = State(w, dict(w), rate=s.rate)
    if resume and checkpoints and (found := restored(f"{checkpoints}/last.npz")):
        st = found
    made = []
    try:
        made += [dealt(train, samples, label, key, shape.length, s)]
        made += [dealt(val, samples, label, key, shape.length, s)]
        if not made[0].batches:
            raise ValueError("no rows to train on")
        _epochs(st, *made, shape, s, weight, checkpoints)
    finally:
        for x in made:
            removed(x.spark, x.path)
    return st


def _epochs(st: State, data: Dealt, held: Dealt, shape: Shape, s: Settings, weight: np.ndarray, checkpoints: str | None) -> None:
    while st.epoch < s.epochs and st.bad < s.patience:
        losses, right, n = [], 0.0, 0.0
        for b in np.random.default_rng([s.seed, st.epoch]).permutation(data.batches).tolist():
            got = batch_sums(data.batch(b), st.weights, shape, weight, s, st.epoch) / UNIT
            loss, total, hits, rows, groups = got[-5:]
            names = learned(st.weights)
            grads = parted(got[:-5], {f"0{k}": st.weights[k] for k in names} | {f"1{k}": v for k, v in st.weights.items() if k not in names})
            stepped(st, {k: grads[f"0{k}"] / total for k in names}, s)
            for k in set(st.weights) - set(names):
                st.weights[k] = (1 - s.momentum) * st.weights[k] + s.momentum * grads[f"1{k}"] / groups
            losses, right, n = [*losses, loss / total], right + hits, n + rows
        val_loss, val_right = validated(held.all(), st.weights, shape, weight) if held.batches else (float(np.mean(losses)), right / n)
        scheduled(st, val_loss, s)
        st.epoch += 1
        st.history.append({"epoch": st.epoch, "train_loss": float(np.mean(losses)), "train_acc": float(right / n), "val_loss": float(val_loss), "val_acc": float(val_right), "rate": st.rate})
        if val_loss < st.best_loss:
            st.best_loss, st.bad, st.best = float(val_loss), 0, dict(st.weights)
            if checkpoints:
                stored(st, f"{checkpoints}/best.npz")
        else:
            st.bad += 1
        if checkpoints and (st.epoch % s.save_every == 0 or st.epoch == s.epochs or st.bad >= s.patience):
            stored(st, f"{checkpoints}/last.npz")


PLAIN = ("step", "epoch", "rate", "plateau_best", "plateau_bad", "best_loss", "bad", "history")


def stored(st: State, path: str) -> None:
    """The state as one .npz, put in place when it is whole."""
    out = io.BytesIO()
    arrays = {f"w.{k}": v for k, v in st.weights.items()} | {f"best.{k}": v for k, v in st.best.items()} | {f"o.{k}": v for k, v in st.moments.items()}
    np.savez(out, plain=np.frombuffer(json.dumps({k: getattr(st, k) for k in PLAIN}).encode(), np.uint8), **arrays)
    system, name = located(path)
    system.create_dir(name.rpartition("/")[0])
    with system.open_output_stream(f"{name}.part") as f:
        f.write(out.getvalue())
    system.move(f"{name}.part", name)


def restored(path: str) -> State | None:
    system, name = located(path)
    if system.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(name) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
        of = lambda front: {k[len(front) :]: z[k] for k in z.files if k.startswith(front)}
        return State(of("w."), of("best."), of("o."), **json.loads(z["plain"].tobytes().decode()))
