"""Scoring signals: a 1-D convolutional network with stored statistics, and linear classifiers by MLlib on features.

A signal's score follows from the signal and the weights alone: signals are brought to one length, and each channel is scaled
and shifted by numbers that come with the weights, never by those of the batch at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels, waves


@dataclass(frozen=True)
class Shape:
    """A stem of width 7 and step 2, residual blocks of two convolutions of width 3, the mean over time, and the head.

    ``blocks`` has (channels, step, dilation) of each block; with ``hidden`` the head has a layer of that size.
    """

    base: int = 16
    blocks: tuple[tuple[int, int, int], ...] = ((32, 2, 1), (64, 2, 1), (128, 2, 1))
    hidden: int = 0
    classes: int = 2
    length: int = 5292


#: The larger network: steps and channels double in every other block, dilations go 1, 2, 4 and over again.
LARGE = Shape(32, ((32, 1, 1), (64, 2, 2), (64, 1, 4), (128, 2, 1)), 128)

Weights = dict[str, np.ndarray]


def initial(shape: Shape, seed: int) -> Weights:
    """Seeded weights: convolutions (.w), and a scale and a shift for each of their channels."""
    rng = np.random.default_rng(seed)
    w: Weights = {}

    def conv(name: str, o: int, i: int, k: int) -> None:
        w[f"{name}.w"] = rng.normal(0, np.sqrt(2 / (i * k)), (o, i, k)).astype(np.float32)
        w[f"{name}.scale"], w[f"{name}.shift"] = np.ones(o, np.float32), np.zeros(o, np.float32)

    conv("stem", shape.base, 1, 7)
    c = shape.base
    for b, (o, step, _) in enumerate(shape.blocks):
        conv(f"b{b}.1", o, c, 3)
        conv(f"b{b}.2", o, o, 3)
        if step != 1 or o != c:
            conv(f"b{b}.skip", o, c, 1)
        c = o
    for name, o in [("hidden", shape.hidden)] * bool(shape.hidden) + [("out", shape.classes)]:
        w[f"{name}.w"], w[f"{name}.b"] = rng.normal(0, 1 / np.sqrt(c), (o, c)).astype(np.float32), np.zeros(o, np.float32)
        c = o
    return w


def folded(w: Weights, name: str, bias, gamma, beta, mean, var, eps: float = 1e-5) -> Weights:
    """The weights with a convolution's bias and the stored statistics of its normalisation as scale and shift."""
    scale = np.asarray(gamma) / np.sqrt(np.asarray(var) + eps)
    return w | {f"{name}.scale": scale.astype(np.float32), f"{name}.shift": (np.asarray(beta) + (np.asarray(bias) - mean) * scale).astype(np.float32)}


def n_parameters(weights: Weights) -> int:
    return sum(w.size for w in weights.values())


def save(weights: Weights, path: str) -> None:
    np.savez(path, **weights)


def load(path: str) -> Weights:
    """Weights of an .npz file."""
    with np.load(path, allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def shape_of(weights: Weights, length: int = 22050) -> Shape:
    """The shape that weights fit. Channels, blocks, hidden layer and classes are read from their sizes; steps and dilations,
    which leave no trace in them, are those of the larger network where there is a hidden layer, of the smaller one else."""
    base, hidden = weights["stem.w"].shape[0], weights["hidden.w"].shape[0] if "hidden.w" in weights else 0
    out = []
    while (name := f"b{len(out)}.1.w") in weights:
        b = len(out)
        step, dilation = (2 if b % 2 else 1, 2 ** (b % 3)) if hidden else (2, 1)
        out.append((weights[name].shape[0], step, dilation))
    found = Shape(base, tuple(out), hidden, weights["out.w"].shape[0], length)
    last = out[-1][0] if out else base
    fits = all(weights[f"b{b}.1.w"].shape == (o, i, 3) and (f"b{b}.skip.w" in weights) == (step != 1 or o != i) for b, ((o, step, _), i) in enumerate(zip(out, [base, *(o for o, _, _ in out)])))
    if weights["stem.w"].shape != (base, 1, 7) or not fits or weights["hidden.w" if hidden else "out.w"].shape[1] != last:
        raise ValueError("weights of no known network")
    return found


def convolved(w: Weights, name: str, x: np.ndarray, step: int = 1, dilation: int = 1) -> np.ndarray:
    """(batch, channel, time), padded with zeros to keep the length before the step, then scaled and shifted."""
    k = w[f"{name}.w"].shape[2]
    pad = (k - 1) * dilation // 2
    x = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
    v = np.lib.stride_tricks.sliding_window_view(x, (k - 1) * dilation + 1, axis=2)[:, :, ::step, ::dilation]
    y = np.einsum("bctk,ock->bot", v, w[f"{name}.w"], optimize=True)
    return y * w[f"{name}.scale"][:, None] + w[f"{name}.shift"][:, None]


def pooled(w: Weights, shape: Shape, x: np.ndarray) -> np.ndarray:
    """Means over time of the last block's channels, for signals (batch, time)."""
    h = np.maximum(convolved(w, "stem", x[:, None, :], 2), 0)
    for b, (_, step, dilation) in enumerate(shape.blocks):
        y = np.maximum(convolved(w, f"b{b}.1", h, step, dilation), 0)
        y = convolved(w, f"b{b}.2", y, 1, dilation)
        h = np.maximum(y + (convolved(w, f"b{b}.skip", h, step) if f"b{b}.skip.w" in w else h), 0)
    return h.mean(axis=2)


def forward(w: Weights, shape: Shape, x: np.ndarray) -> np.ndarray:
    """Class probabilities (batch, class) of signals (batch, time)."""
    h = pooled(w, shape, x)
    if "hidden.w" in w:
        h = np.maximum(h @ w["hidden.w"].T + w["hidden.b"], 0)
    logits = h @ w["out.w"].T + w["out.b"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def in_blocks(x: pa.Array, length: int, f, rows: int = 32) -> np.ndarray:
    """``f`` of the signals of an Arrow column, all of ``length`` samples, as matrices of a few rows."""
    m = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, length).astype(np.float64)
    return np.concatenate([f(m[a : a + rows]) for a in range(0, len(m), rows)])


def score(weights: Weights, samples: Column, shape: Shape = Shape()) -> Column:
    """Probability of class 1 of each signal, centred in ``shape.length`` samples with zeros around; longer ones keep their
    head, and a null is silence."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(in_blocks(x, shape.length, lambda m: forward(weights, shape, m)[:, 1]) if len(x) else [], pa.float64())

    return run(waves.padded(F.coalesce(samples.cast("array<double>"), F.array().cast("array<double>")), shape.length))


def score_around(weights: Weights, samples: Column, at: Column, shape: Shape = Shape()) -> Column:
    """Probability of class 1 of the standardised window of ``shape.length`` samples around position ``at`` of each signal,
    mirrored beyond its ends; null for an empty signal."""

    @F.arrow_udf("double")
    def run(x: pa.Array, at: pa.Array) -> pa.Array:
        out: list[float | None] = [None] * len(x)
        rows = [i for i, v in enumerate(x) if v.is_valid and len(v.values)]
        for a in range(0, len(rows), 32):
            block = rows[a : a + 32]
            m = np.stack([kernels.standardized(kernels.mirrored(x[i].values.to_numpy(zero_copy_only=False).astype(np.float64), at[i].as_py(), shape.length // 2)) for i in block])
            for i, p in zip(block, forward(weights, shape, m)[:, 1].tolist()):
                out[i] = p
        return pa.array(out, pa.float64())

    return run(samples, at)


def activations(weights: Weights, samples: Column, shape: Shape = Shape()) -> Column:
    """The means over time that the head reads, as an array."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return pa.array(list(in_blocks(x, shape.length, lambda m: pooled(weights, shape, m))) if len(x) else [], pa.list_(pa.float64()))

    return run(waves.padded(F.coalesce(samples.cast("array<double>"), F.array().cast("array<double>")), shape.length))


def class_weight(df: DataFrame, label: str) -> Column:
    """Weights under which all classes weigh the same; as many as there are classes."""
    n = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).collect()}
    out = F
    for k, c in n.items():
        out = out.when(F.col(label) == k, F.lit(sum(n.values()) / len(n) / c))
    return out.otherwise(F.lit(1.0)) if n else F.lit(1.0)


def train_head(df: DataFrame, samples: str, label: str, weights: Weights, shape: Shape, steps: int = 100, penalty: float = 1e-3) -> Weights:
    """The weights with a head of two classes that MLlib fits on the convolutions' means. Classes weigh the same; the work is
    Spark's, and only the head's numbers come to the driver. The convolutions stay as they are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(activations(weights, F.col(samples), shape)).alias("f"), F.col(label).cast("double").alias("y"), class_weight(df, label).alias("w"))
    fit = LogisticRegression(featuresCol="f", labelCol="y", weightCol="w", maxIter=steps, regParam=penalty).fit(rows)
    w = {k: v for k, v in weights.items() if not k.startswith(("hidden", "out"))}
    return w | {"out.w": np.stack([np.zeros(len(fit.coefficients)), fit.coefficients.toArray()]), "out.b": np.array([0.0, fit.intercept])}


def train_linear(df: DataFrame, features: list[str], label: str, steps: int = 50, penalty: float = 0.01):
    """A weighted logistic regression on feature columns; classes weigh equally."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="_f"), StandardScaler(inputCol="_f", outputCol="_s"), LogisticRegression(featuresCol="_s", labelCol=label, weightCol="_w", maxIter=steps, regParam=penalty)]
    return Pipeline(stages=stages).fit(df.withColumn("_w", class_weight(df, label)))


def apply_linear(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("_f", "_s", "rawPrediction", "probability", "prediction")


def predictions(scored: DataFrame, path: str, label: str, threshold: float = 0.5) -> DataFrame:
    """file_path, true_label, predicted_label, confidence, correct."""
    p = (F.col("score") >= threshold).cast("int")
    return scored.select(F.col(path).alias("file_path"), F.col(label).alias("true_label"), p.alias("predicted_label"), F.when(p == 1, F.col("score")).otherwise(1 - F.col("score")).alias("confidence"), (p == F.col(label)).alias("correct"))
