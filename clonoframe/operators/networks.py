"""Small networks on vectors, trained by mini-batches over tables: classifier heads and autoencoders.

A network is a stack of dense layers with tanh between them. Rows are dealt to mini-batches by a seeded hash of their key and the epoch, so a batch is the same set of rows wherever they lie. A
step is one aggregation: tasks turn their rows of the batch into gradients, and one partial sum a task is added up; the parameters travel with the task. Adam's moments
stay on the driver, as large as the network. The rate falls by half a cosine over all steps. After each epoch the whole state can be stored, and
a run with the same arguments goes on from the last stored epoch.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..sources.repertoire import list_files
from ..state import checkpointed
from . import blocks


@dataclass
class Network:
    """Dense layers of the given widths; parameters are one flat array."""

    widths: tuple[int, ...]
    parameters: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def new(cls, widths: tuple[int, ...], seed: int = 0) -> Network:
        """Weights of variance 1 / inputs, zero offsets."""
        rng = np.random.default_rng(seed)
        parts = [np.concatenate([rng.normal(scale=n**-0.5, size=n * m), np.zeros(m)]) for n, m in zip(widths, widths[1:], strict=False)]
        return cls(tuple(widths), np.concatenate(parts))

    def layers(self, flat: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, at, out = self.parameters if flat is None else flat, 0, []
        for n, m in zip(self.widths, self.widths[1:], strict=False):
            out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
            at += n * m + m
        return out

    def forward(self, x: np.ndarray, upto: int | None = None) -> list[np.ndarray]:
        """Values before the first and after each layer (``upto`` of them); the last layer of the network is linear."""
        values, layers = [x], self.layers()
        for k, (w, b) in enumerate(layers[:upto]):
            y = values[-1] @ w + b
            values.append(y if k == len(layers) - 1 else np.tanh(y))
        return values

    def backward(self, values: list[np.ndarray], slope: np.ndarray) -> np.ndarray:
        """The gradient of the parameters, from the loss's slope at the output."""
        parts = []
        for k, (w, _) in reversed(list(enumerate(self.layers()))):
            if k < len(self.widths) - 2:
                slope = slope * (1 - values[k + 1] ** 2)
            parts.append(np.concatenate([(values[k].T @ slope).ravel(), slope.sum(axis=0)]))
            slope = slope @ w.T
        return np.concatenate(parts[::-1])


def logistic(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed cross entropy of one logit with labels 0 and 1, and its slope."""
    z = out[:, 0]
    return float((np.logaddexp(0, z) - y[:, 0] * z).sum()), (1 / (1 + np.exp(-z)) - y[:, 0])[:, None]


def squared(out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the summed squared error, and its slope."""
    return float(((out - y) ** 2).sum() / 2), out - y


LOSSES: dict[str, Callable] = {"logistic": logistic, "squared": squared}


def loss_and_gradient(net: Network, x: np.ndarray, y: np.ndarray, loss: str) -> np.ndarray:
    """Gradient, summed loss and rows, as one flat array."""
    values = net.forward(x)
    value, slope = LOSSES[loss](values[-1], y)
    return np.concatenate([net.backward(values, slope), [value, len(x)]])


def cosine_rate(step: int, steps: int, rate: float) -> float:
    return rate * (1 + np.cos(np.pi * step / steps)) / 2


@dataclass
class Adam:
    first: np.ndarray
    second: np.ndarray
    step: int = 0

    def move(self, parameters: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        return parameters - rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)


def _store(spark: SparkSession, folder: str, epoch: int, net: Network, adam: Adam, told: dict) -> None:
    arrays = {k: base64.b64encode(v.astype("<f8").tobytes()).decode() for k, v in (("parameters", net.parameters), ("first", adam.first), ("second", adam.second))}
    text = json.dumps({"epoch": epoch, "widths": net.widths, "losses": net.losses, "step": adam.step, "told": told} | arrays)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/epoch={epoch:06d}")


def load(spark: SparkSession, folder: str) -> tuple[int, Network, Adam, dict] | None:
    """The last whole epoch below a folder: (epoch, network, optimiser, what the run was told); None if there is none."""
    done = sorted(p.rsplit("/", 2)[1] for p in list_files(spark, folder, "_SUCCESS"))
    if not done:
        return None
    got = json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/{done[-1]}").collect()))
    arrays = {k: np.frombuffer(base64.b64decode(got[k]), "<f8").copy() for k in ("parameters", "first", "second")}
    return got["epoch"], Network(tuple(got["widths"]), arrays["parameters"], got["losses"]), Adam(arrays["first"], arrays["second"], got["step"]), got["told"]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, x, y, n): the rows of each mini-batch in a partition, which come sorted by it, as two arrays of bytes."""

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        x, y = (np.concatenate([blocks.matrix(h.column(c)) for h in held]) for c in (1, 2))
        values = [held[0].column(0)[0].as_py()], [x.astype("<f8").tobytes()], [y.astype("<f8").tobytes()], [len(x)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["b", "x", "y", "n"])

    now, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        for p, q in zip(starts, [*starts[1:], len(keys)], strict=True):
            if keys[p] != now:
                if held:
                    yield row(held)
                now, held = keys[p], []
            held.append(batch.slice(p, q - p))
    if held:
        yield row(held)


#: Most rows of a mini-batch in one task.
PART = 4096


def fit(
    rows: DataFrame, net: Network, loss: str, epochs: int, batch: int = 256, rate: float = 1e-3, seed: int = 0, x: str = "vec", y: str = "target", key: str = "id", folder: str | None = None,
) -> Network:
    """``net`` trained on ``rows`` (key, x and y as arrays of numbers). ``net.losses``: the mean loss of each epoch, before each step.

    ``batch``: rows of a mini-batch, on average. ``folder``: where each epoch is stored; a stored run is continued if it was told the same, else it is a ValueError.
    """
    spark = rows.sparkSession
    array = lambda c: F.col(c).cast("array<double>")
    held = checkpointed(rows.select(F.col(key).alias("key"), array(x).alias("x"), array(y).alias("y")))
    n = held.count()
    per_epoch = max(1, round(n / batch))
    told = {"loss": loss, "epochs": epochs, "batch": batch, "rate": rate, "seed": seed, "rows": n}
    size = len(net.parameters)
    adam, start = Adam(np.zeros(size), np.zeros(size)), 0
    if folder and (last := load(spark, folder)):
        if last[3] != told or last[1].widths != net.widths:
            raise ValueError(f"{folder} holds another run")
        start, net, adam = last[0] + 1, last[1], last[2]
    net = Network(net.widths, net.parameters.copy(), list(net.losses))
    # A mini-batch is one partition, or several of PART rows where it is large; a step runs over these only.
    pieces = max(1, -(-batch // PART))
    parts = pieces * min(per_epoch, max(1, -(-n // PART)))
    groups = parts // pieces
    for epoch in range(start, epochs):
        b = F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "key"), F.lit(per_epoch)).cast("int")
        dealt = held.select(b.alias("b"), F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(pieces)).cast("int").alias("piece"), "key", "x", "y")
        dealt = dealt.repartitionById(parts, F.pmod("b", F.lit(groups)) * pieces + F.col("piece")).sortWithinPartitions("b", "key")
        packed = dealt.select("b", "x", "y").mapInArrow(_packed, "b int, x binary, y binary, n int").rdd.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            total = np.zeros(2)
            for k in range(per_epoch):
                now = Network(net.widths, net.parameters)

                def step(rows: Iterator, now=now, k=k) -> Iterator[np.ndarray]:
                    for r in rows:
                        if r["b"] == k:
                            x, y = (np.frombuffer(r[c], "<f8").reshape(r["n"], -1) for c in ("x", "y"))
                            yield loss_and_gradient(now, x, y, loss)

                got = sum(spark.sparkContext.runJob(packed, step, [k % groups * pieces + i for i in range(pieces)]), np.zeros(size + 2))
                if got[-1]:
                    net.parameters = adam.move(net.parameters, got[:-2] / got[-1], cosine_rate(epoch * per_epoch + k, epochs * per_epoch, rate))
                total += got[-2:]
        finally:
            packed.unpersist()
        net.losses.append(float(total[0] / max(total[1], 1)))
        if folder:
            _store(spark, folder, epoch, net, adam, told)
    return net


def apply(rows: DataFrame, net: Network, vec: str = "vec", out: str = "out", upto: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the network's output, or the values after its first ``upto`` layers. Rows without a vector have none."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            known = np.flatnonzero(~col.is_null().to_numpy(zero_copy_only=False))
            values: list = [None] * len(col)
            if len(known):
                for k, v in zip(known.tolist(), shared.value.forward(blocks.matrix(col.take(pa.array(known))), upto)[-1], strict=True):
                    values[k] = v
            yield pa.array(values, pa.list_(pa.float64()))

    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return rows.withColumn(out, F.arrow_udf(run, "array<double>")(F.col(vec).cast("array<double>")))


def autoencoder(rows: DataFrame, width: int, hidden: int = 32, vec: str = "vec", key: str = "id", seed: int = 0, **kw) -> Network:
    """An encoder-decoder of vectors through ``width`` numbers; ``apply(rows, net, upto=2)`` gives these."""
    d = len(rows.select(vec).first()[0])
    return fit(rows.select(key, vec), Network.new((d, hidden, width, hidden, d), seed), "squared", y=vec, x=vec, key=key, seed=seed, **kw)
