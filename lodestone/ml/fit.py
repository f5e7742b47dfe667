"""Training as a DataFrame operator: full-batch gradient descent, one row of history an epoch.

Each epoch is one pass: every partition evaluates loss and gradients of its rows, weighted by
their number, and the driver adds the partial sums, whose size is the model's. Rows never
leave their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.ml.autograd import gradients
from lodestone.ml.evaluate import evaluate, parameters
from lodestone.ml.graph import LOSSES, Graph
from lodestone.ml.predict import MixesRows, _matrix, isinstance_array
from lodestone.ml.rules import optimize
from lodestone.ml.shape import infer, mixes_rows


class Sgd:
    def __init__(self, rate: float):
        self.rate = rate

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        for name, g in grads.items():
            params[name] = (params[name] - self.rate * g).astype(np.float32)


class Adam:
    """The step counter advances once an epoch, whatever the number of parameters."""

    def __init__(self, rate: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.rate, self.b1, self.b2, self.eps, self.t = rate, b1, b2, eps, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, g in grads.items():
            m = self.m[name] = self.b1 * self.m.get(name, 0.0) + (1 - self.b1) * g
            v = self.v[name] = self.b2 * self.v.get(name, 0.0) + (1 - self.b2) * g * g
            params[name] = (params[name] - self.rate * (m / (1 - self.b1**self.t)) / (np.sqrt(v / (1 - self.b2**self.t)) + self.eps)).astype(np.float32)


@dataclass
class Fitted:
    """``history``: (epoch, loss) from 1; ``graph``: the model with its trained values."""

    history: DataFrame
    graph: Graph


def fit(
    df: DataFrame, graph: Graph, inputs: dict[str, Column], loss: str = "loss", epochs: int = 10, rate: float = 0.01, optimizer: str = "sgd"
) -> Fitted:
    """Train the parameters that the output ``loss`` depends on; an empty input trains nothing.

    The loss node reduces over rows by mean or sum; apart from it the graph must not mix rows.
    NULL inputs are 0, as in ``predict``.
    """
    spark = df.sparkSession
    node = graph.nodes[graph.outputs[loss]]
    if node.op not in LOSSES or node.get("reduction", "mean") == "none":
        raise ValueError("the loss must be a loss operation that reduces by mean or sum")
    before = Graph(graph.nodes, {f"in{i}": j for i, j in enumerate(node.inputs)}, graph.values)
    if mixes_rows(before, list(before.outputs)):
        raise MixesRows(loss)
    mean = node.get("reduction", "mean") == "mean"
    names = list(inputs)
    shapes = infer(graph)
    rank = {n: len(shapes[i]) for n, i in graph.named("Input").items()}
    width = {n: shapes[i][1] for n, i in graph.named("Input").items() if len(shapes[i]) == 2 and isinstance(shapes[i][1], int)}
    only = graph.copy()
    only.outputs = {loss: graph.outputs[loss]}
    both = optimize(gradients(only, loss))
    wanted = [k for k in both.outputs if k.startswith("grad/")]
    fed = df.select(
        *[c.cast("array<float>" if rank.get(n, 1) > 1 and isinstance_array(df, c) else "float").alias(f"in{i}") for i, (n, c) in enumerate(inputs.items())]
    ).persist(StorageLevel.MEMORY_AND_DISK)
    params = parameters(graph)
    update = {"sgd": Sgd, "adam": Adam}[optimizer](rate)
    history: list[tuple[int, float]] = []
    try:
        for epoch in range(1, epochs + 1):
            shared = spark.sparkContext.broadcast((both, params))

            def part(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                model, now = shared.value
                total, rows = None, 0
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    values = {}
                    for i, n in enumerate(names):
                        x = _matrix(batch.column(f"in{i}"), width.get(n))
                        values[n] = x[:, None] if rank.get(n, 1) > 1 and x.ndim == 1 else x
                    got = evaluate(model, values, now)
                    weight = batch.num_rows if mean else 1
                    own = {k: np.asarray(v, np.float64) * weight for k, v in got.items()}
                    total = own if total is None else {k: total[k] + own[k] for k in own}
                    rows += batch.num_rows
                if total is not None:
                    yield pa.RecordBatch.from_pydict(
                        {"name": list(total), "rows": [rows] * len(total), "value": [np.asarray(v, "<f8").tobytes() for v in total.values()]}
                    )

            sums: dict[str, np.ndarray] = {}
            rows = 0
            for r in fed.mapInArrow(part, "name string, rows long, value binary").collect():
                value = np.frombuffer(bytes(r["value"]), "<f8")
                sums[r["name"]] = sums[r["name"]] + value if r["name"] in sums else value
                rows += r["rows"] if r["name"] == loss else 0
            if not rows:
                break
            scale = 1 / rows if mean else 1.0
            history.append((epoch, float(sums[loss][0] * scale)))
            update.step(params, {k[5:]: (sums[k] * scale).reshape(params[k[5:]].shape).astype(np.float32) for k in wanted})
            shared.destroy()
    finally:
        fed.unpersist()
    trained = graph.copy()
    trained.values = {k: v.tolist() for k, v in params.items()}
    return Fitted(spark.createDataFrame(history, "epoch int, loss double"), trained)
