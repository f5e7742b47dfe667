"""Inference as a DataFrame operator: one float column for each model output."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.ml.evaluate import evaluate, parameters
from lodestone.ml.graph import Graph
from lodestone.ml.rules import optimize
from lodestone.ml.shape import infer, mixes_rows

BATCH = 4096


class MixesRows(ValueError):
    """The model's result for a row depends on other rows, so that it cannot run row by row."""


def _matrix(column: pa.Array, width: int | None) -> np.ndarray:
    """A batch of scalars or of arrays of one length; NULL, and NULL inside arrays, is 0. ``width``: their length where all are NULL."""
    if pa.types.is_list(column.type):
        there = column.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)[there]
        width = int(sizes[0]) if len(sizes) else width or 0
        if (sizes != width).any():
            raise ValueError("arrays of several lengths")
        out = np.zeros((len(column), width), np.float32)
        out[there] = column.flatten().cast(pa.float32()).fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(sizes), width)
        return out
    return column.cast(pa.float32()).fill_null(0.0).to_numpy(zero_copy_only=False)


def predict(df: DataFrame, graph: Graph, inputs: dict[str, Column]) -> DataFrame:
    """``df`` with a float column for each output of the graph.

    Inputs are numbers, or arrays for inputs with a further dimension. Rows are batched inside
    their partitions, so nothing moves; a graph whose outputs mix rows is refused.
    """
    if mixes_rows(graph, list(graph.outputs)):
        raise MixesRows("; ".join(graph.outputs))
    fast = optimize(graph)
    names, outputs = list(inputs), list(graph.outputs)
    shapes = infer(graph)
    rank = {n: len(shapes[i]) for n, i in graph.named("Input").items()}
    width = {n: shapes[i][1] for n, i in graph.named("Input").items() if len(shapes[i]) == 2 and isinstance(shapes[i][1], int)}
    wide = {o: shapes[graph.outputs[o]] for o in outputs}
    array = {o: len(s) > 1 and s[-1] != 1 for o, s in wide.items()}
    fed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        *[c.cast("array<float>" if rank.get(n, 1) > 1 and isinstance_array(df, c) else "float").alias(f"in{i}") for i, (n, c) in enumerate(inputs.items())],
    )
    shared = df.sparkSession.sparkContext.broadcast((fast, parameters(fast)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, params = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                values = {}
                for i, n in enumerate(names):
                    x = _matrix(part.column(f"in{i}"), width.get(n))
                    values[n] = x[:, None] if rank.get(n, 1) > 1 and x.ndim == 1 else x
                got = evaluate(model, values, params)
                columns = [part.column("row")]
                for o in outputs:
                    y = np.broadcast_to(got[o], (part.num_rows, *np.shape(got[o])[1:])) if np.ndim(got[o]) else np.full(part.num_rows, got[o])
                    y = np.ascontiguousarray(y.reshape(part.num_rows, -1), np.float32)
                    columns.append(pa.array(list(y), pa.list_(pa.float32())) if array[o] else pa.array(y[:, 0], pa.float32()))
                yield pa.RecordBatch.from_arrays(columns, names=["row", *outputs])

    kinds = ", ".join(f"`{o}` {'array<float>' if array[o] else 'float'}" for o in outputs)
    row = fed.schema["row"].dataType.simpleString()
    return fed.mapInArrow(run, f"row {row}, {kinds}").select("row.*", *[F.col(f"`{o}`") for o in outputs])


def isinstance_array(df: DataFrame, c: Column) -> bool:
    return df.select(c.alias("x")).schema["x"].dataType.typeName() == "array"
