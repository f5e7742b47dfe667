"""Static shapes: None is a dimension that only the data tell."""

from __future__ import annotations

import math

import numpy as np

from lodestone.ml.graph import LOSSES, Graph, Node

Shape = tuple[int | None, ...]


class ShapeError(ValueError):
    pass


def broadcast(a: Shape, b: Shape) -> Shape:
    out: list[int | None] = []
    for i in range(max(len(a), len(b))):
        x = a[len(a) - 1 - i] if i < len(a) else 1
        y = b[len(b) - 1 - i] if i < len(b) else 1
        if x == 1:
            out.append(y)
        elif y == 1 or x == y:
            out.append(x)
        elif x is None or y is None:
            out.append(y if x is None else x)
        else:
            raise ShapeError(f"{a} and {b} do not broadcast")
    return tuple(reversed(out))


def _same(x: int | None, y: int | None, what: str) -> None:
    if x is not None and y is not None and x != y:
        raise ShapeError(f"{what}: {x} and {y}")


def _matmul(a: Shape, b: Shape) -> Shape:
    if not a or not b:
        raise ShapeError("MatMul of a scalar")
    left, right = (a if len(a) > 1 else (1, *a)), (b if len(b) > 1 else (*b, 1))
    _same(left[-1], right[-2], "MatMul")
    out = broadcast(left[:-2], right[:-2]) + ((left[-2],) if len(a) > 1 else ()) + ((right[-1],) if len(b) > 1 else ())
    return out


def _reduce(n: Node, x: Shape) -> Shape:
    axes = {a % len(x) for a in n.get("axes") or range(len(x))}
    return tuple(1 if i in axes else d for i, d in enumerate(x) if i not in axes or n.get("keep", False))


def _reshape(n: Node, x: Shape) -> Shape:
    shape = [x[i] if d == 0 else d for i, d in enumerate(n.get("shape"))]
    if -1 in shape:
        rest = [d for d in shape if d != -1]
        known = None not in x and None not in rest
        shape[shape.index(-1)] = math.prod(x) // max(1, math.prod(rest)) if known else None
    elif None not in x and None not in shape and math.prod(x) != math.prod(shape):
        raise ShapeError(f"Reshape of {x} to {shape}")
    return tuple(shape)


def _spatial(n: Node, x: Shape, kernel: Shape, channels: int | None, stride_default: Shape | None = None) -> Shape:
    k = len(kernel)
    stride, pads = n.get("stride") or stride_default or (1,) * k, n.get("pads") or (0,) * (2 * k)
    size = [None if d is None else (d + pads[i] + pads[i + k] - kernel[i]) // stride[i] + 1 for i, d in enumerate(x[2:])]
    return (x[0], channels, *size)


def infer_node(n: Node, s: list[Shape]) -> Shape:
    op = n.op
    if op in ("Input", "Parameter"):
        return tuple(n.get("shape"))
    if op == "Constant":
        return np.shape(n.get("value"))
    if op == "MatMul":
        return _matmul(*s[:2])
    if op == "Gemm":
        a, b = (s[0][::-1] if n.get("trans_a") else s[0]), (s[1][::-1] if n.get("trans_b") else s[1])
        return broadcast(_matmul(a, b), s[2])
    if op == "Linear":
        _same(s[0][-1], s[1][1], "Linear")
        return (*s[0][:-1], s[1][0])
    if op == "Conv":
        return _spatial(n, s[0], s[1][2:], s[1][0])
    if op == "ConvTranspose":
        k = len(s[1]) - 2
        stride, pads = n.get("stride") or (1,) * k, n.get("pads") or (0,) * (2 * k)
        return (s[0][0], s[1][1], *(None if d is None else (d - 1) * stride[i] + s[1][2 + i] - pads[i] - pads[i + k] for i, d in enumerate(s[0][2:])))
    if op in ("MaxPool", "AvgPool"):
        return _spatial(n, s[0], n.get("kernel"), s[0][1], n.get("kernel"))
    if op == "GlobalAvgPool":
        return (*s[0][:2], *(1,) * (len(s[0]) - 2))
    if op == "AdaptiveAvgPool":
        return (*s[0][:2], *n.get("size"))
    if op.startswith("Reduce"):
        return _reduce(n, s[0])
    if op == "Reshape":
        return _reshape(n, s[0])
    if op == "Transpose":
        perm = n.get("perm") or range(len(s[0]))[::-1]
        return tuple(s[0][i] for i in perm)
    if op == "Flatten":
        axis, known = n.get("axis", 1), lambda d: None if None in d else math.prod(d)
        return (s[0][0] if axis == 1 else known(s[0][:axis]), known(s[0][axis:]))
    if op == "Squeeze":
        axes = {a % len(s[0]) for a in n.get("axes") or (i for i, d in enumerate(s[0]) if d == 1)}
        return tuple(d for i, d in enumerate(s[0]) if i not in axes)
    if op == "Unsqueeze":
        rank = len(s[0]) + len(n.get("axes"))
        axes, rest = {a % rank for a in n.get("axes")}, iter(s[0])
        return tuple(1 if i in axes else next(rest) for i in range(rank))
    if op == "Concat":
        axis = n.get("axis", -1) % len(s[0])
        for other in s[1:]:
            for i, (x, y) in enumerate(zip(s[0], other)):
                if i != axis:
                    _same(x, y, "Concat")
        sizes = [x[axis] for x in s]
        return tuple((None if None in sizes else sum(sizes)) if i == axis else d for i, d in enumerate(s[0]))
    if op == "Split":
        axis = n.get("axis", -1) % len(s[0])
        return tuple(n.get("sizes")[n.get("part", 0)] if i == axis else d for i, d in enumerate(s[0]))
    if op == "Slice":
        out = list(s[0])
        for axis, a, b in zip(n.get("axes"), n.get("starts"), n.get("ends")):
            out[axis] = None if out[axis] is None else len(range(*slice(a, b).indices(out[axis])))
        return tuple(out)
    if op == "Gather":
        axis = n.get("axis", 0)
        return (*s[0][:axis], *s[1], *s[0][axis + 1 :])
    if op == "Embedding":
        return (*s[1], s[0][1])
    if op == "Pad":
        p = n.get("pads")
        return tuple(None if d is None else d + p[i] + p[i + len(s[0])] for i, d in enumerate(s[0]))
    if op == "Expand":
        return broadcast(s[0], tuple(n.get("shape")))
    if op in ("LSTM", "GRU"):
        return (s[0][0], s[0][1], s[2][1])
    if op == "Attention":
        return (*s[0][:-1], s[2][-1])
    if op == "MultiHeadAttention":
        return (*s[0][:-1], s[6][0])
    if op in LOSSES:
        if n.get("reduction", "mean") != "none":
            return ()
        return s[0][:-1] if op == "CrossEntropy" else broadcast(s[0], s[1])
    if op in ("Add", "Sub", "Mul", "Div", "Pow", "Equal", "Greater", "Less"):
        return broadcast(s[0], s[1])
    if op == "Where":
        return broadcast(s[0], broadcast(s[1], s[2]))
    if op in ("SumTo", "ExpandTo"):
        return s[1]
    if op == "SizeOf":
        return ()
    if op == "Opaque":
        return tuple(n.get("shape"))
    return s[0]


def infer(graph: Graph) -> list[Shape]:
    """The shape of every node."""
    out: list[Shape] = []
    for node in graph.nodes:
        out.append(infer_node(node, [out[i] for i in node.inputs]))
    return out


def mixes_rows(graph: Graph, outputs: list[str]) -> bool:
    """Whether any wanted output of a row can depend on other rows, judged from axes alone."""
    rows: list[bool] = []  # whether axis 0 counts rows
    shapes = infer(graph)
    needed, todo = set(), [graph.outputs[o] for o in outputs]
    while todo:
        i = todo.pop()
        if i not in needed:
            needed.add(i)
            todo += graph.nodes[i].inputs
    for number, node in enumerate(graph.nodes):
        if number not in needed:
            rows.append(False)
            continue
        own = [rows[i] for i in node.inputs]
        any_rows, rank = any(own), len(shapes[node.inputs[0]]) if node.inputs else 0
        if node.op == "Input":
            rows.append(True)
            continue
        if any_rows:
            axes = node.get("axes")
            if node.op in ("MatMul", "Gemm", "Linear") and any(own[1:]) or node.op == "Gemm" and node.get("trans_a"):
                return True
            if node.op.startswith("Reduce") and (not axes or any(a % rank == 0 for a in axes)):
                return True
            if node.op in ("Softmax", "LogSoftmax", "Concat", "Split", "Gather", "Scatter") and node.get("axis", -1) % max(1, rank) == 0:
                return True
            if node.op == "Reshape" and node.get("shape")[0] not in (-1, 0) or node.op == "Flatten" and node.get("axis", 1) < 1:
                return True
            if node.op == "Transpose" and (node.get("perm") or (1,))[0] != 0:
                return True
            if node.op in ("Squeeze", "Unsqueeze") and (not axes or any(a == 0 for a in axes)):
                return True
            if node.op in LOSSES and node.get("reduction", "mean") != "none" or node.op in ("Opaque", "SumTo", "SizeOf"):
                return True
        rows.append(any_rows)
    return False
