"""Graphs on numpy arrays, in single precision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from typing import Any

import numpy as np

from lodestone.ml.graph import Graph, Node

F = np.float32


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def _log_softmax(x: np.ndarray, axis: int) -> np.ndarray:
    z = x - x.max(axis=axis, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=axis, keepdims=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def _erf(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erf, otypes=[F])(x)


def _reduced(x: np.ndarray, n: Node) -> np.ndarray:
    how = n.get("reduction", "mean")
    return x if how == "none" else np.asarray(x.mean() if how == "mean" else x.sum())


def _cross_entropy(logits: np.ndarray, target: np.ndarray, n: Node) -> np.ndarray:
    logs = _log_softmax(logits, -1)
    if target.shape == logits.shape:
        return _reduced(-(target * logs).sum(axis=-1), n)
    at = target.astype(np.int64).reshape(logs.shape[:-1])
    return _reduced(-np.take_along_axis(logs, at[..., None], -1)[..., 0], n)


def _axes(n: Node, x: np.ndarray) -> tuple[int, ...] | None:
    return tuple(a % x.ndim for a in n.get("axes") or ()) or None


def _reduce(f: Callable) -> Callable:
    return lambda n, x: np.asarray(f(x, axis=_axes(n, x), keepdims=n.get("keep", False)))


def sum_to(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over what broadcasting added."""
    if g.shape == shape:
        return g
    g = g.sum(axis=tuple(range(g.ndim - len(shape)))) if g.ndim > len(shape) else g
    axes = tuple(i for i, d in enumerate(shape) if d == 1 and g.shape[i] != 1)
    return g.sum(axis=axes, keepdims=True) if axes else g


def _normalise(x: np.ndarray, axes: tuple[int, ...], eps: float) -> np.ndarray:
    mean = x.mean(axis=axes, keepdims=True)
    return (x - mean) / np.sqrt(x.var(axis=axes, keepdims=True) + eps)


def _by_channel(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    return v.reshape((1, -1) + (1,) * (x.ndim - 2))


def _batch_norm(n: Node, x, scale, shift, mean, var) -> np.ndarray:
    c = lambda v: _by_channel(v, x)
    return (x - c(mean)) / np.sqrt(c(var) + n.get("eps", 1e-5)) * c(scale) + c(shift)


def _group_norm(n: Node, x, scale, shift) -> np.ndarray:
    groups = n.get("groups", 1)
    y = x.reshape(x.shape[0], groups, -1)
    return _normalise(y, (2,), n.get("eps", 1e-5)).reshape(x.shape) * _by_channel(scale, x) + _by_channel(shift, x)


def _windows(x: np.ndarray, kernel: tuple, stride: tuple, pads: tuple, fill: float) -> np.ndarray:
    """(N, C, out..., kernel...) views of the spatial axes."""
    k = len(kernel)
    x = np.pad(x, [(0, 0), (0, 0)] + [(pads[i], pads[i + k]) for i in range(k)], constant_values=fill)
    view = np.lib.stride_tricks.sliding_window_view(x, kernel, axis=tuple(range(2, 2 + k)))
    return view[(slice(None), slice(None), *(slice(None, None, s) for s in stride))]


def _spatial(n: Node, k: int) -> tuple[tuple, tuple]:
    return tuple(n.get("stride") or (1,) * k), tuple(n.get("pads") or (0,) * (2 * k))


def _conv(n: Node, x, w, b=None) -> np.ndarray:
    k, groups = w.ndim - 2, n.get("groups", 1)
    stride, pads = _spatial(n, k)
    view = _windows(x, w.shape[2:], stride, pads, 0.0)
    out = []
    for g in range(groups):
        xs = view[:, g * w.shape[1] : (g + 1) * w.shape[1]]
        ws = w[g * len(w) // groups : (g + 1) * len(w) // groups]
        out.append(np.moveaxis(np.tensordot(xs, ws, axes=([1, *range(2 + k, 2 + 2 * k)], [1, *range(2, 2 + k)])), -1, 1))
    y = np.concatenate(out, axis=1)
    return y if b is None else y + _by_channel(b, y)


def _conv_transpose(n: Node, x, w, b=None) -> np.ndarray:
    k = w.ndim - 2
    stride, pads = _spatial(n, k)
    spread = np.zeros(x.shape[:2] + tuple((d - 1) * s + 1 for d, s in zip(x.shape[2:], stride)), F)
    spread[(slice(None), slice(None), *(slice(None, None, s) for s in stride))] = x
    flipped = np.flip(w, axis=tuple(range(2, 2 + k))).swapaxes(0, 1)
    edge = tuple(w.shape[2 + i] - 1 - pads[i] for i in range(k)) + tuple(w.shape[2 + i] - 1 - pads[i + k] for i in range(k))
    return _conv(Node("Conv", (), (("pads", edge),)), spread, flipped, b)


def _pool(f: Callable, fill: float) -> Callable:
    def run(n: Node, x: np.ndarray) -> np.ndarray:
        kernel = tuple(n.get("kernel"))
        k = len(kernel)
        stride = tuple(n.get("stride") or kernel)
        view = _windows(x, kernel, stride, tuple(n.get("pads") or (0,) * (2 * k)), fill)
        return f(view, axis=tuple(range(2 + k, 2 + 2 * k)))

    return run


def _adaptive(n: Node, x: np.ndarray) -> np.ndarray:
    for axis, size in enumerate(n.get("size"), 2):
        d = x.shape[axis]
        parts = [x.take(range(i * d // size, -(-(i + 1) * d // size)), axis).mean(axis=axis, keepdims=True) for i in range(size)]
        x = np.concatenate(parts, axis)
    return x


def _lstm(n: Node, x, w, r, b) -> np.ndarray:
    """Gates in the order input, output, forget, cell; x: (rows, steps, features). All hidden states."""
    h = c = np.zeros((len(x), r.shape[1]), F)
    out = []
    for t in range(x.shape[1]):
        i, o, f, g = np.split(x[:, t] @ w.T + h @ r.T + b, 4, axis=1)
        c = _sigmoid(f) * c + _sigmoid(i) * np.tanh(g)
        h = _sigmoid(o) * np.tanh(c)
        out.append(h)
    return np.stack(out, 1)


def _gru(n: Node, x, w, r, b) -> np.ndarray:
    """Gates in the order update, reset, hidden."""
    h = np.zeros((len(x), r.shape[1]), F)
    wz, wr, wh = np.split(w, 3)
    rz, rr, rh = np.split(r, 3)
    bz, br, bh = np.split(b, 3)
    out = []
    for t in range(x.shape[1]):
        z = _sigmoid(x[:, t] @ wz.T + h @ rz.T + bz)
        reset = _sigmoid(x[:, t] @ wr.T + h @ rr.T + br)
        h = (1 - z) * np.tanh(x[:, t] @ wh.T + (reset * h) @ rh.T + bh) + z * h
        out.append(h)
    return np.stack(out, 1)


def _attention(n: Node, q, k, v, mask=None) -> np.ndarray:
    scores = q @ k.swapaxes(-1, -2) * F(n.get("scale") or 1 / math.sqrt(q.shape[-1]))
    return _softmax(scores if mask is None else np.where(mask > 0, scores, F(-1e9)), -1) @ v


def _multi_head(n: Node, q, k, v, wq, wk, wv, wo) -> np.ndarray:
    heads = n.get("heads")
    split = lambda x, w: (x @ w.T).reshape(len(x), x.shape[1], heads, -1).swapaxes(1, 2)
    out = _attention(Node("Attention"), split(q, wq), split(k, wk), split(v, wv))
    return out.swapaxes(1, 2).reshape(len(q), q.shape[1], -1) @ wo.T


def _scatter(n: Node, x, at, updates) -> np.ndarray:
    out = x.copy()
    np.put_along_axis(out, at.astype(np.int64), updates, n.get("axis", 0))
    return out


def _slice(n: Node, x: np.ndarray) -> np.ndarray:
    cut = [slice(None)] * x.ndim
    for axis, a, b in zip(n.get("axes"), n.get("starts"), n.get("ends")):
        cut[axis] = slice(a, b)
    return x[tuple(cut)]


def _reshape(n: Node, x: np.ndarray) -> np.ndarray:
    return x.reshape([x.shape[i] if d == 0 else d for i, d in enumerate(n.get("shape"))])


def _pads(n: Node, x: np.ndarray) -> np.ndarray:
    p = n.get("pads")
    return np.pad(x, [(p[i], p[i + x.ndim]) for i in range(x.ndim)], constant_values=n.get("value", 0.0))


def _flatten(n: Node, x: np.ndarray) -> np.ndarray:
    axis = n.get("axis", 1)
    return x.reshape(math.prod(x.shape[:axis]), -1)


RUN: dict[str, Callable[..., np.ndarray]] = {
    "MatMul": lambda n, a, b: a @ b,
    "Gemm": lambda n, a, b, c: F(n.get("alpha", 1.0)) * ((a.T if n.get("trans_a") else a) @ (b.T if n.get("trans_b") else b)) + F(n.get("beta", 1.0)) * c,
    "Linear": lambda n, x, w, b: x @ w.T + b,
    "Conv": _conv,
    "ConvTranspose": _conv_transpose,
    "Relu": lambda n, x: np.maximum(x, 0),
    "LeakyRelu": lambda n, x: np.where(x > 0, x, F(n.get("alpha", 0.01)) * x),
    "Sigmoid": lambda n, x: _sigmoid(x),
    "Tanh": lambda n, x: np.tanh(x),
    "Softmax": lambda n, x: _softmax(x, n.get("axis", -1)),
    "LogSoftmax": lambda n, x: _log_softmax(x, n.get("axis", -1)),
    "Gelu": lambda n, x: x * F(0.5) * (1 + _erf(x / F(math.sqrt(2)))),
    "Silu": lambda n, x: x * _sigmoid(x),
    "Elu": lambda n, x: np.where(x > 0, x, F(n.get("alpha", 1.0)) * np.expm1(np.minimum(x, 0))),
    "HardSwish": lambda n, x: x * np.clip(x / 6 + F(0.5), 0, 1),
    "Add": lambda n, a, b: a + b,
    "Sub": lambda n, a, b: a - b,
    "Mul": lambda n, a, b: a * b,
    "Div": lambda n, a, b: a / b,
    "Pow": lambda n, a, b: a**b,
    "Sqrt": lambda n, x: np.sqrt(x),
    "Neg": lambda n, x: -x,
    "Abs": lambda n, x: np.abs(x),
    "Exp": lambda n, x: np.exp(x),
    "Log": lambda n, x: np.log(x),
    "Clip": lambda n, x: np.clip(x, n.get("low"), n.get("high")),
    "MaxPool": _pool(np.max, -np.inf),
    "AvgPool": _pool(np.mean, 0.0),
    "GlobalAvgPool": lambda n, x: x.mean(axis=tuple(range(2, x.ndim)), keepdims=True),
    "AdaptiveAvgPool": _adaptive,
    "BatchNorm": _batch_norm,
    "LayerNorm": lambda n, x, s, b: _normalise(x, tuple(range(x.ndim - s.ndim, x.ndim)), n.get("eps", 1e-5)) * s + b,
    "GroupNorm": _group_norm,
    "InstanceNorm": lambda n, x, s, b: _normalise(x, tuple(range(2, x.ndim)), n.get("eps", 1e-5)) * _by_channel(s, x) + _by_channel(b, x),
    "ReduceSum": _reduce(np.sum),
    "ReduceMean": _reduce(np.mean),
    "ReduceMax": _reduce(np.max),
    "ReduceMin": _reduce(np.min),
    "ReduceProd": _reduce(np.prod),
    "Reshape": _reshape,
    "Transpose": lambda n, x: x.transpose(n.get("perm") or None),
    "Flatten": _flatten,
    "Squeeze": lambda n, x: x.squeeze(tuple(n.get("axes") or ()) or None),
    "Unsqueeze": lambda n, x: np.expand_dims(x, tuple(n.get("axes"))),
    "Concat": lambda n, *xs: np.concatenate(xs, n.get("axis", -1)),
    "Split": lambda n, x: np.split(x, np.cumsum(n.get("sizes"))[:-1], n.get("axis", -1))[n.get("part", 0)],
    "Slice": _slice,
    "Gather": lambda n, x, at: np.take(x, at.astype(np.int64), n.get("axis", 0)),
    "Scatter": _scatter,
    "Pad": _pads,
    "Expand": lambda n, x: np.broadcast_to(x, np.broadcast_shapes(x.shape, tuple(n.get("shape")))),
    "LSTM": _lstm,
    "GRU": _gru,
    "Attention": _attention,
    "MultiHeadAttention": _multi_head,
    "Embedding": lambda n, table, at: table[at.astype(np.int64)],
    "Dropout": lambda n, x: x,
    "CrossEntropy": lambda n, x, t: _cross_entropy(x, t, n),
    "MSE": lambda n, x, t: _reduced((x - t) ** 2, n),
    "L1": lambda n, x, t: _reduced(np.abs(x - t), n),
    "BCE": lambda n, x, t: _reduced(-(t * np.log(np.clip(x, F(1e-7), F(1 - 1e-7))) + (1 - t) * np.log1p(-np.clip(x, F(1e-7), F(1 - 1e-7)))), n),
    "BCEWithLogits": lambda n, x, t: _reduced(np.maximum(x, 0) - x * t + np.log1p(np.exp(-np.abs(x))), n),
    "Equal": lambda n, a, b: (a == b).astype(F),
    "Greater": lambda n, a, b: (a > b).astype(F),
    "Less": lambda n, a, b: (a < b).astype(F),
    "Where": lambda n, c, a, b: np.where(c != 0, a, b),
    "Cast": lambda n, x: x.astype({"float32": F, "float64": np.float64, "int32": np.int32, "int64": np.int64, "bool": bool}[n.get("to")]).astype(F),
    "SumTo": lambda n, g, x: sum_to(g, x.shape),
    "ExpandTo": lambda n, g, x: np.broadcast_to(g, x.shape),
    "SizeOf": lambda n, x: np.asarray(x.size if n.get("axes") is None else math.prod(x.shape[a] for a in n.get("axes")), F),
}


def initial(name: str, shape: tuple[int, ...], init: str) -> np.ndarray:
    """A parameter's first value; the seed is a stable hash of its name."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big"))
    fan_out, fan_in = (shape[0], math.prod(shape[1:])) if len(shape) > 1 else (shape[0] if shape else 1,) * 2
    if init in ("zeros", "ones"):
        return np.full(shape, float(init == "ones"), F)
    if init == "uniform":
        return rng.uniform(-1, 1, shape).astype(F)
    scale = {"normal": 1.0, "xavier": math.sqrt(2 / (fan_in + fan_out)), "kaiming": math.sqrt(2 / fan_in), "default": 0.01}[init]
    return (rng.normal(size=shape) * scale).astype(F)


def parameters(graph: Graph) -> dict[str, np.ndarray]:
    """All parameters: trained values where the graph has them, else initial ones."""
    out = {}
    for name, i in graph.named("Parameter").items():
        node = graph.nodes[i]
        value = graph.values.get(name)
        out[name] = np.asarray(value, F) if value is not None else initial(name, tuple(node.get("shape")), node.get("init", "default"))
    return out


def evaluate(graph: Graph, inputs: dict[str, Any], params: dict[str, np.ndarray] | None = None, want: list[str] | None = None) -> dict[str, np.ndarray]:
    """The wanted outputs (default: all); only nodes that they need are computed."""
    params = parameters(graph) if params is None else params
    names = want or list(graph.outputs)
    needed, todo = set(), [graph.outputs[n] for n in names]
    while todo:
        i = todo.pop()
        if i not in needed:
            needed.add(i)
            todo += graph.nodes[i].inputs
    values: dict[int, np.ndarray] = {}
    for i in sorted(needed):
        node = graph.nodes[i]
        if node.op == "Input":
            values[i] = np.asarray(inputs[node.get("name")], F)
        elif node.op == "Parameter":
            values[i] = params[node.get("name")]
        elif node.op == "Constant":
            values[i] = np.asarray(node.get("value"), F)
        elif node.op in RUN:
            values[i] = np.asarray(RUN[node.op](node, *(values[j] for j in node.inputs)), F)
        else:
            raise NotImplementedError(f"{node.op} has no evaluation")
    return {n: values[graph.outputs[n]] for n in names}
