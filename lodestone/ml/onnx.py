"""ONNX files to and from tensor graphs, by the published wire format; no library is needed.

Only the parts of the format that the mapped operators use are read: one graph of float
tensors, with attributes of ints, floats and strings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np

from lodestone.ml.evaluate import parameters
from lodestone.ml.graph import Graph
from lodestone.ml.shape import infer

OPSET = 17
#: Our operation -> (ONNX operation, attribute names: ours -> theirs). Fixed values of the format.
SAME = {
    "MatMul": {}, "Gemm": {"alpha": "alpha", "beta": "beta", "trans_a": "transA", "trans_b": "transB"}, "Relu": {}, "LeakyRelu": {"alpha": "alpha"},
    "Sigmoid": {}, "Tanh": {}, "Softmax": {"axis": "axis"}, "LogSoftmax": {"axis": "axis"}, "Elu": {"alpha": "alpha"}, "Add": {}, "Sub": {}, "Mul": {}, "Div": {},
    "Pow": {}, "Sqrt": {}, "Neg": {}, "Abs": {}, "Exp": {}, "Log": {}, "Transpose": {"perm": "perm"}, "Flatten": {"axis": "axis"}, "Concat": {"axis": "axis"},
    "Conv": {"stride": "strides", "pads": "pads", "groups": "group"}, "ConvTranspose": {"stride": "strides", "pads": "pads"},
    "MaxPool": {"kernel": "kernel_shape", "stride": "strides", "pads": "pads"}, "ReduceMean": {"axes": "axes", "keep": "keepdims"},
    "ReduceMax": {"axes": "axes", "keep": "keepdims"}, "ReduceMin": {"axes": "axes", "keep": "keepdims"}, "ReduceProd": {"axes": "axes", "keep": "keepdims"},
}
RENAMED = {
    "AvgPool": ("AveragePool", {"kernel": "kernel_shape", "stride": "strides", "pads": "pads"}), "GlobalAvgPool": ("GlobalAveragePool", {}),
    "BatchNorm": ("BatchNormalization", {"eps": "epsilon"}), "InstanceNorm": ("InstanceNormalization", {"eps": "epsilon"}),
    "LayerNorm": ("LayerNormalization", {"eps": "epsilon"}),
}
#: Operations whose attribute is an input tensor in the format.
WITH_INTS = {"Reshape": "shape", "Squeeze": "axes", "Unsqueeze": "axes", "Expand": "shape", "ReduceSum": "axes"}
NAMES = {**{k: (k, v) for k, v in SAME.items()}, **RENAMED}
BACK = {theirs: (ours, {b: a for a, b in attrs.items()}) for ours, (theirs, attrs) in NAMES.items()}
#: Tensor types of the format.
CASTS = {"float32": 1, "int32": 6, "int64": 7, "bool": 9, "float64": 11}
FLAGS = ("trans_a", "trans_b", "keep")


# The wire format -----------------------------------------------------------------------------


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _int(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def _fields(data: bytes) -> Iterator[tuple[int, Any]]:
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: Any = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _ints(value: Any) -> list[int]:
    """A repeated integer field, packed or not."""
    if isinstance(value, int):
        return [_signed(value)]
    out, n, shift = [], 0, 0
    for byte in value:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(_signed(n))
            n = shift = 0
    return out


# Writing -------------------------------------------------------------------------------------


def _tensor(name: str, value: np.ndarray) -> bytes:
    ints = value.dtype == np.int64
    dims = b"".join(_int(1, d) for d in value.shape)
    return dims + _int(2, 7 if ints else 1) + _bytes(8, name) + _bytes(9, np.ascontiguousarray(value, "<i8" if ints else "<f4").tobytes())


def _attribute(name: str, value: Any) -> bytes:
    if isinstance(value, (tuple, list)):
        return _bytes(1, name) + b"".join(_int(8, int(v)) for v in value) + _int(20, 7)
    if isinstance(value, float):
        return _bytes(1, name) + _float(2, value) + _int(20, 1)
    return _bytes(1, name) + _int(3, int(value)) + _int(20, 2)


def _value_info(name: str, shape: tuple) -> bytes:
    dims = b"".join(_bytes(1, _int(1, d) if d is not None else _bytes(2, "rows")) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _int(1, 1) + _bytes(2, dims)))


def export(graph: Graph) -> bytes:
    """An ONNX model of the graph's outputs; parameters are initializers."""
    shapes, values = infer(graph), parameters(graph)
    needed, todo = set(), list(graph.outputs.values())
    while todo:
        i = todo.pop()
        if i not in needed:
            needed.add(i)
            todo += graph.nodes[i].inputs
    names: dict[int, str] = {}
    nodes, initializers, inputs = [], [], []

    def emit(op: str, ins: list[str], out: str, attrs: dict[str, Any]) -> None:
        body = b"".join(_bytes(1, x) for x in ins) + _bytes(2, out) + _bytes(3, f"n{len(nodes)}") + _bytes(4, op)
        nodes.append(body + b"".join(_bytes(5, _attribute(k, v)) for k, v in attrs.items()))

    def constant(name: str, value: np.ndarray) -> str:
        initializers.append(_tensor(name, value))
        return name

    for i in sorted(needed):
        n = graph.nodes[i]
        ins = [names[j] for j in n.inputs]
        out = names[i] = n.get("name") if n.op in ("Input", "Parameter") else f"t{i}"
        attrs = {k: v for k, v in n.attrs if v is not None}
        if n.op == "Input":
            inputs.append(_value_info(out, shapes[i]))
        elif n.op == "Parameter":
            constant(out, values[out])
        elif n.op == "Constant":
            constant(out, np.asarray(n.get("value"), np.float32))
        elif n.op == "Linear":
            emit("Gemm", ins, out, {"transB": 1})
        elif n.op == "Dropout":
            emit("Identity", ins, out, {})
        elif n.op == "Cast":
            # Values are floats between our operations, so the cast goes there and back.
            emit("Cast", ins, f"{out}_c", {"to": CASTS[n.get("to")]})
            emit("Cast", [f"{out}_c"], out, {"to": CASTS["float32"]})
        elif n.op == "Silu":
            emit("Sigmoid", ins, f"{out}_s", {})
            emit("Mul", [ins[0], f"{out}_s"], out, {})
        elif n.op == "Clip":
            emit("Clip", [ins[0], constant(f"{out}_l", np.float32(n.get("low")).reshape(())), constant(f"{out}_h", np.float32(n.get("high")).reshape(()))], out, {})
        elif n.op in WITH_INTS:
            given = attrs.get(WITH_INTS[n.op]) or ()
            extra = [constant(f"{out}_i", np.array(given, np.int64))] if given else []
            emit(n.op, ins + extra, out, {"keepdims": int(n.get("keep", False))} if n.op == "ReduceSum" else {})
        elif n.op in NAMES:
            theirs, renames = NAMES[n.op]
            made = {renames[k]: (int(v) if k in FLAGS else v) for k, v in attrs.items() if k in renames and v != ()}
            if n.op.startswith("Reduce"):
                made.setdefault("keepdims", 0)
            if n.op in ("MaxPool", "AvgPool"):
                made.setdefault("strides", attrs["kernel"])
            emit(theirs, ins, out, made)
        else:
            raise NotImplementedError(f"{n.op} has no ONNX form here")
    for name, i in graph.outputs.items():
        emit("Identity", [names[i]], name, {})
    body = b"".join(_bytes(1, n) for n in nodes) + _bytes(2, "graph") + b"".join(_bytes(5, t) for t in initializers)
    body += b"".join(_bytes(11, v) for v in inputs) + b"".join(_bytes(12, _value_info(o, shapes[i])) for o, i in graph.outputs.items())
    return _int(1, 8) + _bytes(2, "lodestone") + _bytes(7, body) + _bytes(8, _bytes(1, "") + _int(2, OPSET))


# Reading -------------------------------------------------------------------------------------


def _read_tensor(data: bytes) -> tuple[str, np.ndarray]:
    dims: list[int] = []
    kind, name, raw, floats, longs = 1, "", b"", [], []
    for field, value in _fields(data):
        if field == 1:
            dims += _ints(value)
        elif field == 2:
            kind = value
        elif field == 8:
            name = value.decode()
        elif field == 9:
            raw = value
        elif field == 4:
            floats += np.frombuffer(value, "<f4").tolist()
        elif field == 7:
            longs += _ints(value)
    dtype = {1: "<f4", 7: "<i8", 6: "<i4", 11: "<f8"}.get(kind)
    if dtype is None:
        raise NotImplementedError(f"tensor type {kind}")
    flat = np.frombuffer(raw, dtype) if raw else np.array(longs if kind == 7 else floats, dtype)
    return name, flat.reshape(dims)


def _read_attribute(data: bytes) -> tuple[str, Any]:
    name, out, many = "", None, []
    for field, value in _fields(data):
        if field == 1:
            name = value.decode()
        elif field == 2:
            out = struct.unpack("<f", value)[0]
        elif field == 3:
            out = _signed(value)
        elif field == 4:
            out = value.decode()
        elif field == 5:
            out = _read_tensor(value)[1]
        elif field == 8:
            many += _ints(value)
    return name, tuple(many) if many else out


def _read_value(data: bytes) -> tuple[str, tuple]:
    name, dims = "", []
    for field, value in _fields(data):
        if field == 1:
            name = value.decode()
        elif field == 2:
            for _, tensor in _fields(value):
                for f, shape in _fields(tensor):
                    if f == 2:
                        for _, dim in _fields(shape):
                            dims.append(next((v for k, v in _fields(dim) if k == 1), None))
    return name, tuple(dims)


def load(data: bytes) -> Graph:
    """A tensor graph of an ONNX model; float initializers become parameters with values."""
    body = next(v for f, v in _fields(data) if f == 7)
    nodes, tensors, inputs, outputs = [], {}, [], []
    for field, value in _fields(body):
        if field == 1:
            nodes.append(value)
        elif field == 5:
            name, tensor = _read_tensor(value)
            tensors[name] = tensor
        elif field == 11:
            inputs.append(_read_value(value))
        elif field == 12:
            outputs.append(_read_value(value)[0])
    graph = Graph()
    made: dict[str, int] = {}
    for name, shape in inputs:
        if name not in tensors:
            made[name] = graph.add("Input", name=name, shape=(None, *shape[1:]) if shape else ())
    for name, tensor in tensors.items():
        if tensor.dtype != np.int64:
            made[name] = graph.add("Parameter", name=name, shape=tensor.shape, init="zeros")
            graph.values[name] = tensor.astype(np.float32).tolist()
    for raw in nodes:
        ins: list[str] = []
        outs: list[str] = []
        op, attrs = "", {}
        for field, value in _fields(raw):
            if field == 1:
                ins.append(value.decode())
            elif field == 2:
                outs.append(value.decode())
            elif field == 4:
                op = value.decode()
            elif field == 5:
                k, v = _read_attribute(value)
                attrs[k] = v
        args = [made[x] for x in ins if x in made]
        if op in ("Identity", "Dropout"):
            made[outs[0]] = args[0]
        elif op == "Cast":
            to = next((name for name, kind in CASTS.items() if kind == attrs["to"]), None)
            if to is None:
                raise NotImplementedError(f"cast to tensor type {attrs['to']}")
            made[outs[0]] = graph.add("Cast", args[0], to=to)
        elif op == "Constant":
            tensor = np.asarray(attrs["value"])
            if tensor.dtype == np.int64:
                tensors[outs[0]] = tensor
            else:
                made[outs[0]] = graph.add("Constant", value=tensor.tolist())
        elif op == "Clip":
            low, high = (float(graph.values[x]) if x in graph.values else float(graph.nodes[made[x]].get("value")) for x in ins[1:3])
            made[outs[0]] = graph.add("Clip", args[0], low=low, high=high)
        elif op in WITH_INTS:
            key = WITH_INTS[op]
            given = tuple(tensors[ins[1]].tolist()) if len(ins) > 1 else tuple(attrs.get(key) or ())
            extra = {"keep": bool(attrs.get("keepdims", 1))} if op == "ReduceSum" else {}
            made[outs[0]] = graph.add(op, args[0], **{key: given}, **extra)
        elif op in BACK:
            ours, renames = BACK[op]
            kept = {renames[k]: (bool(v) if renames[k] in FLAGS else v) for k, v in attrs.items() if k in renames}
            if ours.startswith("Reduce"):
                kept.setdefault("keep", True)
            if ours == "Gemm" and len(args) == 2:
                args.append(graph.add("Constant", value=0.0))
            made[outs[0]] = graph.add(ours, *args, **kept)
        else:
            raise NotImplementedError(f"ONNX operation {op}")
    graph.outputs = {name: made[name] for name in outputs}
    return graph
