"""Tensor graphs: nodes with inputs and attributes, parameters with initializers, named outputs.

A graph is plain data that JSON holds, so that it can be part of a stored plan. ``Tensor`` builds
one with operators and methods.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: Operation -> number of inputs (None: any). Float tensors, row-major; attributes beside.
OPS: dict[str, int | None] = {
    # leaves
    "Input": 0, "Constant": 0, "Parameter": 0,
    # linear algebra and convolution
    "MatMul": 2, "Gemm": 3, "Linear": 3, "Conv": None, "ConvTranspose": None,
    # activations
    "Relu": 1, "LeakyRelu": 1, "Sigmoid": 1, "Tanh": 1, "Softmax": 1, "LogSoftmax": 1, "Gelu": 1, "Silu": 1, "Elu": 1, "HardSwish": 1,
    # elementwise
    "Add": 2, "Sub": 2, "Mul": 2, "Div": 2, "Pow": 2, "Sqrt": 1, "Neg": 1, "Abs": 1, "Exp": 1, "Log": 1, "Clip": 1,
    # pooling and normalisation
    "MaxPool": 1, "AvgPool": 1, "GlobalAvgPool": 1, "AdaptiveAvgPool": 1, "BatchNorm": 5, "LayerNorm": 3, "GroupNorm": 3, "InstanceNorm": 3,
    # reductions
    "ReduceSum": 1, "ReduceMean": 1, "ReduceMax": 1, "ReduceMin": 1, "ReduceProd": 1,
    # shapes
    "Reshape": 1, "Transpose": 1, "Flatten": 1, "Squeeze": 1, "Unsqueeze": 1, "Concat": None, "Split": 1, "Slice": 1, "Gather": 2, "Scatter": 3,
    "Pad": 1, "Expand": 1,
    # recurrent, attention, embedding, regularisation
    "LSTM": None, "GRU": None, "Attention": None, "MultiHeadAttention": None, "Embedding": 2, "Dropout": 1,
    # losses
    "CrossEntropy": 2, "MSE": 2, "L1": 2, "BCE": 2, "BCEWithLogits": 2,
    # comparison, choice, cast, custom
    "Equal": 2, "Greater": 2, "Less": 2, "Where": 3, "Cast": 1, "Opaque": None,
    # what gradients need: sums to, and broadcasts to, the shape of the second input; that shape's size
    "SumTo": 2, "ExpandTo": 2, "SizeOf": 1,
}
LOSSES = ("CrossEntropy", "MSE", "L1", "BCE", "BCEWithLogits")
INITIALIZERS = ("zeros", "ones", "normal", "xavier", "kaiming", "uniform", "default")


@dataclass(frozen=True)
class Node:
    op: str
    inputs: tuple[int, ...] = ()
    attrs: tuple[tuple[str, Any], ...] = ()

    def get(self, name: str, default: Any = None) -> Any:
        return dict(self.attrs).get(name, default)


def _frozen(value: Any) -> Any:
    return tuple(map(_frozen, value)) if isinstance(value, (list, tuple)) else value


@dataclass
class Graph:
    """Nodes come after their inputs. Outputs are names of nodes."""

    nodes: list[Node] = field(default_factory=list)
    outputs: dict[str, int] = field(default_factory=dict)
    values: dict[str, list] = field(default_factory=dict)  # trained parameters, as nested lists

    def add(self, op: str, *inputs: int, **attrs: Any) -> int:
        if op not in OPS:
            raise ValueError(f"unknown tensor operation {op}")
        if OPS[op] is not None and len(inputs) != OPS[op]:
            raise ValueError(f"{op} takes {OPS[op]} inputs, not {len(inputs)}")
        self.nodes.append(Node(op, tuple(inputs), tuple(sorted((k, _frozen(v)) for k, v in attrs.items()))))
        return len(self.nodes) - 1

    def named(self, op: str) -> dict[str, int]:
        """The inputs or parameters by name."""
        return {n.get("name"): i for i, n in enumerate(self.nodes) if n.op == op}

    def to_json(self) -> dict:
        return {"nodes": [[n.op, list(n.inputs), [list(a) for a in n.attrs]] for n in self.nodes], "outputs": self.outputs, "values": self.values}

    @staticmethod
    def from_json(body: dict) -> Graph:
        nodes = [Node(op, tuple(inputs), tuple((k, _frozen(v)) for k, v in attrs)) for op, inputs, attrs in body["nodes"]]
        return Graph(nodes, dict(body["outputs"]), dict(body["values"]))

    def copy(self) -> Graph:
        return Graph(list(self.nodes), dict(self.outputs), dict(self.values))

    # Building -------------------------------------------------------------------------------

    def input(self, name: str, *shape: int | None) -> Tensor:
        """A model input; the first dimension is the rows', left out of ``shape``."""
        return Tensor(self, self.add("Input", name=name, shape=(None, *shape)))

    def parameter(self, name: str, *shape: int, init: str = "default") -> Tensor:
        return Tensor(self, self.add("Parameter", name=name, shape=shape, init=init))

    def constant(self, value: Any) -> Tensor:
        return Tensor(self, self.add("Constant", value=_frozen(value)))

    def output(self, name: str, tensor: Tensor) -> Graph:
        self.outputs[name] = tensor.id
        return self


@dataclass(frozen=True)
class Tensor:
    graph: Graph
    id: int

    def _make(self, op: str, *others: Any, **attrs: Any) -> Tensor:
        ids = [o.id if isinstance(o, Tensor) else self.graph.constant(o).id for o in others]
        return Tensor(self.graph, self.graph.add(op, self.id, *ids, **attrs))

    def __add__(self, other: Any) -> Tensor:
        return self._make("Add", other)

    def __sub__(self, other: Any) -> Tensor:
        return self._make("Sub", other)

    def __mul__(self, other: Any) -> Tensor:
        return self._make("Mul", other)

    def __truediv__(self, other: Any) -> Tensor:
        return self._make("Div", other)

    def __pow__(self, other: Any) -> Tensor:
        return self._make("Pow", other)

    def __neg__(self) -> Tensor:
        return self._make("Neg")

    def __matmul__(self, other: Tensor) -> Tensor:
        return self._make("MatMul", other)

    def linear(self, weight: Tensor, bias: Tensor) -> Tensor:
        """x W' + b, with one row of W for each output."""
        return self._make("Linear", weight, bias)

    def relu(self) -> Tensor:
        return self._make("Relu")

    def sigmoid(self) -> Tensor:
        return self._make("Sigmoid")

    def tanh(self) -> Tensor:
        return self._make("Tanh")

    def softmax(self, axis: int = -1) -> Tensor:
        return self._make("Softmax", axis=axis)

    def log_softmax(self, axis: int = -1) -> Tensor:
        return self._make("LogSoftmax", axis=axis)

    def reshape(self, *shape: int) -> Tensor:
        return self._make("Reshape", shape=shape)

    def transpose(self, *perm: int) -> Tensor:
        return self._make("Transpose", perm=perm)

    def sum(self, *axes: int, keep: bool = False) -> Tensor:
        return self._make("ReduceSum", axes=axes, keep=keep)

    def mean(self, *axes: int, keep: bool = False) -> Tensor:
        return self._make("ReduceMean", axes=axes, keep=keep)

    def loss(self, kind: str, target: Tensor, reduction: str = "mean") -> Tensor:
        return self._make(kind, target, reduction=reduction)

    def apply(self, op: str, *others: Any, **attrs: Any) -> Tensor:
        return self._make(op, *others, **attrs)
