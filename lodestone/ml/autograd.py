"""Symbolic reverse-mode differentiation: a graph with its gradients as further nodes."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.ml.graph import Graph, Node


class Builder:
    """Adds nodes to the graph that is being extended."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def __call__(self, op: str, *inputs: int, **attrs) -> int:
        return self.graph.add(op, *inputs, **attrs)

    def const(self, value: float) -> int:
        return self.graph.add("Constant", value=value)

    def like(self, gradient: int, node: int) -> int:
        """A gradient with what broadcasting added summed away."""
        return self("SumTo", gradient, node)


def _axes_kept(b: Builder, n: Node, g: int, x: int) -> int:
    """A reduction's gradient, broadcast to what was reduced."""
    axes = n.get("axes")
    if axes and not n.get("keep", False):
        g = b("Unsqueeze", g, axes=axes)
    return b("ExpandTo", g, x)


def _mean_size(b: Builder, n: Node, x: int) -> int:
    axes = n.get("axes")
    return b("SizeOf", x, axes=axes) if axes else b("SizeOf", x)


def _matmul(b: Builder, n: Node, i: int, g: int, x: int, y: int) -> list[int]:
    swap = lambda v: b("Transpose", v, perm=())  # noqa: E731  two dimensions
    return [b("MatMul", g, swap(y)), b("MatMul", swap(x), g)]


def _gemm(b: Builder, n: Node, i: int, g: int, x: int, y: int, c: int) -> list[int]:
    swap = lambda v: b("Transpose", v, perm=())
    scaled = b("Mul", g, b.const(n.get("alpha", 1.0)))
    p, q = (swap(x) if n.get("trans_a") else x), (swap(y) if n.get("trans_b") else y)
    gx, gy = b("MatMul", scaled, swap(q)), b("MatMul", swap(p), scaled)
    return [swap(gx) if n.get("trans_a") else gx, swap(gy) if n.get("trans_b") else gy, b.like(b("Mul", g, b.const(n.get("beta", 1.0))), c)]


def _loss_scale(b: Builder, n: Node, g: int, each: int) -> int:
    """The gradient at each element before reduction."""
    g = b("ExpandTo", g, each)
    return b("Div", g, b("SizeOf", each)) if n.get("reduction", "mean") == "mean" else g


def _softmax(b: Builder, n: Node, i: int, g: int, x: int) -> list[int]:
    inner = b("ReduceSum", b("Mul", g, i), axes=(n.get("axis", -1),), keep=True)
    return [b("Mul", i, b("Sub", g, inner))]


def _log_softmax(b: Builder, n: Node, i: int, g: int, x: int) -> list[int]:
    total = b("ReduceSum", g, axes=(n.get("axis", -1),), keep=True)
    return [b("Sub", g, b("Mul", b("Exp", i), total))]


def _cross_entropy(b: Builder, n: Node, i: int, g: int, x: int, t: int) -> list[int]:
    """For targets that are distributions over the last axis."""
    p = b("Softmax", x, axis=-1)
    each = b("ReduceSum", t, axes=(-1,), keep=False)
    scale = b("Unsqueeze", _loss_scale(b, n, g, each), axes=(-1,))
    mass = b("Unsqueeze", each, axes=(-1,))
    return [b("Mul", scale, b("Sub", b("Mul", p, mass), t)), b("Neg", b("Mul", scale, b("LogSoftmax", x, axis=-1)))]


def _sign(b: Builder, x: int) -> int:
    zero = b.const(0.0)
    return b("Sub", b("Greater", x, zero), b("Less", x, zero))


def _difference(f: Callable[[Builder, int], int]) -> Callable:
    def vjp(b: Builder, n: Node, i: int, g: int, x: int, t: int) -> list[int]:
        d = b("Sub", x, t)
        own = b("Mul", _loss_scale(b, n, g, d), f(b, d))
        return [b.like(own, x), b.like(b("Neg", own), t)]

    return vjp


def _bce(b: Builder, n: Node, i: int, g: int, x: int, t: int) -> list[int]:
    one = b.const(1.0)
    d = b("Div", b("Sub", x, t), b("Mul", x, b("Sub", one, x)))
    return [b("Mul", _loss_scale(b, n, g, d), d), b("Mul", _loss_scale(b, n, g, d), b("Log", b("Div", b("Sub", one, x), x)))]


def _bce_logits(b: Builder, n: Node, i: int, g: int, x: int, t: int) -> list[int]:
    d = b("Sub", b("Sigmoid", x), t)
    return [b("Mul", _loss_scale(b, n, g, d), d), b("Mul", _loss_scale(b, n, g, d), b("Neg", x))]


def _gate(b: Builder, x: int, g: int, low: float, high_slope: int, low_slope: int) -> list[int]:
    return [b("Mul", g, b("Where", b("Greater", x, b.const(low)), high_slope, low_slope))]


def _silu(b: Builder, n: Node, i: int, g: int, x: int) -> list[int]:
    s, one = b("Sigmoid", x), b.const(1.0)
    return [b("Mul", g, b("Mul", s, b("Add", one, b("Mul", x, b("Sub", one, s)))))]


def _clip(b: Builder, n: Node, i: int, g: int, x: int) -> list[int]:
    inside = b("Mul", b("Greater", x, b.const(n.get("low"))), b("Less", x, b.const(n.get("high"))))
    return [b("Mul", g, inside)]


def _pow(b: Builder, n: Node, i: int, g: int, x: int, y: int) -> list[int]:
    down = b("Pow", x, b("Sub", y, b.const(1.0)))
    return [b.like(b("Mul", g, b("Mul", y, down)), x), b.like(b("Mul", g, b("Mul", i, b("Log", x))), y)]


def _transpose(b: Builder, n: Node, i: int, g: int, x: int) -> list[int]:
    perm = n.get("perm") or ()
    back = tuple(sorted(range(len(perm)), key=lambda k: perm[k]))
    return [b("Transpose", g, perm=back)]


def _concat(b: Builder, n: Node, i: int, g: int, *xs: int) -> list[int]:
    raise NotImplementedError("Concat needs sizes; use Split of a wider parameter")


def _linear(b: Builder, n: Node, i: int, g: int, x: int, w: int, c: int) -> list[int]:
    return [b("MatMul", g, w), b("MatMul", b("Transpose", g, perm=()), x), b.like(g, c)]


#: Operation -> function (builder, node, its number, its gradient, its inputs) -> gradients of its inputs.
VJP: dict[str, Callable[..., list]] = {
    "Add": lambda b, n, i, g, x, y: [b.like(g, x), b.like(g, y)],
    "Sub": lambda b, n, i, g, x, y: [b.like(g, x), b.like(b("Neg", g), y)],
    "Mul": lambda b, n, i, g, x, y: [b.like(b("Mul", g, y), x), b.like(b("Mul", g, x), y)],
    "Div": lambda b, n, i, g, x, y: [b.like(b("Div", g, y), x), b.like(b("Neg", b("Div", b("Mul", g, i), y)), y)],
    "Pow": _pow,
    "Sqrt": lambda b, n, i, g, x: [b("Div", g, b("Mul", b.const(2.0), i))],
    "Neg": lambda b, n, i, g, x: [b("Neg", g)],
    "Abs": lambda b, n, i, g, x: [b("Mul", g, _sign(b, x))],
    "Exp": lambda b, n, i, g, x: [b("Mul", g, i)],
    "Log": lambda b, n, i, g, x: [b("Div", g, x)],
    "Clip": _clip,
    "MatMul": _matmul,
    "Gemm": _gemm,
    "Linear": _linear,
    "Relu": lambda b, n, i, g, x: _gate(b, x, g, 0.0, b.const(1.0), b.const(0.0)),
    "LeakyRelu": lambda b, n, i, g, x: _gate(b, x, g, 0.0, b.const(1.0), b.const(n.get("alpha", 0.01))),
    "Elu": lambda b, n, i, g, x: _gate(b, x, g, 0.0, b.const(1.0), b("Add", i, b.const(n.get("alpha", 1.0)))),
    "Sigmoid": lambda b, n, i, g, x: [b("Mul", g, b("Mul", i, b("Sub", b.const(1.0), i)))],
    "Tanh": lambda b, n, i, g, x: [b("Mul", g, b("Sub", b.const(1.0), b("Mul", i, i)))],
    "Silu": _silu,
    "Softmax": _softmax,
    "LogSoftmax": _log_softmax,
    "ReduceSum": lambda b, n, i, g, x: [_axes_kept(b, n, g, x)],
    "ReduceMean": lambda b, n, i, g, x: [b("Div", _axes_kept(b, n, g, x), _mean_size(b, n, x))],
    "Reshape": lambda b, n, i, g, x: [b("ExpandTo", b("Reshape", g, shape=n.get("from")), x)],
    "Flatten": lambda b, n, i, g, x: [b("Reshape", g, shape=n.get("from"))],
    "Transpose": _transpose,
    "Squeeze": lambda b, n, i, g, x: [b("Unsqueeze", g, axes=n.get("axes"))],
    "Unsqueeze": lambda b, n, i, g, x: [b("Squeeze", g, axes=n.get("axes"))],
    "Expand": lambda b, n, i, g, x: [b.like(g, x)],
    "Dropout": lambda b, n, i, g, x: [g],
    "Where": lambda b, n, i, g, c, x, y: [None, b.like(b("Where", c, g, b.const(0.0)), x), b.like(b("Where", c, b.const(0.0), g), y)],
    "Cast": lambda b, n, i, g, x: [g],
    "CrossEntropy": _cross_entropy,
    "MSE": _difference(lambda b, d: b("Mul", b.const(2.0), d)),
    "L1": _difference(_sign),
    "BCE": _bce,
    "BCEWithLogits": _bce_logits,
}


def gradients(graph: Graph, loss: str) -> Graph:
    """The graph with outputs ``grad/<parameter>`` of a scalar output; unused parameters get none."""
    out = graph.copy()
    b = Builder(out)
    start = out.outputs[loss]
    reach = {i for i, n in enumerate(graph.nodes) if n.op == "Parameter"}
    for i, n in enumerate(graph.nodes):
        if any(j in reach for j in n.inputs):
            reach.add(i)
    total: dict[int, int] = {start: b.const(1.0)}
    for i in range(start, -1, -1):
        g = total.get(i)
        node = graph.nodes[i]
        if g is None or i not in reach or node.op == "Parameter":
            continue
        rule = VJP.get(node.op)
        if rule is None:
            raise NotImplementedError(f"{node.op} has no gradient")
        if node.op in ("Reshape", "Flatten"):
            node = Node(node.op, node.inputs, (*node.attrs, ("from", _static(graph, node.inputs[0]))))
        for j, own in zip(node.inputs, rule(b, node, i, g, *node.inputs)):
            if own is not None and j in reach:
                total[j] = own if j not in total else b("Add", total[j], own)
    for name, i in graph.named("Parameter").items():
        if i in total:
            out.outputs[f"grad/{name}"] = total[i]
    return out


def _static(graph: Graph, i: int) -> tuple[int, ...]:
    """A node's shape with the one unknown dimension as -1."""
    from lodestone.ml.shape import infer

    return tuple(-1 if d is None else d for d in infer(graph)[i])
