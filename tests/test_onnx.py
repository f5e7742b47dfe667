"""ONNX files against the runtime that is installed, and back."""

import numpy as np
import pytest

from lodestone.ml.evaluate import evaluate
from lodestone.ml.graph import Graph
from lodestone.ml.onnx import export, load

ort = pytest.importorskip("onnxruntime")
RNG = np.random.default_rng(3)


def models():
    g = Graph()
    x = g.input("x", 3)
    h = x.linear(g.parameter("w1", 4, 3, init="xavier"), g.parameter("b1", 4, init="normal")).relu()
    out = h.linear(g.parameter("w2", 2, 4, init="kaiming"), g.parameter("b2", 2, init="normal"))
    g.output("p", out.softmax()).output("logs", out.log_softmax()).output("mean", (h @ g.parameter("m", 4, 2, init="normal")).mean(1, keep=True))
    yield "mlp", g, {"x": RNG.normal(size=(5, 3))}
    g = Graph()
    x = g.input("x", 4)
    y = (x.apply("LeakyRelu", alpha=0.2) + x.apply("Elu")) * x.sigmoid() - x.tanh() / 2.0
    y = y.apply("Clip", low=-0.5, high=0.7).apply("Silu").apply("Abs").apply("Exp").apply("Log").apply("Dropout")
    g.output("y", y).output("s", y.reshape(-1, 2, 2).transpose(0, 2, 1).apply("Flatten").sum(1)).output("u", y.apply("Unsqueeze", axes=(1,)).apply("Squeeze", axes=(1,)))
    g.output("c", y.apply("Concat", x, axis=1)).output("mx", x.apply("ReduceMax", axes=(1,)))
    yield "elementwise", g, {"x": RNG.normal(size=(6, 4))}
    g = Graph()
    x = g.input("x", 2, 6, 6)
    y = x.apply("Conv", g.parameter("k", 3, 2, 3, 3, init="normal"), g.parameter("kb", 3, init="normal"), pads=(1, 1, 1, 1)).relu()
    one, zero = g.parameter("one", 3, init="ones"), g.parameter("zero", 3, init="zeros")
    z = y.apply("BatchNorm", one, zero, zero, one)
    g.output("max", z.apply("MaxPool", kernel=(2, 2))).output("avg", z.apply("AvgPool", kernel=(2, 2))).output("gap", z.apply("GlobalAvgPool")).output("in", y.apply("InstanceNorm", one, zero))
    yield "convolution", g, {"x": RNG.normal(size=(2, 2, 6, 6))}


@pytest.mark.parametrize("name, graph, data", list(models()), ids=lambda v: v if isinstance(v, str) else "")
def test_runtime_and_round_trip_agree(name, graph, data):
    data = {k: v.astype(np.float32) for k, v in data.items()}
    want = evaluate(graph, data)
    raw = export(graph)
    session = ort.InferenceSession(raw, providers=["CPUExecutionProvider"])
    for o, got in zip(graph.outputs, session.run(list(graph.outputs), data)):
        assert np.allclose(got, want[o], atol=1e-4), o
    again = load(raw)
    for o, got in evaluate(again, data).items():
        assert np.allclose(got, want[o], atol=1e-4), o
    assert set(load(export(again)).outputs) == set(graph.outputs)


@pytest.mark.parametrize("to", ["int64", "int32", "bool", "float32", "float64"])
def test_cast_keeps_its_type(to):
    g = Graph()
    x = g.input("x", 3)
    g.output("y", x.apply("Cast", to=to) * 2.0)
    feed = {"x": np.array([[1.7, -2.6, 0.0]], np.float32)}
    want = evaluate(g, feed)["y"]
    data = export(g)
    assert evaluate(load(data), feed)["y"] == pytest.approx(want)
    assert ort.InferenceSession(data).run(None, feed)[0] == pytest.approx(want)
