"""Tensor graphs: evaluation, shapes, gradients by finite differences, rules, predict and fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.ml.autograd import gradients
from lodestone.ml.evaluate import RUN, evaluate, initial
from lodestone.ml.fit import fit
from lodestone.ml.graph import OPS, Graph
from lodestone.ml.predict import MixesRows, predict
from lodestone.ml.rules import RULES, optimize
from lodestone.ml.shape import ShapeError, infer, mixes_rows
from lodestone.plans.artifact import Artifact
from lodestone.plans.query import Table, col

RNG = np.random.default_rng(7)


def mlp(loss="MSE"):
    g = Graph()
    x, y = g.input("x", 3), g.input("y", 2)
    h = x.linear(g.parameter("w1", 4, 3, init="xavier"), g.parameter("b1", 4)).tanh()
    out = h.linear(g.parameter("w2", 2, 4, init="kaiming"), g.parameter("b2", 2))
    return g.output("out", out).output("loss", out.loss(loss, y))


BODIES = {
    "mlp": lambda g, x, w: (x @ w).tanh(),
    "relu": lambda g, x, w: (x @ w).relu() * 2.0 + x,
    "leaky": lambda g, x, w: (x @ w).apply("LeakyRelu", alpha=0.2) - x.apply("Elu"),
    "softmax": lambda g, x, w: (x @ w).softmax(),
    "log_softmax": lambda g, x, w: (x @ w).log_softmax(),
    "silu": lambda g, x, w: (x @ w).apply("Silu") / 3.0,
    "exp_log": lambda g, x, w: ((x @ w).apply("Exp") + 1.0).apply("Log").apply("Sqrt"),
    "reduce": lambda g, x, w: (x @ w) - (x @ w).mean(1, keep=True) + (x * w.sum(0)).sum(1, keep=True),
    "broadcast": lambda g, x, w: x * w.mean(0) + w.sum() * 0.1,
    "abs_pow": lambda g, x, w: ((x @ w).apply("Abs") + 0.5) ** 1.5,
    "clip_where": lambda g, x, w: (x @ w).apply("Clip", low=-0.4, high=0.4) + x.apply("Greater", 0.1).apply("Where", x @ w, x),
    "shapes": lambda g, x, w: (x @ w).reshape(-1, 3, 1).apply("Squeeze", axes=(2,)).apply("Unsqueeze", axes=(1,)).apply("Flatten").transpose(1, 0).transpose(1, 0),
    "gemm": lambda g, x, w: x.apply("Gemm", w, w.sum(0), trans_b=True, alpha=0.7, beta=0.3),
    "div": lambda g, x, w: x / ((x @ w).sigmoid() + 0.5),
}


@pytest.mark.parametrize("body", sorted(BODIES))
@pytest.mark.parametrize("loss, reduction", [("MSE", "mean"), ("MSE", "sum"), ("L1", "mean"), ("CrossEntropy", "mean"), ("BCEWithLogits", "mean")])
def test_gradients_match_finite_differences(body, loss, reduction):
    g = Graph()
    x, y, w = g.input("x", 3), g.input("y", 3), g.parameter("w", 3, 3, init="normal")
    g.output("loss", BODIES[body](g, x, w).loss(loss, y, reduction))
    full = gradients(g, "loss")
    data = {"x": RNG.normal(size=(5, 3)), "y": np.abs(RNG.normal(size=(5, 3)))}
    w0 = RNG.normal(size=(3, 3)).astype(np.float32)
    got = evaluate(full, data, {"w": w0}, ["grad/w"])["grad/w"]
    for i, j in ((0, 0), (1, 2), (2, 1)):
        step = np.zeros((3, 3), np.float32)
        step[i, j] = 2e-3
        a, b = (evaluate(full, data, {"w": w0 + s * step}, ["loss"])["loss"] for s in (1, -1))
        assert float(got[i, j]) == pytest.approx(float(a - b) / 4e-3, abs=0.02 + 0.03 * abs(float(got[i, j])))


def test_operations_on_small_arrays():
    g = Graph()
    x = g.input("x", 1, 4, 4)
    c = g.constant(np.ones((1, 1, 2, 2)).tolist())
    g.output("conv", x.apply("Conv", c)).output("max", x.apply("MaxPool", kernel=(2, 2))).output("avg", x.apply("AvgPool", kernel=(2, 2)))
    g.output("back", x.apply("MaxPool", kernel=(2, 2)).apply("ConvTranspose", c, stride=(2, 2))).output("all", x.apply("GlobalAvgPool"))
    g.output("ada", x.apply("AdaptiveAvgPool", size=(2, 2))).output("gelu", x.apply("Gelu")).output("hs", x.apply("HardSwish"))
    v = np.arange(16, dtype=np.float32).reshape(1, 1, 4, 4)
    r = evaluate(g, {"x": v})
    assert r["conv"][0, 0, 0, 0] == 0 + 1 + 4 + 5 and r["conv"].shape == (1, 1, 3, 3)
    assert r["max"].ravel().tolist() == [5, 7, 13, 15] and r["avg"].ravel().tolist() == r["ada"].ravel().tolist() == [2.5, 4.5, 10.5, 12.5]
    assert r["back"].shape == (1, 1, 4, 4) and r["back"][0, 0, 0, 0] == 5 and r["all"].item() == 7.5
    shapes = infer(g)
    for name in g.outputs:
        assert tuple(d or 1 for d in shapes[g.outputs[name]]) == r[name].shape


def test_norms_recurrence_attention_and_shapes():
    g = Graph()
    x = g.input("x", 5, 4)
    one, zero = g.constant([1.0] * 4), g.constant([0.0] * 4)
    w = lambda *s: g.constant(RNG.normal(size=s).tolist())
    g.output("ln", x.apply("LayerNorm", one, zero)).output("lstm", x.apply("LSTM", w(12, 4), w(12, 3), w(12)))
    g.output("gru", x.apply("GRU", w(9, 4), w(9, 3), w(9))).output("att", x.apply("Attention", x, x))
    g.output("mha", x.apply("MultiHeadAttention", x, x, w(4, 4), w(4, 4), w(4, 4), w(4, 4), heads=2))
    g.output("slice", x.apply("Slice", axes=(1,), starts=(1,), ends=(3,))).output("split", x.apply("Split", axis=2, sizes=(1, 3), part=1))
    g.output("cat", x.apply("Concat", x, axis=2)).output("pad", x.apply("Pad", pads=(0, 1, 0, 0, 1, 0))).output("gather", x.apply("Gather", [0, 2], axis=1))
    g.output("inorm", x.apply("InstanceNorm", g.constant([1.0] * 5), g.constant([0.0] * 5))).output("gnorm", x.apply("GroupNorm", g.constant([1.0] * 5), g.constant([0.0] * 5), groups=5))
    g.output("emb", g.constant(np.eye(3).tolist()).apply("Embedding", [0, 2])).output("rmax", x.apply("ReduceMax", axes=(2,))).output("rprod", x.apply("ReduceProd", axes=(2,), keep=True))
    r = evaluate(g, {"x": RNG.normal(size=(2, 5, 4))})
    assert abs(r["ln"].mean()) < 1e-5 and r["ln"].std() == pytest.approx(1, abs=0.01)
    shapes = infer(g)
    for name in g.outputs:
        assert tuple(2 if d is None else d for d in shapes[g.outputs[name]]) == r[name].shape, name
    with pytest.raises(ShapeError):
        h = Graph()
        infer(h.output("o", h.input("x", 3) @ h.parameter("w", 4, 2)))


def test_rules_keep_the_result():
    g = Graph()
    x, w, b = g.input("x", 3), g.parameter("w", 3, 3, init="normal"), g.parameter("b", 3, init="normal")
    y = ((x @ w) + b).apply("Dropout", p=0.5).apply("BatchNorm", g.constant([1.0, 2, 3]), g.constant([0.0, 1, 0]), g.constant([0.5, 0, 0]), g.constant([1.0, 4, 1]))
    z = (y * 1.0 + 0.0).transpose(1, 0).transpose(1, 0) + (-(-y))
    g.output("out", z.relu() + z.relu())
    fast = optimize(g)
    ops = [n.op for n in fast.nodes]
    assert not {"Dropout", "BatchNorm", "Transpose", "Neg", "Cast", "MatMul"} & set(ops) and ops.count("Relu") == 1 and "Gemm" in ops
    data = {"x": RNG.normal(size=(4, 3))}
    assert np.allclose(evaluate(g, data)["out"], evaluate(fast, data)["out"], atol=1e-5)
    assert len(RULES) == 8


def test_row_mixing_is_seen():
    g = Graph()
    x = g.input("x", 3)
    cases = {"a": (x.softmax(), False), "b": (x.softmax(0), True), "c": (x.mean(), True), "d": (x.sum(1), False), "e": (x.transpose(1, 0), True)}
    for name, (t, mixed) in cases.items():
        h = Graph(list(g.nodes), {name: t.id})
        h = optimize(h)
        assert mixes_rows(h, [name]) == mixed, name


def test_catalogue_and_storage():
    assert len(OPS) - 3 >= 71 and set(RUN) | {"Input", "Constant", "Parameter", "Opaque"} == set(OPS)
    g = mlp()
    again = Graph.from_json(g.to_json())
    data = {"x": RNG.normal(size=(4, 3)), "y": RNG.normal(size=(4, 2))}
    assert np.array_equal(evaluate(g, data)["out"], evaluate(again, data)["out"])
    assert np.array_equal(initial("a", (2, 2), "normal"), initial("a", (2, 2), "normal"))


def test_predict(spark):
    g = Graph()
    x = g.input("value")
    g.output("result", x * 2.0 + 1.0)
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, value double")
    got = predict(df, g, {"value": F.col("value")})
    assert [f.dataType.typeName() for f in got.schema][-1] == "float"
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 1.0, 3.0), (2, None, 1.0), (3, 3.0, 7.0)]
    m = mlp()
    m.outputs = {"out": m.outputs["out"]}
    rows = spark.createDataFrame([([0.1, 0.2, 0.3],), ([1.0, None, 0.0],)], "v array<double>")
    out = [r["out"] for r in predict(rows, m, {"x": F.col("v"), "y": F.col("v")}).collect()]
    want = evaluate(m, {"x": [[0.1, 0.2, 0.3], [1, 0, 0]], "y": [[0, 0], [0, 0]]})["out"]
    assert np.allclose(out, want, atol=1e-6)
    empty = spark.createDataFrame([(None,), (None,)], "v array<double>")
    assert np.allclose([r["out"] for r in predict(empty, m, {"x": F.col("v"), "y": F.col("v")}).collect()], evaluate(m, {"x": np.zeros((2, 3)), "y": np.zeros((2, 2))})["out"], atol=1e-6)
    with pytest.raises(MixesRows):
        predict(df, g.output("mean", x.mean()), {"value": F.col("value")})


@pytest.mark.parametrize("optimizer, rate", [("sgd", 0.1), ("adam", 0.1)])
def test_fit_line(spark, optimizer, rate):
    g = Graph()
    x, y = g.input("feature", 1), g.input("label", 1)
    out = x.linear(g.parameter("w", 1, 1, init="zeros"), g.parameter("b", 1, init="zeros"))
    g.output("out", out).output("loss", out.loss("MSE", y))
    df = spark.createDataFrame([(i / 4, 2 * i / 4 + 1) for i in range(12)], "feature double, label double").repartition(3)
    inputs = {"feature": F.col("feature"), "label": F.col("label")}
    fitted = fit(df, g, inputs, epochs=60, rate=rate, optimizer=optimizer)
    loss = [r["loss"] for r in fitted.history.orderBy("epoch").collect()]
    assert len(loss) == 60 and loss[-1] < 0.05 * loss[0]
    assert loss[0] == pytest.approx(np.mean([(2 * i / 4 + 1) ** 2 for i in range(12)]), rel=1e-5)
    if optimizer == "sgd":
        assert np.allclose([fitted.graph.values["w"][0][0], fitted.graph.values["b"][0]], [2, 1], atol=0.3)
    assert fit(df.limit(0), g, inputs, epochs=3).history.count() == 0


def test_models_are_part_of_stored_plans(spark):
    spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "feature double, label double").createOrReplaceTempView("points")
    g = Graph()
    x, y = g.input("feature", 1), g.input("label", 1)
    out = x.linear(g.parameter("w", 1, 1, init="zeros"), g.parameter("b", 1, init="zeros"))
    g.output("loss", out.loss("MSE", y))
    query = Table("points").fit(g, {"feature": col("feature"), "label": col("label")}, epochs=4, rate=0.1)
    again = Artifact.from_bytes(query.compile().to_bytes()).run(spark)
    assert [tuple(r) for r in again.orderBy("epoch").collect()] == [tuple(r) for r in query.frame(spark).orderBy("epoch").collect()]
    p = Graph()
    p.output("twice", p.input("feature") * 2.0)
    made = Artifact.from_bytes(Table("points").predict(p, feature=col("feature")).compile().to_bytes()).run(spark)
    assert sorted(r["twice"] for r in made.collect()) == [2.0, 4.0]
