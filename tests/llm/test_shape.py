"""What the subpackage promises about itself."""

import ast
import pathlib

ROOT = pathlib.Path(__file__).parents[2]


def sources(folder):
    return {p: ast.parse(p.read_text()) for p in (ROOT / folder).rglob("*.py")}


def test_nothing_else_imports_the_subpackage():
    for path, tree in sources("lodestone").items():
        if "llm" in path.parts:
            continue
        for node in ast.walk(tree):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lodestone.llm") for n in names), path


def test_operators_do_not_swallow_import_errors_or_use_local_checkpoints():
    for path, tree in {**sources("lodestone/llm"), ROOT / "corpus_pipeline.py": ast.parse((ROOT / "corpus_pipeline.py").read_text())}.items():
        for node in ast.walk(tree):
            if isinstance(node, ast.ExceptHandler):
                assert "ImportError" not in ast.unparse(node), path
            if isinstance(node, ast.Attribute):
                assert node.attr not in ("localCheckpoint", "crossJoin"), path


def test_the_native_operator_runs_no_python(spark):
    from lodestone.llm.secrets import op6_secret_scan

    plan = op6_secret_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
