import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_catalogue():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 70
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6)} <= set(q)


def test_entry(spark, smoke):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_training_queries_run_on_the_smallest_tables(spark, smoke):
    from panelforge.queries_training import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, smoke).count() >= 0, name


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "panelforge").rglob("*.py"):
        if (ROOT / "panelforge" / "llm") in path.parents:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("panelforge.llm") for n in names), path


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['panelforge.llm'] = None; import __spark_entry__ as e; assert not any(k.startswith(('p4', 'p7', 'p8', 'p9')) for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
