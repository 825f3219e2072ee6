import ast
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCK = "import sys\nsys.modules['frostline.llm'] = None\nsys.modules['corpus_pipeline'] = None\n"


def run(code):
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
    return set(done.stdout.split())


def test_queries_are_known_without_a_session():
    assert {"matcher_chains", "loss_metrics"} <= run("import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()")


def test_entry_works_without_the_optional_part():
    names = run(BLOCK + "import __spark_entry__ as e; print(*e.queries()); assert e.queries().keys() == e.oracle_sql().keys()")
    assert "matcher_chains" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "frostline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                named = [a.name for a in node.names] + [getattr(node, "module", None) or ""] if isinstance(node, ast.Import | ast.ImportFrom) else []
                assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in named), path


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 145
