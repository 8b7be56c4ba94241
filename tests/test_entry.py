import re
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def run(code: str) -> str:
    return subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout


def test_without_the_llm_subpackage():
    names = run("import sys; sys.modules['taxaloom.llm'] = None; import __spark_entry__ as e, bench, taxaloom.plans.commands; print(*e.queries()); print(set(e.oracle_sql()) - set(e.queries()))")
    assert "p1_found" in names and "p2_found" not in names and names.endswith("set()\n")


def test_nothing_else_imports_llm():
    for p in (REPO / "taxaloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


def test_entry_has_rows(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["prefix", "target", "matches", "unique", "lca"] and df.count() > 0
