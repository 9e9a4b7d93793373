import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[1]


def test_nothing_else_imports_the_optional_package():
    for path in (ROOT / "eventloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+eventloom\.llm|corpus_pipeline", path.read_text()), path


def test_entry_module_without_it():
    code = "import sys; sys.modules['eventloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'rank_inversions' in q and not any(k.startswith('op') and k[2].isdigit() for k in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
