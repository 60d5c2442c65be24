import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    names = set(entry.queries())
    assert len(names) > 70 and set(entry.oracle_sql()) <= names


def test_core_never_imports_the_optional_part():
    for f in (ROOT / "pathloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "pathloom").parts:
            assert ".llm" not in f.read_text() and "import llm" not in f.read_text(), f
    code = "import sys; sys.modules['pathloom.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 70 and not any(n.startswith('p1_') for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
