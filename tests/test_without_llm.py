"""The rest of the library doesn't need the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_no_import_of_the_optional_package():
    for f in (ROOT / "sparkloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "sparkloom.llm" not in f.read_text(), f


def test_entry_without_it():
    code = "import sys; sys.modules['sparkloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k[0] == 'p' and k[1].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
