"""The entry module with and without the optional text operators."""

import shutil
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def _said(folder) -> list[str]:
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_text_operators():
    top = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    shutil.copytree(ROOT / "tessera", top / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", top)
    count, texts, known = _said(top)
    assert int(count) > 200 and (texts, known) == ("False", "True")


def test_entry_shows_a_broken_operator():
    top = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    shutil.copytree(ROOT / "tessera", top / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", top)
    (top / "tessera/llm").mkdir()
    (top / "tessera/llm/queries.py").write_text("import nothing_of_this_name")
    assert subprocess.run([sys.executable, "-B", "-c", SAY], cwd=top, capture_output=True).returncode
