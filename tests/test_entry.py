import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q); assert not any(x[:2] == 'op' and x[2].isdigit() or x == 'pipeline' for x in q)"


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    """With and without corpus_pipeline.py, and with a library of theirs missing."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    (copy / "rosterlight" / "llm").mkdir(exist_ok=True)  # an empty folder is no subpackage with queries
    assert not list((copy / "rosterlight" / "llm").iterdir())
    subprocess.run([sys.executable, "-c", ASK], cwd=copy, check=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", ASK], cwd=copy, check=True)
    (copy / "rosterlight" / "llm").rmdir()
    subprocess.run([sys.executable, "-c", ASK], cwd=copy, check=True)
