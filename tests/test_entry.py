import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys, pathlib
sys.path[:0] = [sys.argv[1]]
import __spark_entry__ as e
names = set(e.queries())
assert "diversity_indices" in names and set(e.oracle_sql()) <= names
print("llm" if any(n.startswith("op") and n[2].isdigit() for n in names) else "plain", "pipeline" in names)
"""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def copied(folder, skip):
    for path in REPO.rglob("*.py"):
        at = path.relative_to(REPO)
        if not skip & set(at.parts):
            (folder / at).parent.mkdir(parents=True, exist_ok=True)
            (folder / at).write_bytes(path.read_bytes())
    return folder


def said(folder):
    out = subprocess.run([sys.executable, "-c", WITHOUT, str(folder)], capture_output=True, text=True, cwd=folder)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_optional_parts(tmp_path):
    skip = {".git", "llm", "tests", "__pycache__"}
    both, folder = copied(tmp_path / "both", skip | {"corpus_pipeline.py"}), copied(tmp_path / "folder", skip)
    assert said(both) == said(folder) == ["plain", "False"]
    for left in (both, folder):
        (left / "tidewrack" / "llm").mkdir()  # an empty folder that a deletion may leave
        assert said(left) == ["plain", "False"]
