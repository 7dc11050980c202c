"""The entry point with and without the optional subpackage."""
import subprocess
import sys
from pathlib import Path
from shutil import copytree, ignore_patterns

import pytest

ROOT = Path(__file__).parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries())"


def imported(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_subpackage(tmp_path, pipeline):
    left_out = ["llm", ".git", "__pycache__"] + ([] if pipeline else ["corpus_pipeline.py"])
    copy = tmp_path / "repo"
    copytree(ROOT, copy, ignore=ignore_patterns(*left_out))
    count, numbered, piped = imported(copy)
    assert int(count) > 100 and (numbered, piped) == ("False", "False")


def test_an_empty_folder_is_no_subpackage(tmp_path):
    copy = tmp_path / "repo"
    copytree(ROOT, copy, ignore=ignore_patterns("llm", ".git", "__pycache__"))
    (copy / "evcat" / "llm").mkdir()
    assert imported(copy)[1:] == ["False", "False"]
