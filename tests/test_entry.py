"""The entry point with and without the operators on documents."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def asked(folder) -> tuple[set[str], set[str]]:
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, check=True).stdout
    queries, oracles = out.splitlines()
    return set(queries.split()), set(oracles.split())


def copied(tmp_path, *without: str) -> Path:
    names = {n for n in without if "/" not in n} | {".git", "__pycache__", ".pytest_cache"}
    shutil.copytree(REPO, tmp_path / "copy", ignore=lambda folder, found: [
        f for f in found if f in names or str((Path(folder) / f).relative_to(REPO)) in without])
    return tmp_path / "copy"


def test_the_rest_works_without_the_llm_folders(tmp_path):
    queries, oracles = asked(copied(tmp_path, "tablewise/llm", "tests/llm"))
    assert queries and all(q.startswith("q_") for q in queries) and oracles <= queries


def test_the_rest_works_without_the_pipeline_and_the_llm_folders(tmp_path):
    queries, _ = asked(copied(tmp_path, "tablewise/llm", "tests/llm", "corpus_pipeline.py"))
    assert queries and all(q.startswith("q_") for q in queries)
