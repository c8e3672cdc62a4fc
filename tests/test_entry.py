import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["quillspark.llm", "corpus_pipeline", "xxhash", "zstandard"])
def test_entry_without_optional_parts(missing):
    """What the optional queries need may be missing; the others are there all the same."""
    code = f"import sys; sys.modules[{missing!r}] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    names, oracles = (part.split() for part in said.split("|"))
    assert "parse_part" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names) and "parse_part" in oracles


def test_every_oracle_has_its_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
