"""The optional part may be missing, or what it needs; the rest is still registered."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["corpus_pipeline", "treelens.llm.queries", "tokenizers", "public_tokenizers", "ahocorasick"])
def test_core_queries_are_there_without_the_optional_part(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as entry; from treelens.plans.queries import QUERIES\n"
        "assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) <= set(QUERIES)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
