import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_imports_without_the_text_operators(tmp_path, pipeline):
    """The entry and all queries of the library load when the optional subpackage is gone, with or without the pipeline's file."""
    (tmp_path / "tracewright").mkdir()
    for p in (ROOT / "tracewright").iterdir():
        if p.name != "llm":
            (tmp_path / "tracewright" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    if pipeline:
        (tmp_path / "corpus_pipeline.py").write_text("from tracewright.llm import mixing\n\nrun = mixing\n")
    code = (
        "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); "
        "assert 'a01_pass_rate_wilson' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    )
    for path in (str(tmp_path), f"{tmp_path}{os.pathsep}{ROOT}"):
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": path})
