"""The entry module's contract, with and without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parent.parent


def test_names_agree_and_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    got = e.entry(spark)
    assert got.columns == ["item_id", "doc_id", "score", "rank"] and got.limit(1).count() == 1


def test_imports_without_llm(tmp_path):
    for name in ("__spark_entry__.py", "lodestrata"):
        src = TOP / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestrata/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lexical_topk' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
