"""The entry module with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def _counted(folder):
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    n, sql, own, pipeline = _counted(copy)
    assert int(n) > 200 and int(sql) > 150 and pipeline == "False" and int(own) == 0
    # the pipeline's module alone, or the operators without it, register nothing either
    (copy / "corpus_pipeline.py").write_text("from spacetide.llm import byte_bpe\n")
    assert _counted(copy)[0] == n
