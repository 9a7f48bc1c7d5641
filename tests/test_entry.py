"""The entry module with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), 'morans_i' in e.queries())"


def answer(folder) -> list[str]:
    run = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def copied(folder, leave_out: tuple[str, ...]):
    shutil.copytree(os.path.join(ROOT, "urbanpulse"), folder / "urbanpulse", ignore=shutil.ignore_patterns("__pycache__", *leave_out))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), folder)
    return folder


def test_without_the_training_operators(tmp_path):
    n, sql, pipeline, core = answer(copied(tmp_path, ("llm",)))
    assert int(n) >= int(sql) > 90 and (pipeline, core) == ("False", "True")


def test_with_operators_that_cannot_be_imported(tmp_path):
    folder = copied(tmp_path, ("llm",))
    (folder / "urbanpulse" / "llm").mkdir()
    (folder / "urbanpulse" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    (folder / "corpus_pipeline.py").write_text("from urbanpulse.llm import queries\n")
    assert answer(folder)[2:] == ["False", "True"]
