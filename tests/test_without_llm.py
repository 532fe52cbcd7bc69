"""The entry file and the toolkit work without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "cedarflow"), tmp_path / "cedarflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'group_sum' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) == set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env)


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "cedarflow")):
        if "llm" in os.path.relpath(folder, ROOT).split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert ".llm" not in text.read(), f
