"""The library without its optional subpackage: a copy of the repository in which both of its folders are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_text_operators(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "lemmaflow" / "llm")
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    if not pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    ask = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert 'tainted' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')] and set(o) <= set(q)"
    done = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "llm" not in "".join(p.read_text() for p in (copy / "lemmaflow").rglob("*.py"))


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from lemmaflow.plans import scratch

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session())
    assert scratch.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
