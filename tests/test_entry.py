"""The entry module imports and runs without the training-data subpackage too."""

import importlib.util
import subprocess
import sys

import __spark_entry__ as entry


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_key", "representative", "category", "members", "day", "region"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm():
    code = (
        "import importlib.util as u; f = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('evidentia.llm', 'corpus_pipeline') else f(n, *a)\n"
        "import sys, __spark_entry__ as e; q = e.queries(); e.oracle_sql()\n"
        "assert q and not any(k.startswith('op1_') for k in q) and not any('evidentia.llm' in m for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.util.find_spec("__spark_entry__").origin.rpartition("/")[0])
