"""The driver contract, and that the engine stands without the training-data folder."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_sql():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert sql.keys() <= queries.keys() and len(queries) > 40


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_engine_imports_without_the_folder():
    code = "import sys; sys.modules['pathloom.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert 'big_files' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "pathloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"\bllm\b", path.read_text())
