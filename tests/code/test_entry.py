"""The entry module with and without the text subpackage."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("prismata.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert len(q) > 120 and set(s) <= set(q) and not any(n.startswith("op") or n == "pipeline" for n in q)
"""


def test_imports_without_text_subpackage():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True)


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_query(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["id", "qualified_name", "path", "n"] and df.count() == 10


def test_nothing_else_imports_the_text_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "prismata")):
        if "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                assert not re.search(r"^\s*(from|import)\b.*\bllm\b", open(os.path.join(folder, n)).read(), re.M)
