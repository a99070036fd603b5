import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from stratalex.plans import registry

ROOT, DATA = Path(__file__).resolve().parents[1], "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["l", "r", "count_ab", "count_a", "count_b", "pmi", "llr", "asymmetry"]


def shown(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    out = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(shown(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(shown(r[k]) for k in at) for r in out.fetchall())


def test_whole_texts_are_read(spark):
    con = duckdb.connect()
    q = registry.queries()
    size = con.execute(f"select sum(length(text)) from '{DATA}/conversations.parquet'").fetchone()[0]
    rows = q["y12_reassembly"](spark, DATA).collect()
    assert sum(len(r["dialogue"]) for r in rows) > size and sum(r["n"] for r in rows) == con.execute(f"select count(*) from '{DATA}/conversations.parquet'").fetchone()[0]
    assert max(r["distance"] for r in q["x1_whole_distance"](spark, DATA).collect()) > 20


def test_nothing_else_imports_the_subpackage():
    found = [p for p in (ROOT / "stratalex").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and re.search(r"\bllm\b", p.read_text())]
    assert not found


def test_entry_imports_without_it(tmp_path):
    import shutil

    shutil.copytree(ROOT / "stratalex", tmp_path / "stratalex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
