"""Every registered query of the engine against its DuckDB oracle."""

import duckdb
import pytest

from palisade.plans.oracles import ORACLES
from palisade.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def shown(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x)
    return list(frame.columns), sorted(tuple(map(one, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, db, name):
    assert shown(QUERIES[name](spark, FOLDER).toPandas()) == shown(db.sql(ORACLES[name]).df())


def test_entry_imports_without_the_training_data_subpackage(tmp_path):
    """A copy without the llm folders and the pipeline still imports and lists the other queries."""
    import shutil
    import subprocess
    import sys

    root = __file__.rsplit("/", 2)[0]
    shutil.copytree(f"{root}/palisade", tmp_path / "palisade", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'timing' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
