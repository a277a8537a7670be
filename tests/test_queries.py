import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sigtrace.plans import queries as own
from sigtrace.streaming.windows import stream_findings, windowed

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(df, columns):
    return sorted(str(r) for r in df[columns].astype(object).where(df[columns].notna(), None).astype(str).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_rows_as_sql(spark, con, name):
    a, b = own.queries()[name](spark, DATA).toPandas(), con.sql(own.oracle_sql()[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert rows(a, columns) == rows(b, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streams(spark, tmp_path):
    from sigtrace.plans.marked import marked

    docs = marked(spark, DATA)
    docs.write.parquet(str(tmp_path / "in"))
    stream_findings(spark, str(tmp_path / "in"), docs.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "out"), str(tmp_path / "cp"), ["doc_id"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == own.queries()["findings_long"](spark, DATA).count()
    assert windowed(spark.read.parquet(f"{DATA}/events.parquet")).agg({"n": "sum"}).first()[0] == 1000


def test_plan_has_no_python_and_prunes_columns(spark):
    plan = own.queries()["zero_width_by_lang"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "source" not in plan.split("ReadSchema")[1]
