"""SQL functions, streams with late rows, and an entry that imports without what is missing."""

import os
import shutil
import subprocess
import sys
from datetime import datetime, timedelta

import pytest

from sigtrace.functions.register import register
from sigtrace.plans import fixtures
from sigtrace.streaming.windows import windowed

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_functions(spark):
    assert set(register(spark)) >= {"zero_width_count", "file_parts"}
    row = spark.sql("SELECT zero_width_count('a​b‌') AS n, is_tracked_link('http://x/PIXEL.gif') AS t, without_query('http://x/?a=1') AS u").first()
    assert tuple(row) == (2, True, "http://x/")
    spark.createDataFrame([("p", bytearray(fixtures.png())), ("z", bytearray(fixtures.docx())), ("n", None)], "path string, content binary").createOrReplaceTempView("files_here")
    got = spark.sql("SELECT path, p.part_type FROM files_here, LATERAL file_parts(content) p ORDER BY path, ordinal").collect()
    assert [r["part_type"] for r in got if r["path"] == "p"] == ["IHDR", "IDAT", "IEND"] and len([r for r in got if r["path"] == "z"]) == 7
    plan = spark.sql("SELECT zero_width_count(path) FROM files_here")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    day = datetime(2024, 1, 1)
    batches = [[(day + timedelta(minutes=m), "a", 1.0) for m in (5, 20)], [(day + timedelta(hours=3), "a", 1.0)], [(day + timedelta(minutes=30), "a", 1.0), (day + timedelta(hours=2, minutes=55), "a", 1.0)], [(day + timedelta(hours=9), "a", 1.0)], [(day + timedelta(hours=19), "a", 1.0)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source)
        query = windowed(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["start"].hour: r["n"] for r in spark.read.parquet(out).collect()}
    # The first hour was closed when the row of 0:30 came; the one of 2:55 came within ten minutes of the latest.
    assert got[0] == 2 and got[2] == 1 and got[3] == 1


@pytest.mark.parametrize("missing", ["", "xxhash", "tokenizers", "folders"])
def test_the_entry_imports_without(tmp_path, missing):
    to = tmp_path / "repo"
    shutil.copytree(HERE, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    hidden = f"import sys; sys.modules['{missing}'] = None; " if missing in ("xxhash", "tokenizers") else ""
    if missing == "folders":
        shutil.rmtree(to / "sigtrace" / "llm", ignore_errors=True)
        (to / "corpus_pipeline.py").unlink(missing_ok=True)
    code = hidden + "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=to, capture_output=True, text=True, check=True)
    n, pipeline = done.stdout.split()
    there = os.path.isdir(os.path.join(HERE, "sigtrace", "llm"))
    assert int(n) >= 40 and (pipeline == "True") == (there and missing in ("", "tokenizers"))
