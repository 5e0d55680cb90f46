import io
import os
import subprocess
import sys
import zipfile
from pathlib import Path

from echofold.ship import package

REPO = Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.queries()["doc_winnow"](spark, {data!r}).count())
"""


def test_archive():
    names = zipfile.ZipFile(io.BytesIO(package())).namelist()
    assert "echofold/__init__.py" in names and "echofold/operators/pairs.py" in names and all(n.endswith(".py") for n in names)


def test_workers_find_the_package_from_anywhere(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO), data=str(tmp_path))], cwd="/", env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS" in done.stdout and int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]
