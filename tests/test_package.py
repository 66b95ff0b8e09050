"""The package reaches Python workers wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {entry!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", entry.queries()["anchored_windows"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_side_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(entry=os.path.join(ROOT, "__spark_entry__.py"))],
                         cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS")[1]) > 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from cuelake.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default, set=lambda *a: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda key, default=None: "s3://shared" if key == "spark.checkpoint.dir" else default)
    assert shared_dir(SimpleNamespace(conf=named)) == "s3://shared"
