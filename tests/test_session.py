"""Where workers find the package, and where scratch tables go."""

from __future__ import annotations

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from conftest import ROOT, SMALL
from lurewatch.session import remove_folders, shared_folder

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {here!r}).getOrCreate()
print("rows", entry.queries()["mail_parse"](spark, {data!r}).count())
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, here=str(tmp_path / "warehouse"), data=SMALL)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def session(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.split(".")[1], default)),
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )


def test_a_cluster_needs_a_shared_root():
    for root in ("file:/home/x", "/home/x"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_folder(session("yarn", sql=root), "p")
    assert shared_folder(session("yarn", checkpoint="file:///shared", sql="/x"), "p").startswith("file:///shared/lurewatch/app/p-")
    assert shared_folder(session("yarn", sql="hdfs://n/w/"), "p").startswith("hdfs://n/w/lurewatch/app/p-")
    assert shared_folder(session("local[4]", sql="/x"), "p").startswith("/x/lurewatch/app/p-")


def test_folders_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lurewatch.session._own_folder", lambda s: str(tmp_path / "own"))
    folder = shared_folder(spark, "some")
    spark.range(3).write.parquet(folder)
    assert os.path.isdir(folder)
    remove_folders(spark)
    assert not os.path.exists(tmp_path / "own")
