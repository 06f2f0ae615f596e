"""Where scratch tables go."""

import os
import subprocess
import sys
import tempfile
from pathlib import Path
from types import SimpleNamespace

import pytest

from stemma.session import Scratch

ALONE = """
from stemma.session import Scratch, local_session
spark = local_session(2, 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = Scratch(spark), Scratch(spark)
assert a.cut(spark.range(5)).count() == 5 and b.cut(spark.range(3)).count() == 3
assert a.root.rsplit("/", 1)[0] == b.root.rsplit("/", 1)[0] == Scratch.local
a.clear()
assert not a.exists() and b.exists()
print("fine")
"""


def test_without_the_setting_a_local_master_gets_a_temporary_folder():
    with tempfile.TemporaryDirectory() as conf:
        env = os.environ | {"SPARK_CONF_DIR": conf, "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
        done = subprocess.run([sys.executable, "-c", ALONE], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_a_cluster_has_to_name_a_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        Scratch(cluster)


def test_tables_in_folders_by_a_column(spark):
    scratch = Scratch(spark)
    kept = scratch.cut(spark.range(10).selectExpr("id", "cast(id % 3 as int) as k"), by=("k",))
    assert sorted(map(tuple, kept.where("k = 1").collect())) == [(1, 1), (4, 1), (7, 1)]
