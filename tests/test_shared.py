"""The folder of settled tables without Spark's own setting."""

import os
import subprocess
import sys

SCRIPT = """
from sparkloom.session import build_session
from sparkloom.operators.shared import release, settle, shared_folder
spark = build_session("plain", cores="1", partitions=1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept = settle(spark.range(5))
assert kept.count() == 5
folder = shared_folder(spark).removeprefix("file://")
import os
assert len(os.listdir(folder)) == 1
release(kept)
assert os.listdir(folder) == [], os.listdir(folder)
spark.stop()
print("folder", folder)
"""


def test_folder_without_spark_defaults(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", SCRIPT], env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr[-2000:]
    folder = got.stdout.split("folder ")[1].strip()
    assert not os.path.exists(folder)
