"""The shared folder in a session without ``spark.checkpoint.dir``."""

import os
import subprocess
import sys

PROGRAM = """
from arenaflow.session import local_session
from arenaflow.shared import forget, shared_dir, written
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
a = written(spark.range(3), "t")
b = written(spark.range(4), "t")
forget(a)
assert b.count() == 4 and shared_dir(spark) == shared_dir(spark)
print("fine", shared_dir(spark))
"""


def test_folder_of_its_own(tmp_path):
    """An empty folder of Spark's settings hides those of the machine."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.startswith("fine file:///tmp/spark-"), done.stderr[-2000:]
