"""Pandas UDFs must import the package on the Python workers even when the driver runs
from another folder (as on a cluster, where the package is shipped with addPyFile)."""
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import functions as F
from churnlens.functions import special as sf
from churnlens.session import get_spark
spark = get_spark("churnlens-deploy-test", master="local[2]", shuffle_partitions=2)
rows = spark.range(4).select(sf.norm_two_sided_udf(F.col("id").cast("double")).alias("p")).orderBy("p").collect()
print("P", ",".join(f"{{r['p']:.6f}}" for r in rows))
spark.stop()
"""


def test_pandas_udf_from_foreign_cwd():
    with tempfile.TemporaryDirectory() as cwd:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                             timeout=300)
    line = [x for x in out.stdout.splitlines() if x.startswith("P ")]
    assert line, out.stderr[-2000:]
    assert line[0] == "P 0.002700,0.045500,0.317311,1.000000"
