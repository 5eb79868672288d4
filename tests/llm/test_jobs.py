"""Jobs on workers that have no copy of this library, and clusters without a shared folder."""

import subprocess
import sys
from pathlib import Path

import pytest

from cairn.llm import jobs

ROOT = str(Path(__file__).resolve().parents[2])
ALONE = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.range(4).rdd.map(lambda x: 1).count()  # workers start without the library
sys.path.insert(0, {ROOT!r})
from cairn.llm.decontaminate import contaminated
from cairn.llm.ranked import search
from cairn.llm.scoring import score
text = " ".join(f"word{{k}}" for k in range(40))
docs = spark.createDataFrame([(1, text), (2, "other words " * 20)], "doc_id long, text string")
items = spark.createDataFrame([(7, text)], "item_id long, text string")
assert [r["doc_id"] for r in contaminated(docs, items).collect()] == [1]
assert [r["doc_id"] for r in search(docs, items).collect()] == [1]
assert score(docs).count() == 2
print("all done")
"""


def test_workers_need_no_copy(tmp_path):
    run = subprocess.run([sys.executable, "-c", ALONE], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert "all done" in run.stdout, run.stderr[-2000:]


class _Cluster:
    master = "spark://somewhere"

    def getCheckpointDir(self):
        return None


class _Session:
    sparkContext = _Cluster()

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        jobs.checkpoint_folder(_Session())
