"""The package reaches Python workers that cannot import it by themselves."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false") \\
    .config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.insert(0, sys.argv[1])  # the driver's path only
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
if sys.argv[2] == "first stage":
    from floatline.llm.language_id import keep_identified
    found = keep_identified(docs)
else:
    from floatline.llm.queries import QUERIES
    found = QUERIES[sys.argv[2]](spark, "/root/testdata/sf0.001")
print("rows", found.count())
"""


@pytest.mark.parametrize("what", ["first stage", "op4_language_id", "op6_best_fit_packing", "op8_zip_warc",
                                  "op11_conversation_repair", "op13_token_alignment"])
def test_first_use_outside_the_repository(tmp_path, what):
    script = tmp_path / "use.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script), REPO, what], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-3000:]
    assert int(out.stdout.split("rows")[1]) > 0
