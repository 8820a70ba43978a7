"""What Python workers hold: at once, after a batch, and after an operator."""

import gc
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from knotwork.llm import pieces
from knotwork.shipping import ship

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

# many small arrays, and one after them that keeps the allocator from giving back the end of its heap by itself
HOLDS = """
import numpy as np, pyarrow as pa
from knotwork.llm import tokens
def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
batch = pa.RecordBatch.from_pydict({"text": ["a b c"] * 10})
list(tokens.batches(batch, "text"))
before = resident()
for part in tokens.batches(batch, "text"):
    made = [np.ones(8000) for _ in range(3000)]
    last = np.ones(8000)
    del made
print(resident() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_batch_leaves_no_freed_memory_behind():
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", HOLDS], cwd=root, env={"PYTHONPATH": str(root), "MALLOC_MMAP_THRESHOLD_": "1000000", "MALLOC_TRIM_THRESHOLD_": "1000000000"}, capture_output=True, text=True, check=True)
    assert int(out.stdout) < 50  # of 192 MB


def test_workers_get_bounded_batches(spark):
    def run(stream):
        for batch in stream:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat(cast(id % 10 as string), 10000) AS text").mapInArrow(run, "n long, size long").collect()
    assert sum(r["n"] for r in rows) == 3000
    assert max(r["size"] for r in rows) < 9 << 20 < sum(r["size"] for r in rows)


def test_another_bound_is_left(spark):
    held = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "1000000b")
        ship(spark)
        assert spark.conf.get(BATCH) == "1000000b"
    finally:
        spark.conf.set(BATCH, held)


def test_an_encoder_goes_with_its_query(spark, make_docs):
    def run(stream):
        for _ in stream:
            pass
        found = sum(type(x).__name__ == "Encoder" for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([found])], names=["found"])

    docs = make_docs([(i, f"some words {i}") for i in range(40)], 8)
    assert pieces.encode(docs).where("size(ids) > 0").count() == 40
    assert [r["found"] for r in spark.range(0, 40, 1, 8).mapInArrow(run, "found long").collect()] == [0] * 8
