"""Operators run on workers that cannot import the library."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from sparkloom.session import build_session
from sparkloom.llm import cap_filters, decontaminate, product_codes, quality_trees
spark = build_session("workers", cores="2", partitions=2)
def imports(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"found": [importlib.util.find_spec("sparkloom") is not None]})
assert not spark.range(1).mapInArrow(imports, "found boolean").first()[0]
docs = spark.createDataFrame([(1, "Here stands: what is the tallest hill of this land? It is the grey one of two.", 5)], "doc_id long, text string, n int")
items = spark.createDataFrame([(4, "What is the tallest hill of this land? It is the grey one.")], "item_id long, text string")
assert [r.item_id for r in decontaminate.find_leaks(docs, items).collect()] == [4]
vectors = spark.createDataFrame([(k, [float(k % 3)] * 16, 1) for k in range(9)], "vec_id long, embedding array<double>, label int")
assert len(product_codes.encode_vectors(vectors).collect()) == 9 and cap_filters.near_vectors(vectors).count() == 9
assert len(quality_trees.judge_documents(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()) == 1
print("done")
"""


def test_workers_without_the_library(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT, root], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert got.stdout.strip().endswith("done"), got.stderr[-3000:]
