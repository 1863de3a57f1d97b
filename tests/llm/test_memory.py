"""What a Python worker holds: bounded batches, and nothing kept that a task has freed."""

import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pyarrow as pa

from corpus_pipeline import STAGES
from lakewright.llm import sketch

MB = 1 << 20


def test_a_batch_of_long_texts_is_bounded(spark, tmp_path):
    docs = spark.range(2000, numPartitions=1).selectExpr(
        "id as doc_id", "concat(cast(id as string), repeat(' some word', 1000)) as text", "'en' as lang", "'a' as source", "10000L as n_chars")
    dict(STAGES)["near_copies"](spark, docs, str(tmp_path))

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes], pa.int64())})

    found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(found) > 18 * MB
    assert max(found) < 5 * MB


def test_a_task_gives_back_what_it_freed():
    code = """
        import re
        import numpy as np, pyarrow as pa
        from lakewright.llm.common import gives_back

        def held():
            return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

        def task(batches):
            kept = [bytes(100_000) for _ in range(3000)]  # below malloc's threshold for mappings, so from the heap
            last = []
            while kept:
                last.append(kept.pop()[:64])  # small ones hold the heap's end
                yield len(last)

        def last_of(found):
            *_, n = found
            return n

        before = held()
        last_of(gives_back(task)(iter([])))
        print(held() - before)
    """
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert int(done.stdout) < 60


def test_a_partial_sketch_counts_cells():
    rng = np.random.default_rng(3)
    hashes = np.concatenate([rng.integers(0, 2**64, 5000, np.uint64), np.arange(0, 2**63, 2**53, dtype=np.uint64).repeat(3)])
    for some in (hashes, hashes[:1], hashes[:2].repeat(2)):
        width = sketch.cells_for(len(some))
        part = sketch.partial_sketch(some, width).to_pylist()
        for row in range(2):
            found, counts = np.unique(sketch.cells(some, row, width), return_counts=True)
            ones, twos = (np.concatenate([(r["segment"] % (sketch.MOST_CELLS // sketch.SEGMENT)) * sketch.SEGMENT + np.flatnonzero(
                np.unpackbits(sketch._bits(r[c]), bitorder="little")) for r in part
                if r["segment"] // (sketch.MOST_CELLS // sketch.SEGMENT) == row]) for c in ("ones", "twos"))
            assert ones.tolist() == found.tolist()
            assert twos.tolist() == found[counts > 1].tolist()
