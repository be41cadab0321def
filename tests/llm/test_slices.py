"""Python steps work on runs of rows of bounded size, whatever the size of the batch."""

import pyarrow as pa

from riskspark.llm import bpe, simhash
from riskspark.llm.common import slices


def test_runs_cover_the_batch():
    texts = ["x" * 40, None, "y" * 30, "z" * 500, "", "w" * 90, "v" * 5]
    batch = pa.RecordBatch.from_pydict({"i": list(range(7)), "t": texts})
    runs = list(slices(batch, "t", 100))
    assert [r for run in runs for r in run.to_pylist()] == batch.to_pylist()
    assert [run.column("i").to_pylist() for run in runs] == [[0, 1, 2], [3, 4], [5, 6]]
    assert [run.num_rows for run in slices(batch.slice(0, 0), "t")] == [0]
    assert [r for run in slices(batch.slice(2, 3), "t", 100) for r in run.to_pylist()] == batch.to_pylist()[2:5]


class Docs:
    """Stands for a table: hands out the function that runs inside a task."""

    def mapInArrow(self, function, shape):
        return function


def test_chunks_of_a_large_batch_leave_in_runs():
    text = " ".join(f"word{i}" for i in range(100_000))  # about 1 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(20)), "text": [f"{i} {text}" for i in range(20)]})
    out = list(bpe.find_chunks(Docs())(iter([batch])))
    assert len(out) > 3 and sum(b.num_rows for b in out) > 20 * 500
    one = list(bpe.find_chunks(Docs())(iter([batch.slice(7, 1)])))
    assert set(map(str, one[0].to_pylist())) <= {str(r) for b in out for r in b.to_pylist()}
    assert simhash.fingerprint(None) == 0
