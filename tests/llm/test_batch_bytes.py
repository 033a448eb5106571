import pyarrow as pa
from helpers_llm import frame

from eventframe.llm import common


def test_python_tasks_get_bounded_batches(spark):
    """A batch that isn't bounded in bytes is held several times at once by an executor and its Python worker."""
    docs = common.cut(frame(spark, [(i, "word " * 20_000) for i in range(300)], 1), "long")
    sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) >= 30_000_000 and max(r.n for r in sizes) < 8 << 20
