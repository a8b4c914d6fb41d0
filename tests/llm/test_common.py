import pyarrow as pa

from folio.llm import common as op


def test_python_gets_few_rows_at_once_in_writes(spark):
    """A batch of 10 000 whole texts, Spark's default, is large in the executor and again in its Python worker."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"])

    before = {k: spark.conf.get(k, None) for k in (op.CLEANUP, op.BATCH)}
    got = [r["n"] for r in op.materialize(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(got) == 5000 and max(got) <= 1000
    assert {k: spark.conf.get(k, None) for k in (op.CLEANUP, op.BATCH)} == before
