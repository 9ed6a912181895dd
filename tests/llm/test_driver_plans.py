"""What the driver has to plan: steps that several later ones read are written once, not planned anew in each; jobs on long
rows hold few of them at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import mixing, toxicity


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_mixing_plans_few_joins(spark):
    d = spark.createDataFrame([(i, "w " * (i + 1), f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    assert joins(mixing.mixture(d)) <= 4
    assert joins(mixing.take(d)) <= 1


BYTES, ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"


def test_toxicity_holds_few_long_rows(spark, tmp_path, monkeypatch):
    docs = [(i, f"calm day {i % 7}" + (" vile awful" if i % 3 == 0 else ""), "en" if i % 2 else None, "s") for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held, plain, before = {}, C.materialize, (spark.conf.get(BYTES), spark.conf.get(ROWS))

    def spy(df, name):
        held[name] = int(spark.conf.get(BYTES).rstrip("b")), int(spark.conf.get(ROWS))
        return plain(df, name)

    monkeypatch.setattr(C, "materialize", spy)
    got = toxicity.op7_toxicity(spark, str(tmp_path))
    # The texts are read in the operator's own jobs; what is returned reads the narrow table that they wrote.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "ExistingRDD" not in plan
    assert held.keys() == {"toxic-marks", "toxic-parts", "toxic-scores"}
    assert all(size <= 4 << 20 and rows <= 64 for size, rows in held.values())
    assert (spark.conf.get(BYTES), spark.conf.get(ROWS)) == before and got.count() == 90


def test_small_batches(spark):
    def sent(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    long = spark.range(0, 120, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    with C.small_batches(spark):
        most = [r.n for r in long.mapInArrow(sent, "n long").collect()]
    assert sum(most) == 120 and max(most) <= 60
    spark.conf.set(BYTES, "8m")
    try:
        with C.small_batches(spark):
            assert spark.conf.get(BYTES) == "8m"
        assert spark.conf.get(BYTES) == "8m"
    finally:
        spark.conf.unset(BYTES)
