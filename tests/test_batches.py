from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from paperloom.functions.batches import BATCH_BYTES
from paperloom.operators import chunking


def test_chunkers_get_batches_of_bounded_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, str(1 << 30))
        sizes = []

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in texts:
                yield pd.Series([[str(int(b.str.len().sum()))]] * len(b))

        texts = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
        chunking.recursive_chunks(texts)  # sets the bound of what is run from now on
        seen = F.pandas_udf(run, "array<string>").asNondeterministic()
        sizes = [int(r.s[0]) for r in texts.select(seen("text").alias("s")).distinct().collect()]
        assert len(sizes) >= 1 and max(sizes) <= BATCH_BYTES + 10_000
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
