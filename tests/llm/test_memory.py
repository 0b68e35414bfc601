import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, line_dedup, minhash, quality_rules


def test_working_memory_of_hits_does_not_follow_the_texts():
    r = np.random.default_rng(3)
    docs = [r.integers(1, 1 << 63, n, dtype=np.uint64) for n in (2_000_000, 0, 5, 500_000)]
    at = decontamination.WINDOW - 10  # across two windows
    item = docs[0][at : at + 20]
    bits = 22
    bitmap = np.zeros(1 << bits, bool)
    for part in decontamination.keys_of(item, decontamination.MASKS):
        bitmap[part >> np.uint64(64 - bits)] = True
    finder = decontamination.Finder(np.packbits(bitmap, bitorder="little"), bits, {decontamination.kind_of(len(item))})
    docs.append(np.concatenate([r.integers(1, 1 << 63, 40, dtype=np.uint64), item]))  # up to the last token
    every = sum(d.nbytes for d in docs)
    tracemalloc.start()
    try:
        found = list(finder.regions(docs))
        assert tracemalloc.get_traced_memory()[1] < every + (24 << 20)  # one copy of all tokens, and windows
    finally:
        tracemalloc.stop()
    whole = [row for row, _, tokens, _ in found if decontamination.equal_tokens(tokens, item, False) == len(item)]
    assert whole == [0, 4]


@pytest.mark.parametrize("step", [quality_rules.filter_documents, quality_rules.counts, line_dedup.keep_bitmaps, minhash.keep_one, lambda docs: decontamination.leaks(docs, docs.selectExpr("doc_id item_id", "text").where("doc_id < 0"))])
def test_batches_are_bounded_by_bytes(spark, step):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    def run():
        return spark.range(0, 9000, 1, 1).select("id", F.repeat(F.lit("0123456789"), 200).alias("text")).mapInArrow(sizes, "n long, bytes long").collect()

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    step(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string"))
    found = run()
    assert sum(x["n"] for x in found) == 9000 and max(x["bytes"] for x in found) < 1.1 * common.BATCH
    spark.conf.set(name, "1m")  # a user's own bound stays
    step(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string"))
    assert max(x["bytes"] for x in run()) < 1.2 * (1 << 20)
    spark.conf.unset(name)
