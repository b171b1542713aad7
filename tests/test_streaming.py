"""The incremental scan finds the same findings as the batch scan."""

import os
import tempfile

from vigil.schemas import FILES
from vigil.streaming.incremental import scan_batch, start_scan_stream


def test_stream_matches_batch(spark):
    from vigil.plans.q_core import corpus_of
    files = corpus_of(spark, "/root/testdata/sf0.001").files.select("project", "path", "content")
    base = tempfile.mkdtemp(prefix="vigil-stream-test-")
    src, sink, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    files.repartition(3).write.parquet(src)
    q = start_scan_stream(spark, src, sink, ck, max_files_per_trigger=1)
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink).drop("batch_id")
    batch = scan_batch(spark.read.schema(FILES).parquet(src))
    assert streamed.count() == batch.count() > 0
    assert streamed.select("id").subtract(batch.select("id")).count() == 0
