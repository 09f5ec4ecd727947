"""The best results while a job runs: stream and batch agree, with late, repeated and useless rows."""

import random

from filamenta.streaming.best import best_of, best_so_far

SCHEMA = "job string, rid long, score double"


def test_stream_and_batch_agree(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"j{rng.randrange(4)}", rng.randrange(60), rng.choice([rng.random(), 0.5, None, float("nan")])) for _ in range(300)] + [(None, 1, 1.0), ("j0", None, 1.0)]
    (tmp_path / "in").mkdir()
    seen = {}

    def note(batch, number):
        for r in batch.collect():
            seen.setdefault((r["job"], r["version"]), []).append((r["rank"], r["rid"], r["score"]))

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    query = best_so_far(stream, "job", "score", "rid", 5).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", f"file://{tmp_path}/at").start()
    try:
        for k, part in enumerate([rows[:100], rows[:50], rows[100:], rows[200:]]):  # some come twice, some late
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
            query.processAllAvailable()
            if k == 1:
                versions = len(seen)
        assert query.exception() is None
    finally:
        query.stop()
    last = {}
    for (job, version), best in sorted(seen.items()):
        assert [r for r, _, _ in sorted(best)] == list(range(1, len(best) + 1)) and len(best) <= 5
        last[job] = sorted(best)
    want = {}
    for r in best_of(spark.createDataFrame(rows, SCHEMA), "job", "score", "rid", 5).collect():
        want.setdefault(r["job"], []).append((r["rank"], r["rid"], r["score"]))
    assert last == {j: sorted(b) for j, b in want.items()} and versions == 4  # rows that came again told nothing
