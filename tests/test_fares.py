"""The running fares of a stream, replayed in batches, against the fares of the table of corrected reports."""

import contextlib
import datetime
import random

from waymark.operators import matching
from waymark.streaming import fares

R = random.Random(17)
REPORTS = "route_id long, fare double, confirmed boolean, ts timestamp, report_id long"
START = datetime.datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocks(spark):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def replay(spark, folder, name, batches):
    """By route the rows that the stream gives, in their order, where each batch is a file that comes when the one before is done."""
    (folder / name).mkdir()
    with rocks(spark):
        stream = spark.readStream.schema(REPORTS).parquet(str(folder / name))
        query = fares.running_fares(stream).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(folder / f"{name}_state")).start()
        try:
            for batch in batches:
                spark.createDataFrame(batch, REPORTS).coalesce(1).write.mode("append").parquet(str(folder / name))
                query.processAllAvailable()
        finally:
            query.stop()
    out = {}
    for r in spark.table(name).collect():
        out.setdefault(r.route_id, []).append((r.n_reports, r.n_confirmed, r.latest, r.typical))
    return out


def test_replay_equals_the_batch_query(spark, tmp_path):
    rows = [(i % 4, R.choice([10.0, 12.5, 15.0, 15.0, 20.0]), R.random() < 0.5, START + datetime.timedelta(minutes=i), i) for i in range(240)]
    batches = [rows[:80], rows[80:160], rows[160:]]
    for before, batch in zip([x[-40:] for x in batches[:2]], batches[1:], strict=True):  # corrections, as new, newer and older
        for r in R.sample(before, 12):
            batch += [(r[0], 99.0, not r[2], r[3], r[4]), (r[0], 11.0, r[2], r[3] + datetime.timedelta(seconds=30), r[4]), (r[0], 1.0, r[2], r[3] - datetime.timedelta(seconds=30), r[4])]
    batches[0] += [(None, 1.0, True, START, 900), (1, None, True, START, 901)]
    got = replay(spark, tmp_path, "running", batches)
    corrected = {}
    for batch in batches:
        for r in sorted((r for r in batch if r[0] is not None and r[1] is not None), key=lambda r: (r[3], r[4], r[1], r[2])):
            if r[4] not in corrected or corrected[r[4]][3] <= r[3]:
                corrected[r[4]] = r
    want = {r.route_id: (r.n_reports, r.n_confirmed, r.latest, r.typical) for r in matching.fare_consensus(spark.createDataFrame([*corrected.values()], REPORTS)).collect()}
    assert {k: v[-1] for k, v in got.items()} == want and all(len(v) == 3 for v in got.values())


def test_what_the_watermark_passed_counts_on(spark, tmp_path):
    """A report is corrected while it is open; afterwards one of its id is another report."""
    hour = datetime.timedelta(hours=1)
    batches = [[(1, 10.0, True, START, 5)], [(1, 20.0, True, START + hour, 5)], [(2, 1.0, True, START + 30 * hour, 6)], [(2, 1.0, True, START + 30 * hour, 7)], [(1, 40.0, False, START + 31 * hour, 5)]]
    got = replay(spark, tmp_path, "passing", batches)
    assert got[1] == [(1, 1, 10.0, 10.0), (1, 1, 20.0, 20.0), (2, 1, 40.0, 30.0)]
