"""Running fares of routes from a stream of reports that can be corrected, with an exact median, in state that the reports don't grow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNNING = T.StructType([T.StructField("route_id", T.LongType()), T.StructField("n_reports", T.LongType()), T.StructField("n_confirmed", T.LongType()), T.StructField("latest", T.DoubleType()), T.StructField("typical", T.DoubleType())])


class Running(StatefulProcessor):
    """State of a route: how many reports have each fare; the totals and the latest report; and of reports that can still be corrected their last version. The first is bounded by the number of different fares, the
    last by the reports of `late` seconds: a timer takes out those that the watermark has passed, which count on."""

    def __init__(self, late: int):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fares = handle.getMapState("fares", "fare double", "n long")
        self.open = handle.getMapState("open", "report_id long", "fare double, confirmed boolean, ts long")
        self.totals = handle.getValueState("totals", "n long, confirmed long, ts long, report_id long, latest double")

    def add(self, fare: float, by: int) -> None:
        n = (self.fares.getValue((fare,))[0] if self.fares.containsKey((fare,)) else 0) + by
        if n:
            self.fares.updateValue((fare,), (n,))
        else:
            self.fares.removeKey((fare,))

    def median(self) -> float | None:
        counts = sorted((k[0], v[0]) for k, v in self.fares.iterator())
        total = sum(n for _, n in counts)
        ranks, found, before = ((total - 1) // 2, total // 2), [], 0
        for fare, n in counts:
            found += [fare for r in ranks if before <= r < before + n]
            before += n
        return found[0] * 0.5 + found[1] * 0.5 if total else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, confirmed, ts, report, latest = self.totals.get() if self.totals.exists() else (0, 0, -(1 << 62), -1, None)
        table = pd.concat(list(rows)).sort_values(["at", "report_id", "fare", "confirmed"], kind="stable")
        for r in table.itertuples():
            if self.open.containsKey((r.report_id,)):
                fare, was, at = self.open.getValue((r.report_id,))
                if at > r.at:
                    continue  # a version that is older than the known one
                self.add(fare, -1)
                n, confirmed = n - 1, confirmed - bool(was)
            self.open.updateValue((r.report_id,), (float(r.fare), bool(r.confirmed), int(r.at)))
            self.add(float(r.fare), 1)
            n, confirmed = n + 1, confirmed + bool(r.confirmed)
            if (r.at, r.report_id) >= (ts, report):
                ts, report, latest = int(r.at), int(r.report_id), float(r.fare)
        self.totals.update((n, confirmed, ts, report, latest))
        self.handle.registerTimer((ts // 1000 // 1000 + self.late) * 1000 + 1)
        yield pd.DataFrame({"route_id": [key[0]], "n_reports": [n], "n_confirmed": [confirmed], "latest": [latest], "typical": [self.median()]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for k in [k for k, v in self.open.iterator() if v[2] + self.late * 1_000_000 <= passed]:
            self.open.removeKey(k)
        yield pd.DataFrame({f.name: pd.Series([], dtype="float64" if isinstance(f.dataType, T.DoubleType) else "int64") for f in RUNNING.fields})

    def close(self) -> None:
        pass


def running_fares(reports: DataFrame, late: str = "2 hours", seconds: int = 7200) -> DataFrame:
    """(route_id, n_reports, n_confirmed, latest, typical) of a stream of reports (route_id, fare, confirmed, ts, report_id), in update mode: a row for each route that a batch changes, with all so far.

    A report that repeats an id corrects it, if it is as new at least and the former one isn't more than `late` behind the newest; others count as they are. typical is the exact median. Reports without a fare, a time, a route or an id are left
    out. The session needs the RocksDB state store. The last row of a route is what operators.matching.fare_consensus gives for the corrected reports.
    """
    known = reports.where("route_id is not null and fare is not null and ts is not null and report_id is not null").withWatermark("ts", late)
    rows = known.select(F.col("route_id").cast("long").alias("route_id"), F.col("fare").cast("double").alias("fare"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.unix_micros("ts").alias("at"), F.col("report_id").cast("long").alias("report_id"), "ts")
    return rows.groupBy("route_id").transformWithStateInPandas(statefulProcessor=Running(seconds), outputStructType=RUNNING, outputMode="Update", timeMode="EventTime")
