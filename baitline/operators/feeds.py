"""Feed health from the log of fetch attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.breaker import NONE, run_breaker


def win_feed_status(attempts: DataFrame) -> DataFrame:
    """Current status of each feed.

    The log is reduced to one row per feed and hour; only the hour of the last
    success needs its single attempts again.  Feeds with very long logs are
    therefore never gathered in one task.
    """
    healthy, failed = F.col("status") == "healthy", F.col("error").isNotNull()
    place = F.struct("attempted_at", "attempt_id")
    hourly = attempts.groupBy("source", F.date_trunc("HOUR", "attempted_at").cast("timestamp_ntz").alias("hour")).agg(
        F.max(F.struct("attempted_at", "attempt_id", "status")).alias("latest"),
        F.max(F.when(healthy, place)).alias("success"),
        F.max(F.when(failed, F.struct("attempted_at", "attempt_id", "error"))).alias("failure"),
        F.max(F.when(F.col("indicator_count").isNotNull(), F.struct("attempted_at", "attempt_id", "indicator_count"))).alias("counted"),
        F.count_if(failed).alias("failures"),
    )
    newest = hourly.groupBy("source").agg(
        F.max("latest").alias("latest"), F.max("success").alias("success"),
        F.max("failure").alias("failure"), F.max("counted").alias("counted"),
    )
    since = newest.select("source", "success", F.date_trunc("HOUR", "success.attempted_at").cast("timestamp_ntz").alias("last_hour"))
    later_hours = (
        hourly.select("source", "hour", "failures").join(since, "source")
        .filter(F.col("last_hour").isNull() | (F.col("hour") > F.col("last_hour")))
        .groupBy("source").agg(F.sum("failures").alias("n"))
    )
    same_hour = (
        attempts.filter(failed)
        .withColumn("last_hour", F.date_trunc("HOUR", "attempted_at").cast("timestamp_ntz"))
        .join(since, ["source", "last_hour"])
        .filter(place > F.col("success"))
        .groupBy("source").agg(F.count("*").alias("n"))
    )
    errors = later_hours.unionByName(same_hour).groupBy("source").agg(F.sum("n").alias("error_count"))
    return newest.join(errors, "source", "left").select(
        "source",
        F.col("latest.status").alias("status"),
        F.col("success.attempted_at").alias("last_update"),
        F.col("latest.attempted_at").alias("last_attempt"),
        F.coalesce("counted.indicator_count", F.lit(0)).alias("indicator_count"),
        F.coalesce("error_count", F.lit(0)).cast("long").alias("error_count"),
        F.when(
            F.col("success").isNull()
            | (F.struct("failure.attempted_at", "failure.attempt_id") > F.col("success")),
            F.col("failure.error"),
        ).alias("last_error"),
    )


# ---------------------------------------------------------------------------
# Circuit breaker.
#
# The breaker is sequential: what happens to an attempt depends on all earlier
# ones.  Its state is small, though: a failure count, or "open since t".  So
# each (feed, time slice) is turned into a table "state before -> state after",
# the few tables of a feed are chained, and each slice is then replayed from
# its known first state.  A long log is spread over its slices.
# A state is (count, open_since): open_since = NONE means closed.
# ---------------------------------------------------------------------------


class _Slice:
    """Attempts of one feed in one time slice, in order, as a table of state before to state after."""

    def __init__(self, times: np.ndarray, failed: np.ndarray, max_errors: int, recovery: int):
        self.times, self.max_errors, self.recovery = times, max_errors, recovery
        n = len(times)
        place = np.arange(n)
        streak = place - np.maximum.accumulate(np.where(failed, -1, place))
        # Entered closed and clean at i, the breaker opens at the first full streak from i + max_errors - 1 on ...
        full = np.flatnonzero(failed & (streak >= max_errors))
        which = np.searchsorted(full, place + max_errors - 1)
        opens = which < len(full)
        opened = times[full[np.minimum(which, len(full) - 1)]] if len(full) else np.zeros(n, np.int64)
        # ... and lets through again, clean, at the first attempt behind the recovery time.
        again = np.where(opens, np.searchsorted(times, opened + recovery, side="right"), n)
        last = np.where(again < n, again, place)
        while (last[last] != last).any():  # each step doubles the openings that are passed over
            last = last[last]
        trailing = np.minimum(streak[-1], n - last) if failed[-1] else np.zeros(n, np.int64)
        self.count = np.append(np.where(opens[last], max_errors, trailing), 0)
        self.open = np.append(np.where(opens[last], opened[last], NONE), NONE)
        self.lead = int(np.argmin(failed)) if not failed.all() else n

    def resume(self, open_since: int) -> int:
        """First attempt that is let through by a breaker open since then."""
        return int(np.searchsorted(self.times, open_since + self.recovery, side="right"))

    def _entered(self, count: int) -> tuple[int, int]:
        """State after the slice when it is entered closed with some failures in a row."""
        need = self.max_errors - count
        if self.lead >= need:
            opened = int(self.times[need - 1])
            at = self.resume(opened)
            return (self.max_errors, opened) if at == len(self.times) else (int(self.count[at]), int(self.open[at]))
        if self.lead == len(self.times):
            return count + self.lead, NONE
        return int(self.count[self.lead + 1]), int(self.open[self.lead + 1])

    def transitions(self) -> dict:
        closed = [self._entered(c) for c in range(self.max_errors)]
        # A breaker that is open on entry resumes at one of the first attempts.
        n = min(self.resume(int(self.times[0])) + 1, len(self.times))
        count, opened = self.count[:n], self.open[:n]
        ends = np.flatnonzero(np.append((count[1:] != count[:-1]) | (opened[1:] != opened[:-1]), True))
        return {
            "closed_count": [c for c, _ in closed], "closed_open": [o for _, o in closed],
            "resume_until": self.times[ends], "resume_count": count[ends].astype(np.int32), "resume_open": opened[ends],
            "last_time": int(self.times[-1]),
        }


def _micros(values: pd.Series) -> np.ndarray:
    return values.to_numpy().astype("datetime64[us]").astype(np.int64)


_KEYS = "source string, slice timestamp_ntz"
_TABLE = (
    f"{_KEYS}, closed_count array<int>, closed_open array<bigint>, "
    "resume_until array<bigint>, resume_count array<int>, resume_open array<bigint>, last_time bigint"
)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (feed, slice) groups out of sorted batches; holds one group at a time."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        changed = (batch["source"] != batch["source"].shift()) | (batch["slice"] != batch["slice"].shift())
        starts = np.flatnonzero(changed.to_numpy()).tolist()
        if held and held[-1]["source"].iloc[-1] == batch["source"].iloc[0] and held[-1]["slice"].iloc[-1] == batch["slice"].iloc[0]:
            starts = starts[1:]
            first = starts[0] if starts else len(batch)
            held.append(batch.iloc[:first])
        for start, end in zip(starts, [*starts[1:], len(batch)]):
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [batch.iloc[start:end]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def win_circuit_breaker(
    attempts: DataFrame, max_errors: int = 5, recovery_s: int = 300, slice_by: str = "HOUR"
) -> DataFrame:
    """Per attempt: skipped by the breaker?, failures in a row, breaker open afterwards?

    ``slice_by`` sets how finely a feed's log is cut; the result does not depend on it.
    """
    recovery = recovery_s * 1_000_000
    cut = attempts.select(
        "attempt_id", "source", "attempted_at", (F.col("status") != "healthy").alias("failed"),
        F.date_trunc(slice_by, "attempted_at").cast("timestamp_ntz").alias("slice"),
    )

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("source", "slice").sortWithinPartitions("source", "slice", "attempted_at", "attempt_id")

    def tabulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for part in _slices(batches):
            table = _Slice(_micros(part["attempted_at"]), part["failed"].to_numpy(), max_errors, recovery).transitions()
            rows.append({"source": part["source"].iloc[0], "slice": part["slice"].iloc[0], **table})
            if len(rows) == 1000:
                yield pd.DataFrame(rows)
                rows = []
        if rows:
            yield pd.DataFrame(rows)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice", kind="stable")
        count, opened, rows = 0, NONE, []
        for row in pdf.itertuples(index=False):
            rows.append((row.source, row.slice, count, opened))
            if opened == NONE:
                count, opened = int(row.closed_count[count]), int(row.closed_open[count])
            elif row.last_time > opened + recovery:
                at = int(np.searchsorted(np.asarray(row.resume_until), opened + recovery, side="right"))
                count, opened = int(row.resume_count[at]), int(row.resume_open[at])
        return pd.DataFrame(rows, columns=["source", "slice", "count", "open_since"])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, count, opened = None, 0, NONE
        for pdf in batches:
            outcome = []
            changed = ((pdf["source"] != pdf["source"].shift()) | (pdf["slice"] != pdf["slice"].shift())).to_numpy()
            starts = np.flatnonzero(changed)
            for start, end in zip(starts, [*starts[1:], len(pdf)]):
                part = pdf.iloc[start:end]
                key = (part["source"].iloc[0], part["slice"].iloc[0])
                if key != current:
                    current, count, opened = key, int(part["count"].iloc[0]), int(part["open_since"].iloc[0])
                *columns, count, opened = run_breaker(
                    _micros(part["attempted_at"]), part["failed"].to_numpy(), count, opened, max_errors, recovery)
                outcome.append(columns)
            skipped, rows, open_after = (np.concatenate(c) for c in zip(*outcome)) if outcome else ([], [], [])
            yield pdf[["attempt_id", "source", "attempted_at"]].assign(
                skipped=skipped, failures_in_row=rows, circuit_open=open_after)

    tables = in_order(cut).mapInPandas(tabulate, _TABLE)
    # One row per slice: the calendar bounds what a feed's chain holds.
    entries = tables.groupBy("source").applyInPandas(chain, f"{_KEYS}, count int, open_since bigint")
    return in_order(cut.join(entries, ["source", "slice"])).mapInPandas(
        replay,
        "attempt_id bigint, source string, attempted_at timestamp_ntz, "
        "skipped boolean, failures_in_row int, circuit_open boolean",
    )
