"""Alerts as a log of changes that is only added to, replayed to any time.

Each cycle adds the alerts that are new and those whose status it changed, in full, under its run id. An alert changes
twice at most, so replaying the log reads no more than twice what a snapshot would hold, and every earlier state stays. A run
is one commit of the store: log and list of runs change together, and of two cycles at once one gets ``CommitConflict``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.functions.columns import ntz
from cellgauge.schemas import ALERT_SCHEMA
from cellgauge.sources.lake import PARTITION
from cellgauge.sources.versions import TableStore

CHANGES, RUNS = "alert_changes", "alert_runs"


def changes(before: DataFrame, after: DataFrame, run_id: str, as_of: datetime) -> DataFrame:
    """Rows of ``after`` that ``before`` lacks or has in another status, with run_id, changed_at and the date of it. Ids are
    unique in both."""
    known = before.select("alert_id", F.col("status").alias("_was"))
    changed = after.join(known, "alert_id", "left").where(~F.col("status").eqNullSafe(F.col("_was")))
    return changed.select(
        *ALERT_SCHEMA.names,
        F.lit(run_id).alias("run_id"),
        ntz(as_of).alias("changed_at"),
        F.lit(as_of.date()).alias(PARTITION),
    )


def replay(log: DataFrame, as_of: datetime) -> DataFrame:
    """All alerts as they were at ``as_of``, changes of that moment included: the last change of each, by an aggregate."""
    last = F.max_by(F.struct(*ALERT_SCHEMA.names), "changed_at").alias("_last")
    return log.where(F.col("changed_at") <= ntz(as_of)).groupBy("alert_id").agg(last).select("_last.*")


class AlertLog:
    def __init__(self, store: TableStore) -> None:
        self.store = store

    def as_of(self, at: datetime | None = None) -> DataFrame:
        """The alerts at a time, by default now: whatever the log holds. Dates after it are not read."""
        at = at or datetime.max
        _, tables = self.store.manifest()
        if CHANGES not in tables:
            return self.store.spark.createDataFrame([], ALERT_SCHEMA)
        return replay(self.store.read(CHANGES, last=at.date()), at)

    def changes(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """The log's rows of the dates from first to last."""
        return self.store.read(CHANGES, first=first, last=last)

    def start(self, alerts: DataFrame, as_of: datetime, run_id: str = "start") -> bool:
        """Take over a snapshot as the first state of an empty log."""
        return self.run(run_id, as_of, lambda _: alerts)

    def run(self, run_id: str, as_of: datetime, cycle: Callable[[DataFrame], DataFrame]) -> bool:
        """Log what ``cycle`` (from the alerts so far to those after it) changes, and say whether it ran: a run that is in
        the log already adds nothing. Cycles come in order of time; an earlier one is refused, since later ones did not see it."""
        draft = self.store.begin()
        spark = self.store.spark
        me = spark.createDataFrame([(run_id, as_of)], "run_id string, as_of timestamp_ntz")
        before = spark.createDataFrame([], ALERT_SCHEMA)
        if RUNS in draft.tables:
            runs = draft.read(RUNS)
            newest, again = runs.agg(F.max("as_of"), F.max(F.col("run_id") == run_id)).first()
            if again:
                return False
            if as_of <= newest:
                raise ValueError(f"the log has a run of {newest}; {run_id} comes too late at {as_of}")
            me = runs.unionByName(me).coalesce(1)
            before = replay(draft.read(CHANGES), newest)
        new = changes(before, cycle(before), run_id, as_of)
        day = as_of.date()
        if CHANGES in draft.tables:
            # A date is one run of files; the day's earlier changes go with the new ones.
            new = draft.read(CHANGES, day, day).unionByName(new)
        draft.replace_dates(CHANGES, new, day, day)
        draft.overwrite(RUNS, me)
        draft.commit()
        return True


def just_before(at: datetime) -> datetime:
    return at - timedelta(microseconds=1)
