"""Audit events, sessions, lockouts and rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scans import running_total
from ..functions.skew import lookup_join, newest_rows
from ..functions.times import MICROS, epoch_micros, seconds_interval
from ..session import stored

SESSION_SECONDS = 24 * 3600
LOCKOUT_SECONDS = 30 * 60
RATE_SECONDS = 15 * 60
MAX_ATTEMPTS = 5


def audit_search(
    events: DataFrame,
    start: Column,
    end: Column,
    event_type: str | None = None,
    threat_level: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """Events in a time range with optional equalities, newest first."""
    found = events.where(F.col("ts").between(start, end))
    wanted = {"event_type": event_type, "threat_level": threat_level, "user_id": user_id}
    for column, value in wanted.items():
        if value is not None:
            found = found.where(F.col(column) == value)
    return found.orderBy(F.desc("ts"))


def session_validity(
    requests: DataFrame, sessions: DataFrame, ended: DataFrame | None = None
) -> DataFrame:
    """Status of each request: unknown, ip_mismatch, expired or valid, first match wins.

    ``ended`` lists closed sessions (``session_id``, ``ended_at``); from then on a session
    is unknown.  A request without an address does not match a session that has one.  A
    session may be asked for by a large share of all requests.
    """
    if ended is None:
        sessions = sessions.withColumn("ended_at", F.lit(None).cast("timestamp_ntz"))
    else:
        first = ended.groupBy("session_id").agg(F.min("ended_at").alias("ended_at"))
        sessions = sessions.join(first, "session_id", "left")
    known = sessions.select(
        "session_id",
        F.lit(True).alias("_known"),
        F.col("ended_at").alias("_ended"),
        "user_id",
        F.col("ip_address").alias("_ip"),
        (F.col("created_at") + seconds_interval(SESSION_SECONDS)).alias("expires_at"),
    )
    joined = lookup_join(requests, known, ["session_id"], "left")
    status = (
        F.when(F.col("_known").isNull() | (F.col("ts") >= F.col("_ended")), "unknown")
        .when(~F.col("_ip").eqNullSafe(F.col("ip_address")), "ip_mismatch")
        .when(F.col("ts") > F.col("expires_at"), "expired")
        .otherwise("valid")
    )
    return joined.withColumn("status", status).drop("_ip", "_known", "_ended")


def session_violations(validity: DataFrame) -> DataFrame:
    """Audit events of requests that came from another address."""
    return validity.where(F.col("status") == "ip_mismatch").select(
        F.concat(F.lit("violation-"), F.col("request_id").cast("string")).alias("event_id"),
        "ts",
        F.lit("security_violation").alias("event_type"),
        F.lit("error").alias("threat_level"),
        "user_id",
        "session_id",
        "ip_address",
        F.lit("IP mismatch").alias("description"),
    )


def recent_failures(failures: DataFrame, checks: DataFrame, window_seconds: int) -> DataFrame:
    """For each check ``(identifier, ts, ...)`` the failures in ``(ts - window, ts]``.

    A failure counts +1 at its time and -1 when it leaves the window, so the answer is a
    running total.  Equal times merge first, and the total runs over parts of equal size,
    so neither an identifier nor a busy hour is sorted in one task.  A null identifier is
    one like any other.  Without a time a failure lies in no window and a check counts 0;
    all checks come out.
    """
    timed = failures.where(F.col("ts").isNotNull())
    entering = timed.select("identifier", "ts", F.lit(1).alias("_d"))
    leaving = timed.select(
        "identifier", (F.col("ts") + seconds_interval(window_seconds)).alias("ts"), F.lit(-1)
    )
    asked = checks.where(F.col("ts").isNotNull()).select("identifier", "ts", F.lit(0))
    steps = entering.union(leaving).union(asked).groupBy("identifier", "ts")
    changes = steps.agg(F.sum("_d").alias("_d"))
    totals = running_total(changes, ["identifier"], "ts", "_d", "failures").drop("_d")
    moment = F.struct("identifier", "ts")
    counted = checks.withColumn("_moment", moment).join(
        totals.select(moment.alias("_moment"), "failures"), "_moment", "left"
    )
    return counted.withColumn("failures", F.coalesce("failures", F.lit(0))).drop("_moment")


def lockout(
    failures: DataFrame,
    checks: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    window_seconds: int = LOCKOUT_SECONDS,
) -> DataFrame:
    """Checks with their recent failure count and whether the identifier is blocked."""
    counted = recent_failures(failures, checks, window_seconds)
    return counted.withColumn("blocked", F.col("failures") >= max_attempts)


def failed_attempt_events(
    failures: DataFrame, window_seconds: int = LOCKOUT_SECONDS
) -> DataFrame:
    """One violation event per failure, carrying the attempt count in its window.

    ``failures`` is ``(attempt_id, identifier, ts, ip_address)``.
    """
    counted = recent_failures(failures, failures, window_seconds)
    return counted.select(
        F.concat(F.lit("failed-"), F.col("attempt_id").cast("string")).alias("event_id"),
        "ts",
        F.lit("security_violation").alias("event_type"),
        F.lit("warning").alias("threat_level"),
        "ip_address",
        F.concat(F.lit("Failed attempt for "), F.coalesce("identifier", F.lit("nobody"))).alias(
            "description"
        ),
        F.to_json(F.struct(F.col("failures").alias("attempts"))).alias("metadata"),
    )


class AttemptWindow:
    """Times of the latest accepted attempts of one identifier."""

    def __init__(self, limit: int, width: int, accepted: Iterable[int] = ()):
        self.limit, self.width = limit, width
        self.accepted: deque[int] = deque(accepted, maxlen=limit)

    def earliest(self) -> int | None:
        """Time from which another attempt can pass; None when one may pass at once."""
        if len(self.accepted) < self.limit:
            return None
        return self.accepted[0] + self.width

    def accept_from(self, times: np.ndarray) -> list[int]:
        """Positions accepted in time order; refused stretches are skipped by search."""
        taken, at = [], 0
        while at < len(times):
            free = self.earliest()
            if free is not None and times[at] < free:
                at += int(np.searchsorted(times[at:], free))
                continue
            self.accepted.append(int(times[at]))
            taken.append(at)
            at += 1
        return taken


# Parts of a long identifier that one task decides one after the other in later rounds.
PARTS_AT_ONCE = 4


def _decided(
    rows: DataFrame, max_attempts: int, width: int, states: dict[int, list[int]] | None = None
) -> DataFrame:
    """Rows in order of ``_group``, identifier and time with ``allowed``.

    Every identifier begins without accepted attempts, but the first one of a group with the
    times in ``states``.  A task keeps the last ``max_attempts`` accepted times.
    """
    names = rows.columns
    identifier, us, group = names.index("identifier"), names.index("_us"), names.index("_group")
    known = states or {}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, window = None, None
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            coded = batch.column(identifier).dictionary_encode(null_encoding="encode")
            code = coded.indices.to_numpy(zero_copy_only=False)
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            times = batch.column(us).to_numpy(zero_copy_only=False)
            changes = (code[1:] != code[:-1]) | (groups[1:] != groups[:-1])
            cuts = np.concatenate(([0], np.flatnonzero(changes) + 1, [count]))
            # What is whole in this batch and no longer than the limit passes without a look.
            allowed = np.repeat(np.diff(cuts) <= max_attempts, np.diff(cuts))
            long = np.flatnonzero(np.diff(cuts) > max_attempts).tolist()
            for i in sorted({0, *long, len(cuts) - 2}):
                low, high = int(cuts[i]), int(cuts[i + 1])
                name = (int(groups[low]), batch.column(identifier)[low].as_py())
                if name != last:
                    begins = known.get(name[0], ()) if last is None or last[0] != name[0] else ()
                    window, last = AttemptWindow(max_attempts, width, begins), name
                allowed[low:high] = False
                allowed[low + np.array(window.accept_from(times[low:high]), np.int64)] = True
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(allowed)], names=[*names, "allowed"]
            )

    schema = T.StructType([*rows.schema, T.StructField("allowed", T.BooleanType())])
    return rows.mapInArrow(decide, schema)


class _Part(NamedTuple):
    """What is known of a part: its first and last identifier, first time, last accepted times."""

    first: str
    last: str
    begins: int
    accepted: list[int]


def _accepted_tails(decided: DataFrame, of: list[str], most: int) -> DataFrame:
    """The last accepted times of each ``of``, in order."""
    last = newest_rows(decided.where("allowed").select(*of, "_us"), of, [F.desc("_us")], most)
    return last.groupBy(*of).agg(F.sort_array(F.collect_list("_us")).alias("tail"))


def rate_limit(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    window_seconds: int = RATE_SECONDS,
    parts: int | None = None,
) -> DataFrame:
    """Attempts ``(identifier, ts, attempt_id, ...)`` with ``allowed``.

    An attempt passes while fewer than ``max_attempts`` accepted ones lie strictly within the
    window; refused attempts do not count.  Attempts at the same time go by ``attempt_id``;
    repeated rows are decided one by one.  A null identifier is one like any other, an
    attempt without a time is refused and counts nowhere.

    Attempts are dealt by identifier and time to parts of equal size, and every part is
    decided as if nothing had come before.  Where an identifier goes on from one part to the
    next, only its last accepted times are passed on; the stretch is decided again if they
    change anything, all such parts at once, and again if a part before ended otherwise than
    thought.  An identifier whose parts never agree is then followed through a few parts at
    a time, so that no task holds more than ``PARTS_AT_ONCE`` parts.  The driver sees a row
    a part.
    """
    width = window_seconds * MICROS
    spark = attempts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    timed = attempts.where(F.col("ts").isNotNull()).withColumn("_us", epoch_micros(F.col("ts")))
    order = ["identifier", "_us", "attempt_id"]
    placed = timed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("_part", F.spark_partition_id())
    placed = placed.withColumn("_group", F.col("_part"))
    tables = [stored(_decided(placed, max_attempts, width), "attempts")]

    # Identifiers of parts as JSON, which tells null from any text.
    name = F.to_json(F.struct("identifier"))
    ends = F.struct("_us", "attempt_id")
    spot = F.struct("identifier", ends)
    seen = tables[0].groupBy("_part").agg(F.min(spot).alias("low"), F.max(spot).alias("high"))
    seen = seen.select(
        "_part",
        F.to_json(F.struct("low.identifier")).alias("first"),
        F.to_json(F.struct("high.identifier")).alias("last"),
        F.col("low.col2._us").alias("begins"),
    )
    tails = _accepted_tails(tables[0].withColumn("last", name), ["_part", "last"], max_attempts)
    known = {
        r["_part"]: _Part(r["first"], r["last"], r["begins"], r["tail"] or [])
        for r in seen.join(tails, ["_part", "last"], "left").collect()
    }
    numbers = sorted(known)
    before = {p: q for q, p in zip(numbers, numbers[1:]) if known[q].last == known[p].first}
    used: dict[int, list[int]] = {p: [] for p in numbers}  # accepted times a part began with
    version = dict.fromkeys(numbers, 0)  # the table that decided a part's first stretch

    def state_after(p: int) -> list[int]:
        """The last accepted times when part ``p`` ends, by what is thought so far."""
        own = known[p]
        since = used[p] if own.first == own.last else []
        return [*since, *own.accepted][-max_attempts:]

    def open_parts() -> list[int]:
        """Parts that began with other times than the part before now ends with."""
        found = []
        for p, q in before.items():
            live = [t for t in state_after(q) if t + width > known[p].begins]
            if live != [t for t in used[p] if t + width > known[p].begins]:
                found.append(p)
        return found

    turn = 0
    while todo := open_parts():
        turn += 1
        groups: dict[int, list[int]] = {}
        if turn == 1:
            groups = {p: [p] for p in todo}
        else:
            taken: set[tuple[str, int]] = set()
            for p in sorted(todo):
                chain = p
                while chain in before and known[before[chain]].first == known[p].first:
                    chain = before[chain]
                if (known[p].first, chain) in taken:
                    continue  # an earlier open part of the identifier comes first
                taken.add((known[p].first, chain))
                groups[p] = run = [p]
                while len(run) < PARTS_AT_ONCE and known[run[-1]].last == known[p].first:
                    following = numbers.index(run[-1]) + 1
                    if following == len(numbers) or before.get(numbers[following]) != run[-1]:
                        break
                    run.append(numbers[following])
        states = {g: state_after(before[run[0]]) for g, run in groups.items()}
        places = {g: i for i, g in enumerate(groups)}
        members = [(p, g, places[g], known[p].first) for g, run in groups.items() for p in run]
        wanted = spark.createDataFrame(members, "_part int, _group int, _place int, _name string")
        again = tables[0].drop("_group", "allowed").join(F.broadcast(wanted), "_part")
        again = again.where(name == F.col("_name")).drop("_name")
        again = again.repartitionById(len(groups), F.col("_place")).drop("_place")
        again = again.sortWithinPartitions("_group", "_us", "attempt_id")
        columns = tables[0].drop("allowed").columns
        tables.append(stored(_decided(again.select(*columns), max_attempts, width, states), "attempts"))
        found = {r["_part"]: r["tail"] for r in _accepted_tails(tables[-1], ["_part"], max_attempts).collect()}
        for g, run in groups.items():
            state = states[g]
            for p in run:
                used[p], version[p] = state, turn
                if known[p].last == known[p].first:
                    known[p] = known[p]._replace(accepted=found.get(p, []))
                    state = state_after(p)

    # A part's first identifier by the last table that decided it, all else by the first table.
    chosen = spark.createDataFrame(
        [(p, known[p].first, v) for p, v in version.items() if v], "_part int, _name string, _turn int"
    )
    later = F.broadcast(chosen)
    mine = (tables[0]["_part"] == later["_part"]) & (name == F.col("_name"))
    whole = tables[0].join(later, mine, "left_anti")
    for number, table in enumerate(tables[1:], 1):
        own = F.broadcast(chosen.where(F.col("_turn") == number).select("_part"))
        whole = whole.unionByName(table.join(own, "_part", "left_semi"))
    untimed = attempts.where(F.col("ts").isNull()).withColumn("allowed", F.lit(False))
    return whole.select(*attempts.columns, "allowed").unionByName(untimed)
