"""Stateful and streaming operators: rate limits, error batches, circuit breakers, error rollups and windowed counts."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decide(times: list[float], recent: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Sliding-window decisions in order of time; denied requests aren't recorded."""
    out = []
    for t in times:
        recent = [x for x in recent if t - x < seconds]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def rate_limit(requests: DataFrame, limit: int = 10, seconds: float = 60.0, late: str = "0 seconds") -> DataFrame:
    """Streaming ``requests(key, ts)`` with allowed; state per key is at most ``limit`` times.

    A key's state goes once no request came for ``seconds`` of the clock and the watermark of ``ts``, ``late`` behind the newest
    request of all keys, is beyond its window; so a stream that lags behind its clock keeps it. No request is dropped as late.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            if not recent or state.getCurrentWatermarkMs() / 1000.0 >= recent[-1] + seconds:
                state.remove()
            else:
                state.setTimeoutDuration(max(1, int(seconds * 1000)))
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        allowed, recent = decide([t.timestamp() for t in rows["ts"]], recent, limit, seconds)
        state.update((recent,))
        state.setTimeoutDuration(max(1, int(seconds * 1000)))
        yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "allowed": allowed})

    x = requests.select("key", "ts").withWatermark("ts", late).groupBy("key")
    return x.applyInPandasWithState(run, "key string, ts timestamp, allowed boolean", "recent array<double>", "append", "ProcessingTimeTimeout")


def error_batches(errors: DataFrame, most: int = 10, seconds: float = 5.0) -> DataFrame:
    """Streaming ``errors(key, payload)`` in batches (key, cause, payloads): as soon as a key has ``most``, or what it has ``seconds`` after its first.

    ``cause`` is full or time. State is at most ``most - 1`` payloads a key, and none for a key that waits for nothing. Payloads of
    a key stay in the order in which they come; null ones stay.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held, since = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        now = state.getCurrentProcessingTimeMs()
        out = lambda cause, part: pd.DataFrame({"key": [key[0]], "cause": [cause], "payloads": [part]})
        if state.hasTimedOut:
            state.remove()
            yield out("time", held)
            return
        for rows in batches:
            for payload in rows["payload"]:
                since = since if held else now
                held.append(None if pd.isna(payload) else payload)
                if len(held) >= most:
                    yield out("full", held)
                    held = []
        if held:
            state.update((held, since))
            state.setTimeoutDuration(max(1, int(since + seconds * 1000) - now))
        elif state.exists:
            state.remove()

    return errors.select("key", "payload").groupBy("key").applyInPandasWithState(run, "key string, cause string, payloads array<string>", "held array<string>, since bigint", "append", "ProcessingTimeTimeout")


def rate_limit_batch(requests: DataFrame, limit: int = 10, seconds: float = 60.0) -> DataFrame:
    """The same over a batch table of ``requests(key, ts)``: sorted by key and time and read in Arrow batches, so a key of any size carries at most ``limit`` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, recent = None, []
        for rows in batches:
            allowed = []
            for key, times in itertools.groupby(zip(rows["key"], rows["ts"]), lambda r: r[0]):
                if key != at:
                    at, recent = key, []
                found, recent = decide([t.timestamp() for _, t in times], recent, limit, seconds)
                allowed += found
            yield rows.assign(allowed=allowed)

    dealt = requests.select("key", "ts").repartition("key").sortWithinPartitions("key", F.asc_nulls_last("ts"))
    return dealt.mapInPandas(run, "key string, ts timestamp, allowed boolean")


def breaker_states(calls: DataFrame, failures: int = 20, seconds: float = 60.0, probes: int = 10) -> DataFrame:
    """Streaming ``calls(key, ts, ok)`` with the state of the key's circuit breaker after each: CLOSED, OPEN or HALF_OPEN."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        at, failed, since, tried = state.get if state.exists else ("CLOSED", 0, 0.0, 0)
        rows, out = pd.concat(list(batches)).sort_values("ts"), []
        for t, ok in zip((x.timestamp() for x in rows["ts"]), rows["ok"]):
            if at == "OPEN" and t - since >= seconds:
                at, tried = "HALF_OPEN", 0
            if at == "CLOSED":
                failed = 0 if ok else failed + 1
                if failed >= failures:
                    at, since = "OPEN", t
            elif at == "HALF_OPEN":
                tried += 1
                if not ok:
                    at, since = "OPEN", t
                elif tried >= probes:
                    at, failed = "CLOSED", 0
            out.append(at)
        state.update((at, failed, since, tried))
        yield pd.DataFrame({"key": rows["key"], "ts": rows["ts"], "state": out})

    return calls.select("key", "ts", "ok").groupBy("key").applyInPandasWithState(run, "key string, ts timestamp, state string", "at string, failed int, since double, tried int", "append", "NoTimeout")


def error_counts(errors: DataFrame, window: str = "1 hour", late: str = "24 hours") -> DataFrame:
    """(start, event_type, n) of streaming or batch ``errors(ts, event_type)``; rows later than ``late`` are let go."""
    return errors.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events no further apart than ``gap``."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
