"""Per-key rate gate: streaming state, and an exact batch twin for hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .groups import OrderedRows

REASONS = ("allowed", "disallowed_by_robots", "crawl_delay")


def _walk(ts: np.ndarray, robots: np.ndarray, delay: np.ndarray, last: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(allowed, earliest time or nan, last allowed) for one key's requests in order.

    Times are microseconds; ``last`` is -inf before the first allowed request.
    """
    allowed = np.zeros(len(ts), dtype=bool)
    until = np.full(len(ts), np.nan)
    if len(ts) and (delay == delay[0]).all():
        # One jump for each allowed request: everything before its delay has passed is late.
        open_at, i = np.flatnonzero(robots), 0
        while True:
            j = int(np.searchsorted(ts, last + delay[0], side="left"))
            until[i:j] = last + delay[0]
            k = int(np.searchsorted(open_at, max(i, j), side="left"))
            if k == len(open_at):
                return allowed, until, last
            i = int(open_at[k])
            allowed[i], last, i = True, float(ts[i]), i + 1
    for i in range(len(ts)):  # delays that differ from request to request
        nxt = last + delay[i]
        if ts[i] < nxt:
            until[i] = nxt
        elif robots[i]:
            allowed[i] = True
            last = float(ts[i])
    return allowed, until, last


def _micros(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy().astype(np.float64)


def _gated(ordered: pd.DataFrame, last: float) -> tuple[np.ndarray, np.ndarray, float]:
    return _walk(_micros(ordered["ts"]), ordered["robots_ok"].to_numpy(), ordered["delay"].to_numpy() * 1e6, last)


def _told(pdf: pd.DataFrame, domain, allowed: np.ndarray, until: np.ndarray) -> pd.DataFrame:
    """Rows in order with their verdicts in words."""
    late = ~np.isnan(until)
    reason = np.where(late, REASONS[2], np.where(pdf["robots_ok"].to_numpy(), REASONS[0], REASONS[1]))
    stamp = pd.Series(pd.NaT, index=pdf.index, dtype="datetime64[us]")
    if late.any():
        stamp[late] = pd.to_datetime(until[late].astype("int64"), unit="us")
    return pd.DataFrame(
        {
            "domain": domain, "seq": pdf["seq"], "ts": pdf["ts"],
            "allowed": allowed, "reason": reason, "restricted_until": stamp,
        }
    )


def _verdict(pdf: pd.DataFrame, last: float) -> tuple[pd.DataFrame, float]:
    pdf = pdf.sort_values(["ts", "seq"], kind="stable")
    allowed, until, last = _gated(pdf, last)
    return _told(pdf, pdf["domain"], allowed, until), last


_OUT = (
    "domain string, seq bigint, ts timestamp_ntz, allowed boolean, reason string, "
    "restricted_until timestamp_ntz"
)
_IN = ("domain", "seq", "ts", "robots_ok", "delay")


def _requests(df: DataFrame, key: str, ts: str, seq: str, delay, robots: str | None) -> DataFrame:
    wait = F.col(delay) if isinstance(delay, str) else F.lit(float(delay))
    return df.select(
        F.col(key).cast("string").alias("domain"),
        F.col(seq).cast("bigint").alias("seq"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        (F.coalesce(F.col(robots), F.lit(True)) if robots else F.lit(True)).alias("robots_ok"),
        wait.cast("double").alias("delay"),
    )


class _Gate(StatefulProcessor):
    """Keeps the time of the last allowed request per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_allowed", "us double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ordered = OrderedRows(rows, ("robots_ok", "delay"))
        state = self.last.get()
        allowed, until, last = _gated(ordered.numbers, -np.inf if state is None else state[0])
        if np.isfinite(last):
            self.last.update((last,))
        for cut, piece in ordered.pieces():
            yield _told(piece, key[0], allowed[cut], until[cut])

    def close(self) -> None:
        pass


def rate_gate(
    stream: DataFrame, key: str, ts: str, seq: str, delay: float | str, robots: str | None = None
) -> DataFrame:
    """Allow a request once ``delay`` seconds have passed since the last allowed one.

    Only allowed requests move the clock; a robots refusal never does, and a
    request inside the delay reads ``crawl_delay`` whatever robots say.  Needs
    the RocksDB state store.
    """
    return (
        _requests(stream, key, ts, seq, delay, robots)
        .groupBy("domain")
        .transformWithStateInPandas(
            statefulProcessor=_Gate(), outputStructType=_OUT, outputMode="append", timeMode="none"
        )
    )


def rate_gate_batch(
    df: DataFrame,
    key: str,
    ts: str,
    seq: str,
    delay: float | str,
    robots: str | None = None,
    chunk_seconds: int = 86_400,
) -> DataFrame:
    """The same verdicts for a table, with a hot key spread over time chunks.

    What enters a chunk matters only through the first request it lets pass,
    which lies within ``delay`` of the chunk's start.  So each chunk first tells,
    for each such request (and for "nothing in the way"), when it would end;
    a short pass over these tables fixes every chunk's start; then all chunks are
    gated at once.  ``delay`` is a number or a column that is constant for each key;
    chunks are made as long as the longest delay.
    """
    if isinstance(delay, str):
        spread = (
            df.groupBy(key)
            .agg(F.min(delay).alias("lo"), F.max(delay).alias("hi"), F.count_if(F.col(delay).isNull()).alias("none"))
            .agg(F.max("hi").alias("most"), F.count_if((F.col("lo") < F.col("hi")) | (F.col("none") > 0)).alias("mixed"))
            .first()
        )
        if spread["mixed"]:
            raise ValueError(f"{delay} must be one number for each {key}")
        longest = float(spread["most"] or 0.0)
    else:
        longest = float(delay)
    chunk_seconds = max(chunk_seconds, int(np.ceil(longest)))
    since = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = _requests(df, key, ts, seq, delay, robots).withColumn(
        "chunk", F.floor(since / F.lit(chunk_seconds))
    )

    span = float(chunk_seconds) * 1e6

    def exits(k, pdf: pd.DataFrame) -> pd.DataFrame:
        """(first request let in, last allowed at the end) for each possible start."""
        wait = float(pdf["delay"].iloc[0]) * 1e6
        pdf = pdf[pdf["robots_ok"]].sort_values(["ts", "seq"], kind="stable")
        t = _micros(pdf["ts"])
        if len(t) == 0:
            return pd.DataFrame({"domain": [k[0]], "chunk": [k[1]], "wait": [wait], "enter": [np.nan], "leave": [np.nan]})
        t = np.unique(t)
        nxt = np.searchsorted(t, t + wait, side="left")
        leave = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                leave[i] = leave[nxt[i]]
        begin = float(k[1]) * span
        n = max(1, int(np.searchsorted(t, begin + wait, side="right")) + 1)
        enter, leave = t[:n], leave[:n]
        # Starts that end alike fold into the latest of them.
        keep = np.append(leave[1:] != leave[:-1], True)
        return pd.DataFrame({"domain": k[0], "chunk": k[1], "wait": wait, "enter": enter[keep], "leave": leave[keep]})

    table = rows.groupBy("domain", "chunk").applyInPandas(
        exits, "domain string, chunk bigint, wait double, enter double, leave double"
    )

    def chain(k, pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = -np.inf, []
        for c, part in pdf.sort_values(["chunk", "enter"]).groupby("chunk", sort=True):
            out.append((k[0], c, last))
            wait = float(part["wait"].iloc[0])
            part = part.dropna()
            enter = part["enter"].to_numpy()
            at = int(np.searchsorted(enter, last + wait, side="left"))
            if at < len(enter):
                last = float(part["leave"].to_numpy()[at])
        return pd.DataFrame(out, columns=["domain", "chunk", "last"])

    starts = table.groupBy("domain").applyInPandas(chain, "domain string, chunk bigint, last double")

    def gate(k, pdf: pd.DataFrame) -> pd.DataFrame:
        return _verdict(pdf.drop(columns=["last"]), float(pdf["last"].iloc[0]))[0]

    return (
        rows.join(starts, ["domain", "chunk"])
        .groupBy("domain", "chunk")
        .applyInPandas(gate, _OUT)
    )
