"""The log's state as streams: lifetimes, the ledger and the catalog."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT

LEDGER = "session_id long, seq long, searches long, chunks long, actual_tokens long, naive_tokens long, saved_tokens long"
STATE = "totals string, pending string"
CATALOG = "session_id long, doc_id string, seq long, chunks long, loaded boolean"


def ttl_sessions(events: DataFrame, key: str, ttl_minutes: float = DEFAULT.ttl_minutes, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, begin, end, n): spans in which a key wasn't idle for longer than the time to live; late events up to `late`."""
    gap = F.session_window("ts", f"{int(ttl_minutes * 60)} seconds")
    marked = events.withWatermark("ts", late)
    return marked.groupBy(gap.alias("w"), key).agg(F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("w")


def totalled(rows: pd.DataFrame, totals: list[int]) -> tuple[pd.DataFrame, list[int]]:
    """Each search of rows, in the order of seq, with the totals from `totals` on; a clear of everything sets them to zero."""
    rows = rows.sort_values("seq")
    epoch = ((rows["op"] == "clear") & rows["doc_id"].isna()).cumsum()
    new = pd.DataFrame({"searches": 1, "chunks": rows["chunks"], "actual_tokens": rows["actual_tokens"], "naive_tokens": rows["naive_tokens"], "saved_tokens": (rows["naive_tokens"] - rows["actual_tokens"]).clip(lower=0)}, index=rows.index)
    new = new.where(rows["op"] == "search", 0).astype("int64")
    run = new.groupby(epoch).cumsum()
    run = run + pd.DataFrame([totals], columns=run.columns).iloc[[0] * len(run)].set_axis(run.index).where(epoch == 0, 0)
    found = pd.concat([rows["seq"].astype("int64"), run.astype("int64")], axis=1)[rows["op"] == "search"]
    return found, [int(x) for x in run.iloc[-1]] if len(run) else totals


def _ledger(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ordered: bool) -> Iterator[pd.DataFrame]:
    totals, pending = ([json.loads(x) for x in state.get] if state.exists else ([0] * 5, []))
    columns = ["seq", "op", "doc_id", "chunks", "actual_tokens", "naive_tokens", "at"]
    parts = [] if state.hasTimedOut else [f.assign(at=(f["ts"].astype("datetime64[ms]").astype("int64") if ordered else 0))[columns] for f in frames]
    held = pd.DataFrame(pending, columns=columns)
    rows = pd.concat([held, *parts] if len(held) else parts) if parts or len(held) else held
    due = rows["at"] <= state.getCurrentWatermarkMs() if ordered else rows["at"] >= 0
    found, totals = totalled(rows[due], totals)
    rest = rows[~due]
    state.update((json.dumps(totals), rest.to_json(orient="values")))
    if ordered and len(rest):
        state.setTimeoutTimestamp(int(rest["at"].min()) + 1)
    yield found.assign(session_id=key[0])[[c.split()[0] for c in LEDGER.split(", ")]]


def running_ledger(requests: DataFrame, late: str | None = None) -> DataFrame:
    """A stream of each search's session totals; a clear of everything sets them to zero.

    With `late` (a time, as '10 minutes'), requests wait until the watermark of
    their column ts has passed them, so that those that come late still count in
    the order of seq; the state is then five numbers and what waits, for each
    session. Without, requests count in the order of the micro-batches.
    """
    ordered = late is not None

    def run(key, frames, state):
        return _ledger(key, frames, state, ordered)

    marked = requests.withWatermark("ts", late) if ordered else requests
    return marked.groupBy("session_id").applyInPandasWithState(run, LEDGER, STATE, "append", GroupStateTimeout.EventTimeTimeout if ordered else GroupStateTimeout.NoTimeout)


def _catalog(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    docs, clears, everything = json.loads(state.get[0]) if state.exists else ({}, {}, -1)
    rows = pd.concat(list(frames))
    last = rows[(rows["op"] == "ingest") & rows["doc_id"].notna()].sort_values("seq").drop_duplicates("doc_id", keep="last")
    named = rows[(rows["op"] == "clear") & rows["doc_id"].notna()].groupby("doc_id")["seq"].max()
    full = rows[(rows["op"] == "clear") & rows["doc_id"].isna()]["seq"]
    for doc, seq, chunks in zip(last["doc_id"], last["seq"], last["chunks"], strict=True):
        docs[doc] = max(docs.get(doc, [-1, 0]), [int(seq), int(chunks)])
    for name, seq in named.items():
        clears[name] = max(clears.get(name, -1), int(seq))
    everything = max([everything, *(int(x) for x in full)])
    gone = lambda doc: max(everything, clears.get(doc, -1), clears.get(doc.split("#")[0], -1))
    out = [(key[0], doc, seq, chunks, seq > gone(doc)) for doc, (seq, chunks) in docs.items()]
    # what is cleared is told once; clears stay, as a request before them may still come
    docs = {doc: docs[doc] for _, doc, _, _, loaded in out if loaded}
    clears = {name: seq for name, seq in clears.items() if seq > everything}
    state.update((json.dumps([docs, clears, everything]),))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in CATALOG.split(", ")])


def latest_catalog(requests: DataFrame) -> DataFrame:
    """A stream of (session_id, doc_id, seq, chunks, loaded), as session.catalog() has them after the requests so far.

    For an update sink: whenever a session's requests come, all its documents
    are told with whether they are (still) loaded, and the last word on a document counts. The order in
    which requests come plays no part. The state is a session's documents and its
    clears since the last one of everything.
    """
    return requests.groupBy("session_id").applyInPandasWithState(_catalog, CATALOG, "state string", "update", GroupStateTimeout.NoTimeout)
