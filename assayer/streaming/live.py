"""Following an audit in progress: listings of its files come as a stream, state is kept by name, id or session."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds between looks, looks between full rereads, looks between samples of the usage, rows a view shows.
POLL, RESCAN, SAMPLE, SHOWN = 3, 10, 5, 6
LISTING = "tick long, name string, size long, text string"


def _parsed(text: str | None) -> list[dict] | None:
    """The rows of a ledger, or None if the text is no whole JSON of that shape."""
    try:
        rows = json.loads(text or "")["entries"]
        return rows if isinstance(rows, list) and all(isinstance(r, dict) for r in rows) else None
    except (ValueError, TypeError, KeyError):
        return None


def ledger_rows(listing: DataFrame) -> DataFrame:
    """(name, tick, rows, reread) for each look (LISTING) at a file: how many rows of the ledger are known.

    A file is read again when its size has changed, and every RESCAN looks; a text that is half written keeps the rows that
    were known before. A look without a size means that the file is gone, and its state goes. Looks of a batch are taken in
    their order; repeated ones change nothing. State is one small record a name.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, rows, looks = state.get if state.exists else (-1, 0, 0)
        out = []
        for look in pd.concat(list(batches)).sort_values("tick").itertuples():
            if pd.isna(look.size_):
                size, rows, looks = -1, 0, 0
                out.append((key[0], look.tick, 0, False))
                continue
            reread = look.size_ != size or looks % RESCAN == 0
            if reread and (known := _parsed(look.text)) is not None:
                rows = len(known)
            size, looks = int(look.size_), looks + 1
            out.append((key[0], look.tick, rows, reread))
        if size < 0:
            state.remove()
        else:
            state.update((size, rows, looks))
        yield pd.DataFrame(out, columns=["name", "tick", "rows", "reread"])

    named = listing.withColumnRenamed("size", "size_").where("name IS NOT NULL AND tick IS NOT NULL")
    return named.groupBy("name").applyInPandasWithState(step, "name string, tick long, rows int, reread boolean", "size long, rows int, looks int", "append", GroupStateTimeout.NoTimeout)


def changes(listing: DataFrame) -> DataFrame:
    """(name, tick, size) of the looks at which a file differs from the look before; the first look is the baseline and no change."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for look in pd.concat(list(batches)).sort_values("tick").itertuples():
            size = -1 if pd.isna(look.size_) else int(look.size_)
            if last is not None and size != last:
                out.append((key[0], look.tick, size))
            last = size
        state.update((last,))
        yield pd.DataFrame(out, columns=["name", "tick", "size"])

    named = listing.withColumnRenamed("size", "size_").where("name IS NOT NULL AND tick IS NOT NULL")
    return named.groupBy("name").applyInPandasWithState(step, "name string, tick long, size long", "size long", "append", GroupStateTimeout.NoTimeout)


def sessions(events: DataFrame) -> DataFrame:
    """(session, tick, outcome) of a session's events (session, tick, event): a start marks it, a check holds if it is marked, an end takes the mark away."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marked = state.get[0] if state.exists else False
        out = []
        for e in pd.concat(list(batches)).sort_values("tick").itertuples():
            if e.event == "start":
                marked, outcome = True, "marked"
            elif e.event == "check":
                outcome = "guarded" if marked else "free"
            elif e.event == "end":
                marked, outcome = False, "ended" if marked else "free"
            else:
                outcome = "ignored"
            out.append((key[0], e.tick, outcome))
        if marked:
            state.update((marked,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "tick", "outcome"])

    return events.groupBy("session").applyInPandasWithState(step, "session string, tick long, outcome string", "marked boolean", "append", GroupStateTimeout.NoTimeout)


def phase(has: Callable[[str], Column], raw: Column, found: Column) -> Column:
    """The phase of an audit by the files it has written and by how many of its findings are still raw."""
    return (
        F.when(has("report.html"), "Done").when(has("test-quality.md"), "Report").when(~has("recon.md") & has("prepass.md"), "Recon").when(~has("recon.md"), "Pre-pass")
        .when(raw == found, "Audit").when(raw > 0, "Verification").otherwise("Test quality")
    )


def announce(findings: DataFrame, said: Callable[[DataFrame, int], Any], checkpoint: str, usage: Callable[[int], Any] | None = None, once: bool = False) -> StreamingQuery:
    """Calls said with the findings (id, ...) that are new, each id once over all batches, SHOWN or more alike.

    What the first batch holds was there before and is not announced. usage is called at every SAMPLE-th batch. The query
    looks every POLL seconds, or once at all there is; said has to read all rows it gets. The query's state lies below checkpoint, so that a restart announces nothing again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        if number:
            said(rows, number)
        else:
            rows.write.format("noop").mode("overwrite").save()  # the ids are known from now on
        if usage is not None and number % SAMPLE == 0:
            usage(number)

    writer = findings.dropDuplicates(["id"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{POLL} seconds")).start()
