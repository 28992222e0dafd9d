"""Acronym state over a stream of batches, keyed by session: which acronyms a session has met, and which are new in a batch.

The batch form of the same is a window (operators.mentions.first_mentions); this one is for text
that arrives piece by piece. State is one small set per session. With idle_ms an idle session's state
is dropped after that time of processing; without it, state stays, and a run over what is available ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "session_id string, batch_num int, acronym string, is_new boolean"
STATE = "known array<string>"
ACRONYM = re.compile(r"(?<!\w)[A-Z]{2,}(?!\w)")


def _step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    known = set(state.get[0]) if state.exists else set()
    rows = []
    # within one trigger a session's batches are taken in order; what comes late is judged by what is known by then
    for pdf in [pd.concat(list(batches)).sort_values("batch_num")]:
        for n, text in zip(pdf["batch_num"], pdf["content"]):
            for a in dict.fromkeys(ACRONYM.findall(text or "")):
                rows.append((key[0], n, a, a not in known))
                known.add(a)
    state.update((sorted(known),))
    if idle_ms:
        state.setTimeoutDuration(idle_ms)
    yield pd.DataFrame(rows, columns=["session_id", "batch_num", "acronym", "is_new"])


def acronym_stream(batches: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(session_id, batch_num, acronym, is_new) of a stream of (session_id, batch_num, content)."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout

    def step(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _step(key, pdfs, state, idle_ms)

    return batches.select("session_id", "batch_num", "content").groupBy("session_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)
