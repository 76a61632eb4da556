"""History of conversations that arrive as a stream of turns.

The state of a conversation is its last whole turns within a budget of characters, so it stays bounded however long the
conversation gets, and a user turn's history is there when the turn arrives. Turns of a conversation are taken in the order of
their numbers within a batch; one that is not after the last turn seen is a repeat, or late, and gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "conv_id long, turn long, question string, history string"
STATE = "last long, turns string"


def _fitting(turns: list, budget: int) -> list:
    """The last turns that fit, each counted with one character more."""
    left, at = budget, len(turns)
    while at and left >= len(turns[at - 1][1] or "") + 1:
        at -= 1
        left -= len(turns[at][1] or "") + 1
    return turns[at:]


def histories(turns: DataFrame, budget: int) -> DataFrame:
    """A stream ``turns(conv_id, turn, role, text)`` to user turns with ``history``, a JSON list of [role, text]."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = state.get if state.exists else (None, "[]")
        kept = json.loads(kept)
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text in rows[["turn", "role", "text"]].itertuples(index=False):
            if last is not None and turn <= last:
                continue
            if role == "user":
                out.append((key[0], turn, text, json.dumps(kept, ensure_ascii=False)))
            kept, last = _fitting([*kept, [role, text]], budget), int(turn)
        if last is not None:
            state.update((last, json.dumps(kept, ensure_ascii=False)))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "history"])

    known = turns.filter("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    return known.groupBy("conv_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
