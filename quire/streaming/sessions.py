"""The chat loop as a stateful stream (E8-E12 on arriving log lines).

Session logs that arrive over time (``session_id, seq, input, response``) are
classified and their settings typed by the same column expressions as in the
batch operators (:mod:`quire.operators.replay`); only those typed, narrow rows
reach ``applyInPandasWithState``. The state store keeps, per session, whether
it has quit, the ``/clear`` epoch, the settings in force, the history length
and the latest question of the epoch. Every processed input line gives one row
with the state in force at that line, the values the batch operators give.

The message history itself is not kept; join answered questions back by
``(session_id, epoch)`` when building requests. Lines of one session must
arrive in ``seq`` order across micro-batches; within one they are sorted.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.operators.replay import DEFAULT_SETTINGS, SETTING_TYPES, classify, with_updates

_SETTINGS = ", ".join(f"{o} {t}" for o, t in SETTING_TYPES.items())
STATE_SCHEMA = f"quit boolean, epoch long, {_SETTINGS}, history_len int, last_q long"


def output_schema(session_type: T.DataType) -> str:
    return (f"session_id {session_type.simpleString()}, seq long, kind string, epoch long, "
            f"set_ok boolean, {_SETTINGS}, history_len int, sources_of long")


def _fold(defaults: dict):
    options = list(SETTING_TYPES)

    def fold(key, batches, state):
        """Running columns over the lines of one session, from its state on."""
        quit_, epoch, *values, history, last_q = state.get if state.exists else (
            False, 0, *[defaults[o] for o in options], 0, None)
        rows = pd.concat(list(batches), ignore_index=True).sort_values("seq", ignore_index=True)
        ends = rows.index[rows["kind"] == "quit"]
        rows = rows.iloc[:0] if quit_ else rows.iloc[:ends[0] + 1] if len(ends) else rows
        if not len(rows):
            return
        clear, question = rows["kind"] == "clear", rows["kind"] == "question"
        cleared = clear.cumsum()
        out = pd.DataFrame({"session_id": [key[0]] * len(rows), "seq": rows["seq"],
                            "kind": rows["kind"], "epoch": epoch + cleared,
                            "set_ok": rows["set_ok"]})
        for o, start in zip(options, values):
            # The value of the latest line that sets the option.
            at = pd.Series(rows.index.where(rows[f"has_{o}"]), index=rows.index).ffill()
            out[o] = [start if pd.isna(i) else rows[f"val_{o}"][i] for i in at]
        # Messages since the latest /clear (with those of before it, if none).
        added = 2 * (question & rows["answered"])
        upto = added.cumsum() - added + history
        out["history_len"] = upto - upto.where(clear).ffill().fillna(0).astype(int)
        asked = rows["seq"].where(question).groupby(cleared).ffill()
        out["sources_of"] = asked.where(asked.notna() | (cleared > 0), last_q).astype("Int64")
        out = out.astype({o: object for o in options}).astype({"set_ok": object})
        out = out.where(out.notna(), None)
        tail = out.iloc[-1]
        last = tail["sources_of"]
        state.update((bool(len(ends)), int(tail["epoch"]), *[tail[o] for o in options],
                      int(tail["history_len"]) + int(added.iloc[-1]),
                      None if pd.isna(last) else int(last)))
        yield out

    return fold


def replay_stream(log: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Fold a streaming session log per session with state.

    Output: one row per processed line with ``kind``, ``epoch``, ``set_ok``,
    the settings in force, ``history_len`` (messages sent with a question)
    and ``sources_of`` (the latest question of the epoch).
    """
    d = DEFAULT_SETTINGS | (defaults or {})
    typed = with_updates(classify(log)).select(
        "session_id", F.col("seq").cast("long").alias("seq"), "kind", "set_ok",
        F.col("response").isNotNull().alias("answered"),
        *[x for o in SETTING_TYPES for x in (F.col(f"_u_{o}").isNotNull().alias(f"has_{o}"),
                                             F.col(f"_u_{o}")["v"].alias(f"val_{o}"))])
    return typed.groupBy("session_id").applyInPandasWithState(
        _fold(d), output_schema(log.schema["session_id"].dataType), STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout)
