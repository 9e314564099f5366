"""Conversation history over a stream of turns, and answers by micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.memory import usable
from ledgerloom.storage import scope

OUT = "conv_id long, turn long, question string, history array<struct<role:string,content:string>>"
STATE = "turns array<bigint>, roles array<string>, contents array<string>"


def stream_history(turns: DataFrame, last: int = 10) -> DataFrame:
    """Each user turn of a stream (conv_id, turn, role, content, status) with the ``last`` usable turns before it that have come.

    What ``memory.usable`` rules out, such as personal data, never enters the state, which is that many turns, in order
    of ``turn`` also where a later micro-batch brings an earlier one.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = sorted(zip(*state.get, strict=True)) if state.exists else []
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["turn", "role", "content"], kind="stable")
        out = []
        for r in rows.itertuples():
            if r.role == "user":
                out.append((key[0], r.turn, r.content, [{"role": a, "content": b} for t, a, b in past if t < r.turn][-last:]))
            if r.on:
                past = sorted([*past, (r.turn, r.role, r.content)])[-last:]
        state.update(([t for t, _, _ in past], [a for _, a, _ in past], [b for _, _, b in past]))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "question", "history"])

    flagged = turns.select("conv_id", "turn", "role", "content", usable().alias("on"))
    return flagged.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that answers each micro-batch with the batch pipeline and appends to ``path``; a batch that runs again replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        with scope(df.sparkSession):  # tables of a batch go with it
            answer(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
