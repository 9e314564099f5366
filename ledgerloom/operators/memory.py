"""Conversation windows and follow-up questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import rules

Model = Callable[[list[dict]], str]
# States of an assistant turn that is no answer.
NO_ANSWER = ("no_key", "generation_error")


def usable() -> Column:
    """Whether a turn (role, content, status) may enter a history.

    All user turns but those refused for personal data; of the assistant's, those with a state that is an answer.
    """
    private = rules.pii(F.col("content")).isNotNull()
    user = (F.col("role") == "user") & ~private & ~F.coalesce(F.col("status") == "refused_pii", F.lit(False))
    return F.coalesce(user | ((F.col("role") != "user") & F.col("status").isNotNull() & ~F.col("status").isin(*NO_ANSWER)), F.lit(False))


def usable_turns(turns: DataFrame) -> DataFrame:
    """The turns that may enter a history."""
    return turns.where(usable())


def history(turns: DataFrame, last: int = EngineConfig().memory_messages) -> DataFrame:
    """``turns`` with ``history``: array<struct<role,content>> of the ``last`` usable turns before each; ties by content.

    Every turn is kept, but those that ``usable`` rules out, such as personal data, enter no history.
    """
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    # the frame reaches back by usable turns: each row's number among them bounds it
    placed = turns.withColumn("_on", usable()).withColumn("_n", F.coalesce(F.sum(F.col("_on").cast("int")).over(upto), F.lit(0)))
    turn = F.when(F.col("_on"), F.struct("role", "content"))
    recent = Window.partitionBy("conv_id").orderBy("_n").rangeBetween(-last, -1)
    return placed.withColumn("history", F.collect_list(turn).over(recent)).drop("_on", "_n")


def stands_alone(question: Column) -> Column:
    return rules.matches(question, rules.STANDALONE)


def transcript(past: Column) -> Column:
    """One line a turn; every role but the user's is the assistant's."""
    return F.array_join(F.transform(past, lambda m: F.concat(F.when(m["role"] == "user", "USER: ").otherwise("ASSISTANT: "), F.coalesce(m["content"], F.lit("")))), "\n")


def tidy_reply(original: Column, reply: Column) -> Column:
    """The reply on one line without quotes; the original if it is empty or the same."""
    bare = F.regexp_replace(F.trim(F.coalesce(reply, F.lit(""))), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    line = F.trim(F.regexp_replace(bare, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85]", " "))
    return F.when((line == "") | (F.lower(line) == F.lower(original)), original).otherwise(line)


class ModelError(RuntimeError):
    """A model gave no reply; ``reason`` is the state of the answer that it leaves."""

    def __init__(self, message: str, reason: str = "generation_error"):
        super().__init__(message)
        self.reason = reason


class NoKey(ModelError):
    """The model's access isn't set up."""

    def __init__(self, message: str = "no key is set for the model"):
        super().__init__(message, "no_key")


@dataclass(frozen=True)
class Bounds:
    """A call is tried ``attempts`` times at most; before the n-th repetition it waits ``backoff`` * 2^(n-1) seconds."""

    attempts: int = 3
    backoff: float = 1.5


def retryable(error: BaseException) -> bool:
    """Too many requests, a fault of the server, or one of the transport, which has no status."""
    status = getattr(error, "status_code", None)
    return status is None or status == 429 or status >= 500


def bounded(model: Model, bounds: Bounds = Bounds(), wait: Callable[[float], None] = time.sleep) -> Model:
    """``model`` with repetitions: after a retryable error and after an empty reply.  Raises ``ModelError`` when the attempts are
    used up or the error isn't retryable, ``NoKey`` at once."""

    def call(messages: list[dict]) -> str:
        last: BaseException | None = None
        for n in range(bounds.attempts):
            if n:
                wait(bounds.backoff * 2 ** (n - 1))
            try:
                reply = (model(messages) or "").strip()
            except ModelError:
                raise
            except Exception as error:  # noqa: BLE001 - clients raise many kinds
                last = error
                if not retryable(error):
                    break
                continue
            if reply:
                return reply
            last = ModelError("the reply is empty")
        raise ModelError(f"{type(last).__name__}: {last}") from last

    return call


def call_model(df: DataFrame, messages: str, out: str, model: Model, open_rows: str | None = None, failed: str | None = None) -> DataFrame:
    """``df`` with ``out``: the model's reply to each row's messages, null where the row isn't open or the model fails.

    With ``failed`` that column tells the failures apart: no_key or generation_error, null for none.
    """
    more = f",{failed}:string" if failed else ""
    schema = f"struct<{df.schema.simpleString()[7:-1]},{out}:string{more}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(ms) -> tuple[str | None, str | None]:
            try:
                return model([dict(m) for m in ms]), None
            except Exception as error:  # noqa: BLE001 - whatever a model raises, the other rows go on
                return None, getattr(error, "reason", "generation_error")

        for b in batches:
            on = b[open_rows].fillna(False).astype(bool) if open_rows else pd.Series(True, index=b.index)
            got = [one(m) if o and m is not None else (None, None) for m, o in zip(b[messages], on, strict=True)]
            b[out] = [g[0] for g in got]
            if failed:
                b[failed] = [g[1] for g in got]
            yield b

    return df.mapInPandas(run, schema)


def rewrite(df: DataFrame, model: Model | None, system: str = "Rewrite the follow-up question so that it stands on its own. Output only the question.") -> DataFrame:
    """``df`` (question, history) with ``rewritten``: blank or standalone questions, and those without history or model, as they are."""
    question = F.trim(F.coalesce("question", F.lit("")))
    ask = (question != "") & (F.size(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>"))) > 0) & ~stands_alone(question)
    if model is None:
        return df.withColumn("rewritten", question)
    user = F.concat(F.lit("Conversation so far (most recent last):\n\n"), transcript(F.col("history")), F.lit("\n\nFollow-up question: "), question)
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    asked = call_model(df.withColumns({"_ask": ask, "_messages": messages}), "_messages", "_reply", model, "_ask")
    return asked.withColumn("rewritten", F.when(F.col("_ask"), tidy_reply(question, F.col("_reply"))).otherwise(question)).drop("_ask", "_messages", "_reply")


def echo(messages: list[dict]) -> str:
    """A model that gives the follow-up back."""
    return messages[-1]["content"].rpartition("Follow-up question: ")[2]
