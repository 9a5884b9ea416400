"""Conversation rows and message lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.constants import HISTORY_HEADER, HISTORY_LIMIT, HISTORY_ROLES
from foliant.operators.model import fill_template

MESSAGE = "array<struct<role:string,content:string>>"


def recent_history(turns: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The last ``limit`` messages of each conversation, and of these the user's and assistant's: turns
    of other roles use up places.  The cut is made before the shuffle."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n").where(F.col("role").isin(HISTORY_ROLES))


def format_history(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``conv_id, history``: a header line, a line for each message, a newline at the end; conversations
    without messages have the header alone."""
    lines = turns.where(F.col("role").isin(HISTORY_ROLES)).select("conv_id", "turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("_line"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "_line")))
    body = lines.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: F.concat(F.lit("\n"), r["_line"])), "").alias("_body"))
    all_ = (turns if conversations is None else conversations).select("conv_id").distinct()
    return all_.join(body, "conv_id", "left").select("conv_id", F.concat(F.lit(HISTORY_HEADER), F.coalesce("_body", F.lit("")), F.lit("\n")).alias("history"))


def history_messages(turns: DataFrame) -> DataFrame:
    """``conv_id, messages``: the turns in order as role and content."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).cast(MESSAGE).alias("messages"))


def rewrite_requests(rows: DataFrame, template: str) -> DataFrame:
    """``request`` from ``history`` and ``question`` in a template with {context} and {question}."""
    return rows.withColumn("request", fill_template(template, context=F.col("history"), question=F.col("question")))


def _message(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))).cast(MESSAGE)


def generator_messages(rows: DataFrame, system_prompt: str, tool_header: str = "Fragments found:\n", lead_in: str = "Points to cover: ") -> DataFrame:
    """``messages`` for the generator: system, history, the user's words, the contexts as a tool's answer,
    and a lead-in that lists the broader questions.  ``rows``: messages (history), user_query, context,
    broadened_question."""
    history = F.coalesce("messages", F.array().cast(MESSAGE))
    lead = F.concat(F.lit(lead_in), F.array_join("broadened_question", ", "))
    parts = [_message("system", F.lit(system_prompt)), history, _message("user", F.col("user_query")), _message("tool", F.concat(F.lit(tool_header), F.coalesce("context", F.lit("")))), _message("assistant", lead)]
    return rows.withColumn("messages", F.concat(*parts))


def judge_requests(rows: DataFrame, template: str) -> DataFrame:
    """``request`` from the list ``questions`` and the chunk's ``text``, in a template with
    {knowledge_content} and {questions}."""
    return rows.withColumn("request", fill_template(template, knowledge_content=F.col("text"), questions=F.array_join("questions", "\n")))
