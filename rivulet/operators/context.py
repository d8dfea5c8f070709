"""Conversation history and synthesis context.

History operations work per conversation (bounded groups): windows for the
token-budget suffix, ``collect_list`` for the transcript.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.functions import fixed as X

NO_HISTORY = "No prior conversation history."
NO_SQL = "No time-series data available."
NO_NEWS = "No related macro news found."
NO_CHART = "No chart generated."


def trim_history(messages: DataFrame, budget: int = X.MAX_HISTORY_TOKENS) -> DataFrame:
    """Longest suffix whose ``floor(sum(chars) / 4)`` fits the budget, then leading turns dropped
    until the first user turn (W12, A12).
    """
    m = messages
    w_back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("_tok", F.floor(F.sum(F.length("text")).over(w_back) / 4))
    kept = m.filter(F.col("_tok") <= budget)
    first_user = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    kept = kept.withColumn("_first_user", first_user)
    return kept.filter(F.col("turn") >= F.col("_first_user")).select("conv_id", "turn", "role", "text")


def transcripts(trimmed: DataFrame, conversations: DataFrame) -> DataFrame:
    """``User: ...`` / ``Assistant: ...`` lines in turn order; a fixed text when nothing is left."""
    line = F.concat(F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant")),
                    F.lit(": "), F.col("text"))
    t = trimmed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))),
                                 lambda x: x["l"]), "\n").alias("_h"))
    return (conversations.select("conv_id").distinct().join(t, "conv_id", "left")
            .select("conv_id", F.coalesce("_h", F.lit(NO_HISTORY)).alias("history")))


def user_turns(messages: DataFrame) -> DataFrame:
    """Every user message is a request."""
    return messages.filter(F.col("role") == "user").select("conv_id", "turn", "text")


def request_history(messages: DataFrame, requests: DataFrame, budget: int = X.MAX_HISTORY_TOKENS) -> DataFrame:
    """(conv_id, turn, history): the transcript up to each request, trimmed to the budget.

    A request meets the messages whose characters, counted along the
    conversation, lie at most a budget before its own: they are in the same
    stretch of that length or in the one before, so rows meet by equality and a
    long conversation is not paired with itself.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    stretch = 4 * (budget + 1)
    m = messages.withColumn("_end", F.sum(F.length("text")).over(w)).withColumn("_begin", F.col("_end") - F.length("text"))
    m = m.withColumn("_s", F.floor(F.col("_begin") / stretch))
    ends = m.join(requests.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").select(
        "conv_id", F.col("turn").alias("_upto"), F.col("_end").alias("_all"),
        F.explode(F.array(F.floor(F.col("_end") / stretch), F.floor(F.col("_end") / stretch) - 1)).alias("_s"))
    kept = m.join(ends, ["conv_id", "_s"]).filter((F.col("turn") <= F.col("_upto")) & (F.floor((F.col("_all") - F.col("_begin")) / 4) <= budget))
    own = Window.partitionBy("conv_id", "_upto")
    kept = kept.withColumn("_first", F.min(F.when(F.col("role") == "user", F.col("turn"))).over(own)).filter(F.col("turn") >= F.col("_first"))
    line = F.concat(F.when(F.col("role") == "user", F.lit("User")).otherwise(F.lit("Assistant")), F.lit(": "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("l"))))
    text = kept.groupBy("conv_id", F.col("_upto").alias("turn")).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("_h"))
    return requests.select("conv_id", "turn").join(text, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("_h", F.lit(NO_HISTORY)).alias("history"))


def chart_status(needs_chart, ticker, mode, n_rows):
    """Chart branch outcome text (the drawing itself is not built; its data is ``chart_panel``)."""
    bad = F.coalesce(ticker, F.lit("")).isin("", X.UNKNOWN_TICKER, "NONE")
    m = F.coalesce(mode, F.lit(X.DEFAULT_CHART_MODE))
    body = (F.when(bad, F.lit("No valid ticker specified for chart generation."))
            .when(F.coalesce(n_rows, F.lit(0)) == 0,
                  F.concat(F.lit("No price data available in database to render chart for "), ticker, F.lit(".")))
            .otherwise(F.concat(F.lit("Chart data ready: "), n_rows.cast("string"), F.lit(" rows.")))
            )
    return F.when(needs_chart, F.concat(F.lit("Rendered "), m, F.lit(" chart: "), body)).otherwise(F.lit(NO_CHART))


def assemble_context(requests: DataFrame, plans: DataFrame, branches: DataFrame, sql_rows: DataFrame,
                     rag: DataFrame, history: DataFrame) -> DataFrame:
    """One synthesis context per request: scenario, question, target, data, news, chart status, history.

    ``sql_rows`` = (conv_id, turn, rows_json, n_rows); ``rag`` = (conv_id, turn, context);
    ``history`` = (conv_id, turn, history).
    Joins are left joins on the request key; a branch that did not run leaves its default text.
    """
    r = (requests.join(plans.select("conv_id", "turn", "current_target", "chat", "chart_mode", "routing_source"),
                       ["conv_id", "turn"], "left")
         .join(branches, ["conv_id", "turn"], "left")
         .join(sql_rows, ["conv_id", "turn"], "left")
         .join(rag, ["conv_id", "turn"], "left")
         .join(history, ["conv_id", "turn"], "left"))
    target = F.coalesce(F.col("current_target"), F.lit(X.UNKNOWN_TICKER))
    chat = F.coalesce(F.col("chat"), F.lit(False))
    scenario = F.when(chat, F.lit("chat")).when(target != X.UNKNOWN_TICKER, F.lit("asset")).otherwise(F.lit("macro"))
    sql_txt = F.when(F.coalesce(F.col("sql_branch"), F.lit(False)) & (F.coalesce(F.col("n_rows"), F.lit(0)) > 0),
                     F.col("rows_json")).otherwise(F.lit(NO_SQL))
    rag_txt = F.when(F.coalesce(F.col("rag_branch"), F.lit(False)), F.coalesce(F.col("context"), F.lit(NO_NEWS))) \
        .otherwise(F.lit(NO_NEWS))
    chart = chart_status(F.coalesce(F.col("needs_chart"), F.lit(False)), target, F.col("chart_mode"), F.col("n_rows"))
    return r.select("conv_id", "turn", F.col("text").alias("question"), target.alias("target"),
                    scenario.alias("scenario"), F.col("routing_source"), sql_txt.alias("sql_data"),
                    rag_txt.alias("news_context"), chart.alias("chart_status"),
                    F.coalesce(F.col("history"), F.lit(NO_HISTORY)).alias("history"))
