"""Message routing over a table of messages.

Clauses and the fixed prototype utterances are encoded alike: hashed words and
character pairs, weighted by how rare they are in both together.  An intent's
centroid is the mean of its prototypes' unit vectors at unit length.  Rarities
and centroids have at most one row per bucket, whatever the number of
messages, and are broadcast; clauses are scored by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.functions import fixed as X
from rivulet.functions.text import chart_mode, extract_ticker, guard_status, split_clauses, wants_chart
from rivulet.operators.embedding import NGRAM_DIM, gram_counts, rarity, unit_weights
from rivulet.session import cut_lineage

INTENTS = list(X.INTENT_UTTERANCES)          # dict order: ties go to the earlier intent
INTENT_IDX = {name: i for i, name in enumerate(INTENTS)}
FAST_PATH = "SEMANTIC_VECTOR_FAST_PATH"
UNROUTED = "UNROUTED"


def utterances(spark: SparkSession) -> DataFrame:
    rows = [(INTENT_IDX[k], k, u) for k, us in X.INTENT_UTTERANCES.items() for u in us]
    return spark.createDataFrame(rows, "intent_id long, intent string, text string")


def message_features(messages: DataFrame, word_boundaries: bool = True) -> DataFrame:
    """Ticker, clauses and chart mode of every message."""
    return messages.select(
        "conv_id", "turn", "role", "text",
        extract_ticker(F.col("text")).alias("ticker"),
        split_clauses(F.col("text"), word_boundaries).alias("clauses"),
        chart_mode(F.col("text")).alias("chart_mode"),
    )


def clause_scores(feats: DataFrame, dim: int = NGRAM_DIM) -> DataFrame:
    """(conv_id, turn, clause_idx, scores array<double> in intent order) per clause."""
    spark = feats.sparkSession
    key = ["conv_id", "turn", "clause_idx"]
    clauses = feats.select("conv_id", "turn", F.posexplode("clauses").alias("clause_idx", "clause"))
    counts = cut_lineage(gram_counts(clauses, key, "clause", dim))
    own = utterances(spark).withColumn("uid", F.col("text"))
    proto = gram_counts(own, ["uid", "intent_id"], "text", dim)
    idf = cut_lineage(rarity([counts, proto], clauses.count() + own.count()))
    members = {i: len(X.INTENT_UTTERANCES[n]) for n, i in INTENT_IDX.items()}
    size = F.element_at(F.array(*[F.lit(float(members[i])) for i in range(len(INTENTS))]), (F.col("intent_id") + 1).cast("int"))
    mean = unit_weights(proto, idf, ["uid", "intent_id"]).groupBy("intent_id", "d").agg(F.sum("v").alias("m")).withColumn("m", F.col("m") / size)
    norm = mean.groupBy("intent_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("_n"))
    unit = mean.join(norm, "intent_id").withColumn("m", F.col("m") / F.col("_n"))
    cents = unit.groupBy("d").agg(*[F.sum(F.when(F.col("intent_id") == i, F.col("m")).otherwise(0.0)).alias(f"c{i}") for i in range(len(INTENTS))])
    cents = F.broadcast(cut_lineage(cents))  # at most dim rows
    scored = unit_weights(counts, idf, key).join(cents, "d").groupBy(*key).agg(
        F.array(*[F.sum(F.col("v") * F.col(f"c{i}")) for i in range(len(INTENTS))]).alias("scores"))
    none = F.array(*[F.lit(0.0)] * len(INTENTS))
    return clauses.select(*key).join(scored, key, "left").select(*key, F.coalesce("scores", none).alias("scores"))


def route(feats: DataFrame, scores: DataFrame, threshold: float = X.ROUTER_THRESHOLD) -> DataFrame:
    """Multi-label route plan per message (R13, A5, A6, D3); unsettled messages get ``UNROUTED``."""
    names = F.array(*[F.lit(n) for n in INTENTS])
    chat_i, price_i, news_i = INTENT_IDX["CHITCHAT"], INTENT_IDX["FETCH_PRICE"], INTENT_IDX["FETCH_NEWS"]
    s = scores.withColumn("best_score", F.array_max("scores"))
    s = s.withColumn("best_i", F.array_position("scores", F.col("best_score")) - 1)   # first maximum
    idx = F.sequence(F.lit(0), F.lit(len(INTENTS) - 1))
    floor = F.greatest(F.lit(threshold), F.col("best_score") - F.lit(X.SECONDARY_MARGIN))
    picked = F.filter(idx, lambda i: ((i == F.col("best_i")) & (F.col("best_score") >= threshold)) |
                      ((i != F.col("best_i")) & (i != chat_i) & (F.element_at("scores", i + 1) >= floor)))
    s = s.select("conv_id", "turn", "best_score", F.transform(picked, lambda i: F.element_at(names, i + 1))
                 .alias("picked"),
                 (F.element_at("scores", chat_i + 1) >=
                  F.greatest(F.element_at("scores", price_i + 1), F.element_at("scores", news_i + 1))).alias("chatty"))
    agg = s.groupBy("conv_id", "turn").agg(
        F.array_distinct(F.flatten(F.collect_list("picked"))).alias("detected"),
        F.greatest(F.lit(0.0), F.max("best_score")).alias("max_score"),
        F.max(F.col("chatty").cast("int")).alias("any_chatty"))
    m = feats.join(agg, ["conv_id", "turn"])
    det = F.col("detected")
    has_chat = F.array_contains(det, "CHITCHAT")
    isolate = has_chat & (F.col("ticker") == X.UNKNOWN_TICKER) & (F.col("any_chatty") == 1)
    det2 = (F.when(isolate, F.array(F.lit("CHITCHAT")))
            .when(has_chat & (F.size(det) > 1), F.array_remove(det, "CHITCHAT")).otherwise(det))
    m = m.withColumn("det2", det2)
    is_chat = (F.size("det2") == 1) & F.array_contains("det2", "CHITCHAT")
    has_chart = F.array_contains("det2", "RENDER_CHART")
    mode = F.when(has_chart, F.col("chart_mode"))
    needs_data = has_chart & ~F.arrays_overlap("det2", F.array(F.lit("FETCH_PRICE"), F.lit("FETCH_INDICATOR")))
    extra = F.when(mode.isin("rsi", "macd", "price_sma"), F.lit("FETCH_INDICATOR")).otherwise(F.lit("FETCH_PRICE"))
    final = F.array_sort(F.when(needs_data, F.array_union("det2", F.array(extra))).otherwise(F.col("det2")))
    routed = (F.size("detected") > 0) & (F.col("max_score") >= threshold - X.FALLBACK_MARGIN)
    return m.select(
        "conv_id", "turn", "text", F.col("ticker").alias("current_target"),
        F.when(routed, final).alias("activated_intents"),
        F.when(routed, mode).alias("chart_mode"),
        (routed & is_chat).alias("chat"),
        F.when(routed, F.when(is_chat, F.lit("FINAL_ANALYST")).otherwise(F.lit("PARALLEL_EXECUTE"))).alias("next_worker"),
        F.when(routed, F.lit(FAST_PATH)).otherwise(F.lit(UNROUTED)).alias("routing_source"),
        F.col("max_score"))


def route_messages(messages: DataFrame, threshold: float = X.ROUTER_THRESHOLD, dim: int = NGRAM_DIM) -> DataFrame:
    """Guard-passed user messages routed to intents."""
    users = messages.filter((F.col("role") == "user") & (guard_status(F.col("text")) == "SAFE"))
    feats = message_features(users)
    return route(feats, clause_scores(feats, dim), threshold)


def guard_messages(messages: DataFrame) -> DataFrame:
    """Security status per user message; blocked ones go to quarantine and no branch."""
    return messages.filter(F.col("role") == "user").select(
        "conv_id", "turn", "text", guard_status(F.col("text")).alias("security_status"))


def route_branches(plans: DataFrame) -> DataFrame:
    """Branches each routed message triggers (P15) and whether a chart is needed.

    Messages the fast path cannot settle have no intents, which sends them to
    both data branches.
    """
    intents = F.coalesce(F.col("activated_intents"), F.array().cast("array<string>"))
    none = F.size(intents) == 0
    direct = F.coalesce(F.col("chat"), F.lit(False))
    sql = ~direct & (none | F.arrays_overlap(intents, F.array(*[F.lit(x) for x in
                                                                ("FETCH_PRICE", "FETCH_INDICATOR", "RENDER_CHART")])))
    rag = ~direct & (none | F.array_contains(intents, "FETCH_NEWS"))
    needs_chart = F.array_contains(intents, "RENDER_CHART") | wants_chart(F.col("text"))
    return plans.select("conv_id", "turn", sql.alias("sql_branch"), rag.alias("rag_branch"),
                        (direct | (~sql & ~rag)).alias("direct_branch"), needs_chart.alias("needs_chart"))
