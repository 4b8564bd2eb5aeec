"""Answers of a resolver that come later than what the rules found, as a stream of their own.

A resolver is asked about some segments and answers when it can; its answers are a second stream. Rule candidates go on at once and never wait for it: only
the questions are joined with the answers, by a left outer join with bounds in time, whose state goes when the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An answer counts as in time up to so many seconds after the question, as late up to so many, and then never.
LIMIT, LATEST = 1.5, 60.0


def awaited(asked: DataFrame, answers: DataFrame, limit: float = LIMIT, latest: float = LATEST, late: float = LATEST) -> DataFrame:
    """session, seq, t_asked, outcome (in_time, late or never), abbrev, ch, v and t_answer of each question and answer to it.

    asked: session, seq, t_asked. answers: session, seq, t_answer, abbrev, ch, v. Both may be streams or tables; in a stream a question is never answered once the
    watermark, which is late seconds behind, has passed latest. Several answers to a question are rows each. An answer before its question, later than
    latest, or with nulls in its keys is none.
    """
    # Whole tables need no watermark.
    marked = lambda df, t: df.withWatermark(t, f"{late} seconds") if df.isStreaming else df
    q = marked(asked, "t_asked").select(F.col("session").alias("q_session"), F.col("seq").alias("q_seq"), "t_asked")
    a = marked(answers, "t_answer").select("session", "seq", "t_answer", "abbrev", "ch", "v")
    bound = F.col("t_asked") + F.expr(f"INTERVAL {int(latest * 1000)} MILLISECONDS")
    hit = (F.col("q_session") == F.col("session")) & (F.col("q_seq") == F.col("seq")) & (F.col("t_answer") >= F.col("t_asked")) & (F.col("t_answer") <= bound)
    wait = F.unix_micros("t_answer") - F.unix_micros("t_asked")
    outcome = F.when(F.col("t_answer").isNull(), "never").when(wait <= int(limit * 1_000_000), "in_time").otherwise("late")
    rows = q.join(a, hit, "left_outer")
    return rows.select(F.col("q_session").alias("session"), F.col("q_seq").alias("seq"), "t_asked", outcome.alias("outcome"), "abbrev", "ch", "v", "t_answer")


def labelled(waited: DataFrame, catalog: DataFrame) -> DataFrame:
    """session, seq, abbrev, ch, v, source (llm), late of the answers that the catalog (abbrev, ch, v) has; what it hasn't is dropped."""
    found = waited.where("outcome <> 'never'").join(catalog.select("abbrev", "ch", "v").distinct(), ["abbrev", "ch", "v"], "left_semi")
    return found.select("session", "seq", "abbrev", "ch", "v", F.lit("llm").alias("source"), (F.col("outcome") == "late").alias("late"))
