"""Further resolvers of references: when they are asked, what they may say, and the default that says nothing."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.detect import TRIGGERS

CANDIDATE = "key long, abbrev string, ch int, v int"


class RefResolver(Protocol):
    def resolve(self, segments: DataFrame, context: DataFrame | None, rule_candidates: DataFrame) -> DataFrame:
        """Candidates (CANDIDATE) for segments (key, text)."""


class NullResolver:
    """Says nothing."""

    def resolve(self, segments: DataFrame, context: DataFrame | None, rule_candidates: DataFrame) -> DataFrame:
        return segments.sparkSession.createDataFrame([], CANDIDATE)


def asked(segments: DataFrame, rule_candidates: DataFrame) -> DataFrame:
    """The segments (key, text) that a resolver is asked about: those with a trigger in which the rules found nothing, or several references."""
    found = rule_candidates.groupBy("key").agg(F.count_distinct(F.struct("abbrev", F.coalesce("ch", F.lit(0)).alias("ch"), F.coalesce("v", F.lit(0)).alias("v"))).alias("__n"))
    some = segments.where(F.col("text").rlike(f"(?i)(?:{TRIGGERS})"))
    return some.join(found, "key", "left").where("coalesce(__n, 0) <> 1").drop("__n")


def answered(resolver: RefResolver, segments: DataFrame, rule_candidates: DataFrame, catalog: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """key, abbrev, ch, v, source (rule or llm): the rules' candidates and what the resolver adds; what the catalog hasn't is dropped.

    Rules don't wait for a resolver: its candidates are a table of their own until this union, and come in late where it is streamed.
    """
    more = resolver.resolve(asked(segments, rule_candidates), context, rule_candidates)
    valid = more.join(catalog.select("abbrev", "ch", "v").distinct(), ["abbrev", "ch", "v"], "left_semi")
    both = rule_candidates.select("key", "abbrev", "ch", "v", F.lit("rule").alias("source")).unionByName(valid.select("key", "abbrev", "ch", "v", F.lit("llm").alias("source")))
    return both.groupBy("key", "abbrev", "ch", "v").agg(F.max("source").alias("source"))
