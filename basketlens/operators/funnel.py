"""Session funnel: each stage counts on its own, stages are not a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketlens.functions import constants as K
from basketlens.functions import scalars as S
from basketlens.operators.customers import events_per_session
from basketlens.sources.literals import ordered_domain
from basketlens.sources.tables import RetailTables


def session_flags(tables: RetailTables) -> DataFrame:
    """One row per session with 0/1 per stage; sessions without events stay, as zeros."""
    reached = events_per_session(tables.events).select(
        "session_id", *[(F.col(c) > 0).cast("int").alias(stage) for stage, c in K.STAGE_COUNT_COLUMNS.items()]
    )
    sessions = tables.sessions.select("session_id", "device", "source")
    return sessions.join(reached, "session_id", "left").fillna(0, subset=K.FUNNEL_STAGES)


def funnel_overall(flags: DataFrame) -> DataFrame:
    """Sessions per stage, in stage order."""
    totals = flags.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in K.FUNNEL_STAGES])
    rows = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("sessions")) for s in K.FUNNEL_STAGES]
    return totals.select(F.posexplode(F.array(*rows)).alias("position", "row")).select("position", "row.*")


def funnel_step_rates(flags: DataFrame) -> DataFrame:
    """Each stage as a share of the stage before it (four rows)."""
    before = F.lag("sessions").over(W.orderBy("position"))
    return (
        funnel_overall(flags)
        .withColumn("previous", before)
        .withColumn("of_previous", F.when(F.col("previous").isNotNull(), S.ratio(F.col("sessions"), F.col("previous"))))
        .drop("previous")
    )


def funnel_by(flags: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Share of sessions reaching each stage, for a closed, ordered list of values.

    Values outside the list are dropped; a listed value without sessions has nulls.
    """
    rates = flags.groupBy(column).agg(*[S.mean_of(F.col(s)).alias(s) for s in K.FUNNEL_STAGES])
    listed = ordered_domain(flags.sparkSession, column, domain)
    return listed.join(rates, column, "left").select("position", column, *K.FUNNEL_STAGES).orderBy("position")


def funnel_by_device(flags: DataFrame) -> DataFrame:
    return funnel_by(flags, "device", K.DEVICES)


def funnel_by_source(flags: DataFrame) -> DataFrame:
    return funnel_by(flags, "source", K.SOURCES)
