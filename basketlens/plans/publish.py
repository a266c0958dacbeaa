"""Compute every output once and keep it.

The customer profile is stored after the summaries are joined, again with its
segments, and all outputs read those stored tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from basketlens.operators import clusters, customers, funnel, products, retention, segments, snapshot, texts, trends
from basketlens.plans.session import tune
from basketlens.plans.stage import write_stage
from basketlens.sources.files import write_records
from basketlens.sources.tables import RetailTables


def build_outputs(
    tables: RetailTables,
    *,
    lexicon: DataFrame | None = None,
    stopwords: DataFrame | None = None,
    as_of: dt.datetime | None = None,
    recency_from: str = "sessions",
    starts: int = clusters.STARTS,
) -> dict[str, DataFrame]:
    """All result tables by name.

    ``lexicon`` (token, valence) turns on the sentiment outputs, without it the
    word-list rule labels the reviews; ``stopwords`` (token) turns on keywords.
    """
    tune(tables.spark)
    profile = write_stage(
        customers.customer_profile(tables, as_of=as_of, recency_from=recency_from), "profile"
    )
    segmented = segments.add_ltv(segments.add_lifecycle(segments.add_rfm(profile)))
    segmented = write_stage(segments.add_crm(segmented), "segmented")

    clustered = clusters.assign_clusters(segmented, starts=starts)
    summary = clusters.cluster_summary(clustered.profile)
    named = clusters.persona_names(summary)
    best = clustered.choice.scores.filter("chosen").select("silhouette").scalar()
    named = write_stage(named.withColumn("silhouette_score", best), "clusters")
    full = write_stage(clusters.add_personas(clustered.profile, named), "full-profile")
    figures = clusters.persona_figures(full)

    flags = write_stage(funnel.session_flags(tables), "funnel-flags")
    geo = trends.geography(tables)
    master = write_stage(products.product_master(tables), "product-master")
    by_sessions = write_stage(retention.retention(tables, activity="sessions"), "retention-sessions")
    by_orders = write_stage(retention.retention(tables, activity="orders"), "retention-orders")
    if lexicon is None:
        labelled = texts.wordlist_sentiment(tables.reviews).select("review_id", "product_id", "score", "sentiment")
    else:
        labelled = texts.review_sentiment(tables.reviews, lexicon)
    labelled = write_stage(labelled, "review-sentiment")
    facts = write_stage(snapshot.business_snapshot(tables, full), "snapshot")
    kpis = write_stage(snapshot.kpis(tables), "kpis")
    top_five = products.top_names(tables, with_category=False, n=5).selectExpr("name as key", "units as value")

    outputs = {
        "profile": full,
        "rfm_summary": segments.rfm_summary(full),
        "lifecycle_summary": segments.lifecycle_summary(full),
        "cluster_summary": named,
        "cluster_scores": clustered.choice.scores,
        "cluster_zscores": clusters.cluster_zscores(named),
        "cluster_scatter": clusters.cluster_scatter(full),
        "persona_figures": figures,
        "persona_cards": clusters.persona_cards(figures),
        "monthly": trends.monthly_overview(tables),
        "new_user_conversion": trends.new_user_conversion(tables),
        "overall_funnel": funnel.funnel_step_rates(flags),
        "device_rates": funnel.funnel_by_device(flags),
        "source_rates": funnel.funnel_by_source(flags),
        "geo": geo,
        "demographics": trends.demographics(full),
        "age_pyramid": trends.age_pyramid(full),
        "category_monthly": products.category_monthly(tables),
        "category_performance": products.category_performance(tables),
        "top_products": products.top_products(tables),
        "product_master": master,
        "top_by_units": products.top_by_units(master),
        "top_rated": products.top_rated(master),
        "review_sentiment": labelled,
        "sentiment_by_category": products.sentiment_by_category(tables, labelled),
        "retention_sessions": retention.retention_wide(by_sessions),
        "retention_orders": retention.retention_wide(by_orders),
        "kpis": kpis,
        "kpi_cards": snapshot.kpi_cards(kpis),
        "business_snapshot": facts,
        "snapshot_lines": snapshot.snapshot_lines(facts),
        "answers": snapshot.answers(facts, snapshot.ranked(top_five)),
    }
    if stopwords is not None:
        phrases = write_stage(texts.category_phrases(tables.reviews, tables.products, stopwords), "phrases")
        outputs["category_phrases"] = phrases
        outputs["category_keywords"] = texts.category_keywords(
            tables.reviews, tables.products, stopwords, phrases=phrases
        )
    return outputs


def publish_outputs(outputs: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write each output below ``folder`` as Parquet, or as JSON records; returns the paths."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unsupported format: {fmt}")
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in outputs}
    for name, df in outputs.items():
        if fmt == "json":
            write_records(df, paths[name], mode="overwrite")
        else:
            df.write.mode("overwrite").parquet(paths[name])
    return paths
