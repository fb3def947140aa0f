"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm import (
    p01_split_overlap,
    p02_natural_cuts,
    p03_near_duplicates,
    p04_shared_spans,
    p05_name_variants,
    p06_event_runs,
    p07_grouped_splits,
    p08_containers,
    p09_mixing,
    p10_personal_data,
)
from scorelake.llm.oracles import ORACLES
from scorelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Private mails never stand beside public posts.
APART = [("workshop_mail", "forum")]
#: Secret of the pseudonyms in these queries on invented texts; operators have no default.
KEY = os.environ.get("SCORELAKE_PSEUDONYM_KEY", "key of the test tables")


def over(function: Callable[..., DataFrame], *names: str) -> Query:
    """A query that applies ``function`` to whole tables."""
    return lambda spark, folder: function(*(table(spark, folder, name) for name in names))


def queries() -> dict[str, Query]:
    return {
        "p1_found": over(p01_split_overlap.found, "prepared_pieces", "score_records"),
        "p1_report": over(p01_split_overlap.report, "prepared_pieces", "score_records"),
        "p2_found": over(p02_natural_cuts.found, "prepared_pieces", "musical_events"),
        "p2_cuts": over(p02_natural_cuts.cuts, "prepared_pieces", "musical_events"),
        "p3_found": over(p03_near_duplicates.found, "prepared_pieces"),
        "p3_groups": over(p03_near_duplicates.groups, "prepared_pieces"),
        "p4_found": over(p04_shared_spans.spans, "prepared_pieces"),
        "p4_share": over(p04_shared_spans.shared_share, "prepared_pieces"),
        "p5_found": over(p05_name_variants.found, "score_records"),
        "p5_variants": over(p05_name_variants.variants, "score_records"),
        "p6_found": over(p06_event_runs.found, "musical_events"),
        "p6_collapsed": over(p06_event_runs.collapsed, "musical_events"),
        "p7_found": over(p07_grouped_splits.found, "prepared_pieces", "score_records"),
        "p7_assign": over(p07_grouped_splits.assign, "prepared_pieces"),
        "p7_report": over(p07_grouped_splits.split_report, "prepared_pieces"),
        "p7_audit": over(p07_grouped_splits.audit_columns, "prepared_pieces", "score_records"),
        "p8_containers": over(lambda documents: p08_containers.fill(documents, apart=APART), "documents"),
        "p8_summary": over(lambda documents: p08_containers.summary(documents, apart=APART), "documents"),
        "p8_audit": over(lambda documents: p08_containers.audit(documents, apart=APART), "documents"),
        "p9_mix": over(p09_mixing.mix, "documents", "mix_targets"),
        "p9_shares": over(p09_mixing.shares, "documents", "mix_targets"),
        "p9_audit": over(p09_mixing.audit, "documents", "mix_targets"),
        "p10_found": over(lambda documents: p10_personal_data.found(documents, KEY), "documents"),
        "p10_redacted": over(lambda documents: p10_personal_data.redacted(documents, KEY), "documents"),
        "p10_redacted_dates": over(lambda documents: p10_personal_data.redacted(documents, KEY, dates=True), "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
