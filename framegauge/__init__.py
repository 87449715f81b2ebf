"""Spark-native analysis of any flat dataset."""

from framegauge.operators.correlation import correlation, correlation_pairs
from framegauge.operators.describe import describe, describe_numeric
from framegauge.operators.distinct import distinct_counts, duplicate_row_count
from framegauge.operators.grouping import aggregate, grouped_summary, top_groups, value_counts
from framegauge.operators.profile import profile_columns, profile_summary, profile_table
from framegauge.operators.quality import (
    completeness,
    iqr_outliers,
    null_counts,
    quality_checks,
    quality_findings,
    quality_table,
)
from framegauge.operators.timeseries import time_series
from framegauge.plans.questions import tag_questions
from framegauge.plans.requests import AnalysisRequest, run_request
from framegauge.plans.sql import query_dataset, query_parquet
from framegauge.session import build_session
from framegauge.sinks.results import append_trace, json_rows, with_trace, write_json
from framegauge.sources import dataset_schema, load_dataset

__all__ = [
    "AnalysisRequest",
    "aggregate",
    "append_trace",
    "build_session",
    "completeness",
    "correlation",
    "correlation_pairs",
    "dataset_schema",
    "describe",
    "describe_numeric",
    "distinct_counts",
    "duplicate_row_count",
    "grouped_summary",
    "iqr_outliers",
    "json_rows",
    "load_dataset",
    "null_counts",
    "profile_columns",
    "profile_summary",
    "profile_table",
    "quality_checks",
    "quality_findings",
    "quality_table",
    "query_dataset",
    "query_parquet",
    "run_request",
    "tag_questions",
    "time_series",
    "top_groups",
    "value_counts",
    "with_trace",
    "write_json",
]
