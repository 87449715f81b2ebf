"""Tag a table of English questions with the analysis each one asks for.

The rules are column expressions, so a log of any length is tagged in one
map-only pass; only the schema of the analysed dataset is needed, none of its
rows.  A question that cannot be mapped safely gets an ``error`` text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framegauge.functions.text import ColumnNames, has_any_phrase, has_any_word, normalized, spaced
from framegauge.schema import col, require

# --- fixed values: the vocabulary and the texts of the answers ---------------

AGGREGATION_PHRASES = {
    "mean": ["average", "avg", "mean"],
    "sum": ["sum", "total"],
    "median": ["median"],
    "min": ["minimum", "min"],
    "max": ["maximum", "max"],
    "count": ["count", "number"],
    "std": ["standard deviation", "std"],
}
FREQUENCY_WORDS = {
    "1h": ["hour", "hourly"],
    "1d": ["day", "daily"],
    "1w": ["week", "weekly"],
    "1mo": ["month", "monthly"],
    "1y": ["year", "yearly", "annual", "annually"],
}
REFUSED_FREQUENCY_WORDS = ["quarter", "quarterly"]
DESCENDING_WORDS = ["highest", "largest", "maximum", "top"]
ASCENDING_WORDS = ["lowest", "smallest", "minimum", "bottom"]
QUALITY_TERMS = ["data quality", "quality check", "quality report", "missing values", "duplicates"]
PROFILE_TERMS = ["profile dataset", "profile the dataset", "dataset profile", "profile the data"]
CORRELATION_TERMS = ["correlation", "correlated"]
TREND_TERMS = ["trend", "over time", "time series"]
GROUPING_TERMS = [" by ", " per ", " each ", " grouped", "group by"]
DESCRIBE_TERMS = [
    "describe",
    "descriptive statistics",
    "summary statistics",
    "statistics for",
    "distribution of",
]
TOP_GROUPS = " (?:top|bottom) [0-9]+ (.+?) groups? by "
GROUP_CLAUSE = " (?:group by|grouped by|by|per|each)( .*)$"
TOP_N = r"(?U)\b(?:top|bottom)\s+([0-9]+)\b"

EMPTY_QUESTION = "Question cannot be empty."
NO_COLUMNS = "At least one dataset column is required."
TOO_FEW_FOR_CORRELATION = "Correlation requires at least two explicitly named numeric columns."
NO_DATETIME = "Time-series analysis requires an explicitly named date/datetime column."
NO_GROUP = "Grouped analysis requires an explicitly named grouping column."
NO_METRIC = "Grouped metric analysis requires an explicitly named numeric metric."
NOTHING_TO_DESCRIBE = (
    "Descriptive statistics require at least one explicitly named numeric column."
)
CONFLICTING_AGGREGATIONS = "Conflicting aggregation operations were requested."
CONFLICTING_FREQUENCIES = "Conflicting time frequencies were requested."
CONFLICTING_SORTS = "Conflicting sort directions were requested."
REFUSED_FREQUENCY = (
    "Unsupported time frequency '{}'. Supported frequencies are hourly, daily, weekly, "
    "monthly, and yearly."
)
UNSUPPORTED = (
    "Unsupported analytical request. Supported intents: profile, quality, "
    "describe, grouped aggregation, correlation, and time-series analysis."
)
DEFAULT_COUNT = "No aggregation was specified; defaulted to count."
DEFAULT_DAILY = "No time frequency was specified; defaulted to daily (1d)."

_WORK = "__question_"


def tag_questions(
    questions: DataFrame,
    *,
    columns: Sequence[str],
    numeric_columns: Sequence[str] | None = None,
    datetime_columns: Sequence[str] | None = None,
    question_column: str = "question",
) -> DataFrame:
    """Add ``operation``, its arguments, ``assumptions`` and ``error``.

    ``numeric_columns`` and ``datetime_columns`` limit the columns a metric or
    a time axis may be taken from; ``None`` allows every column.
    """
    require(questions, [question_column])
    everything = ColumnNames(columns)
    numeric = everything if numeric_columns is None else ColumnNames(numeric_columns)
    temporal = everything if datetime_columns is None else ColumnNames(datetime_columns)

    read = _mentions(questions, question_column, everything, numeric, temporal)
    decided = _decide(read, bool(columns), numeric, temporal)
    return _answer(decided, questions.columns, everything, numeric, temporal)


def _part(name: str) -> Column:
    return F.col(_WORK + name)


def _extended(df: DataFrame, **parts: Column) -> DataFrame:
    """Add working columns that the next steps use several times."""
    return df.withColumns({_WORK + name: value for name, value in parts.items()})


def _meaning_flags(spaced_text: Column, meanings: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """One boolean per meaning: one of its phrases occurs as whole words."""
    return {f"means_{m}": has_any_word(spaced_text, phrases) for m, phrases in meanings.items()}


def _meaning(meanings: Mapping[str, Sequence[str]]) -> Column:
    return F.coalesce(*[F.when(_part(f"means_{m}"), F.lit(m)) for m in meanings])


def _number_of(meanings: Mapping[str, Sequence[str]]) -> Column:
    return reduce(lambda a, b: a + b, [_part(f"means_{m}").cast("int") for m in meanings])


def _mentions(
    questions: DataFrame,
    question_column: str,
    everything: ColumnNames,
    numeric: ColumnNames,
    temporal: ColumnNames,
) -> DataFrame:
    raw = col(question_column)
    read = _extended(questions, text=F.coalesce(normalized(raw), F.lit("")))
    text = _part("text")
    read = _extended(read, words=spaced(text))
    words = _part("words")
    read = _extended(
        read,
        outside=everything.blanked(words),
        clause=spaced(
            F.trim(
                F.coalesce(
                    F.nullif(F.regexp_extract(words, TOP_GROUPS, 1), F.lit("")),
                    F.regexp_extract(words, GROUP_CLAUSE, 1),
                )
            )
        ),
        top_n=F.when(
            has_any_word(words, ["top", "bottom"]), F.regexp_extract(F.lower(raw), TOP_N, 1)
        ),
    )
    outside = _part("outside")
    ascending, descending = has_any_word(words, ASCENDING_WORDS), has_any_word(words, DESCENDING_WORDS)
    read = _extended(
        read,
        blank=(text == "") & F.coalesce(raw.rlike(r"(?U)^[\s\x1c-\x1f]*$"), F.lit(True)),
        numeric=numeric.found_in(words),
        temporal=temporal.found_in(words),
        keys=everything.found_in(_part("clause")),
        numeric_clash=numeric.ambiguity(words),
        temporal_clash=temporal.ambiguity(words),
        any_clash=everything.ambiguity(words),
        **_meaning_flags(words, AGGREGATION_PHRASES),
        **_meaning_flags(outside, FREQUENCY_WORDS),
        refused=F.coalesce(
            *[F.when(has_any_word(outside, [w]), F.lit(w)) for w in REFUSED_FREQUENCY_WORDS]
        ),
        sort_clash=ascending & descending,
        sort=F.when(descending, F.lit("desc")).when(ascending, F.lit("asc")),
        limit=F.when(_part("top_n") != "", _part("top_n").try_cast("bigint")),
    )
    return _extended(
        read,
        candidates=F.array_except(_part("numeric"), _part("keys")),
        agg=_meaning(AGGREGATION_PHRASES),
        frequency=_meaning(FREQUENCY_WORDS),
    )


def _decide(
    read: DataFrame, has_columns: bool, numeric: ColumnNames, temporal: ColumnNames
) -> DataFrame:
    """Choose the operation and the error; the first matching rule wins."""
    text = _part("text")
    is_quality = has_any_phrase(text, QUALITY_TERMS)
    is_profile = (text == "profile") | has_any_phrase(text, PROFILE_TERMS)
    is_correlation = has_any_phrase(text, CORRELATION_TERMS)
    is_series = _part("frequency").isNotNull() | has_any_phrase(text, TREND_TERMS)
    is_grouped = _part("agg").isNotNull() & has_any_phrase(text, GROUPING_TERMS)
    is_describe = has_any_phrase(text, DESCRIBE_TERMS)

    schema_free = is_quality | is_profile
    operation = (
        F.when(is_quality, "quality")
        .when(is_profile, "profile")
        .when(is_correlation, "correlation")
        .when(is_series, "time_series")
        .when(is_grouped, "aggregate")
        .when(is_describe, "describe")
    )
    conflicting = _number_of(AGGREGATION_PHRASES) > 1
    refused = _part("refused")
    error = _first_error(
        _part("blank"), F.lit(EMPTY_QUESTION),
        F.lit(not has_columns), F.lit(NO_COLUMNS),
        schema_free, F.lit(None),
        _part("numeric_clash").isNotNull(), _part("numeric_clash"),
        _part("temporal_clash").isNotNull(), _part("temporal_clash"),
        is_correlation & (F.size(_part("numeric")) < 2), F.lit(TOO_FEW_FOR_CORRELATION),
        is_correlation, F.lit(None),
        _part("any_clash").isNotNull(), _part("any_clash"),
        refused.isNotNull(), F.replace(F.lit(REFUSED_FREQUENCY), F.lit("{}"), refused),
        _number_of(FREQUENCY_WORDS) > 1, F.lit(CONFLICTING_FREQUENCIES),
        is_series, _first_error(
            F.size(_part("temporal")) > 1, _too_many("date/datetime column", temporal.names_of(_part("temporal"))),
            F.size(_part("temporal")) == 0, F.lit(NO_DATETIME),
            F.size(_part("numeric")) > 1, _too_many("numeric metric", numeric.names_of(_part("numeric"))),
            conflicting, F.lit(CONFLICTING_AGGREGATIONS),
        ),
        conflicting, F.lit(CONFLICTING_AGGREGATIONS),
        is_grouped, _first_error(
            F.size(_part("keys")) == 0, F.lit(NO_GROUP),
            F.size(_part("candidates")) > 1, _too_many("numeric metric", numeric.names_of(_part("candidates"))),
            (_part("agg") != "count") & (F.size(_part("candidates")) == 0), F.lit(NO_METRIC),
            _part("sort_clash"), F.lit(CONFLICTING_SORTS),
        ),
        is_describe & (F.size(_part("numeric")) == 0), F.lit(NOTHING_TO_DESCRIBE),
        operation.isNull(), F.lit(UNSUPPORTED),
    )
    return _extended(read, error=error.cast("string"), chosen=operation)


def _first_error(*rules: Column) -> Column:
    """The text of the first rule that holds, null if none does."""
    pairs = list(zip(rules[0::2], rules[1::2]))
    return reduce(lambda chain, rule: chain.when(*rule), pairs[1:], F.when(*pairs[0]))


def _too_many(purpose: str, found: Column) -> Column:
    return F.concat(F.lit(f"Name exactly one {purpose}; found: "), F.array_join(found, ", "), F.lit("."))


def _answer(
    decided: DataFrame,
    kept: Sequence[str],
    everything: ColumnNames,
    numeric: ColumnNames,
    temporal: ColumnNames,
) -> DataFrame:
    def first(names: ColumnNames, part: str) -> Column:
        return names.name_of(F.get(_part(part), F.lit(0)))

    valid = _part("error").isNull()
    chosen = F.when(valid, _part("chosen"))
    none = F.array().cast("array<string>")
    series, grouped = chosen == "time_series", chosen == "aggregate"
    assumed = F.concat(
        F.when(_part("agg").isNull(), F.array(F.lit(DEFAULT_COUNT))).otherwise(none),
        F.when(_part("frequency").isNull(), F.array(F.lit(DEFAULT_DAILY))).otherwise(none),
    )
    return decided.select(
        *[col(c) for c in kept],
        chosen.alias("operation"),
        F.when(chosen.isin("correlation", "describe"), numeric.names_of(_part("numeric")))
        .otherwise(none)
        .alias("columns"),
        F.when(grouped, everything.names_of(_part("keys"))).otherwise(none).alias("group_by"),
        F.when(series, first(numeric, "numeric"))
        .when(grouped, first(numeric, "candidates"))
        .alias("metric"),
        F.when(series, F.coalesce(_part("agg"), F.lit("count"))).when(grouped, _part("agg")).alias("agg"),
        F.when(series, first(temporal, "temporal")).alias("datetime_column"),
        F.when(series, F.coalesce(_part("frequency"), F.lit("1d"))).alias("frequency"),
        F.when(grouped, _part("sort")).alias("sort_direction"),
        F.when(grouped, _part("limit")).alias("limit"),
        F.when(series, assumed).otherwise(none).alias("assumptions"),
        _part("error").alias("error"),
    )
