"""Finding sensitive columns: detectors, one-pass scans, evaluation against a truth set."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custodia.functions import scalars as S
from custodia.operators import relational as R
from custodia.session import cut

OBJECT = ["database_name", "schema_name", "table_name"]
KEY = [*OBJECT, "column_name"]


@dataclass(frozen=True)
class Profile:
    """How a schema is classified."""

    min_object_age_days: int = 0
    validity_days: int = 30
    auto_tag: bool = True
    classify_views: bool = True


@dataclass(frozen=True)
class Detector:
    """A category, the values that show it, and the share of them that is enough.

    ``pattern`` is searched in the value; anchor it to match whole values.
    ``name_pattern`` recognises the column by its name instead. With ``luhn`` a value
    counts only if one of its matches passes the card checksum.
    """

    category: str
    privacy: str
    pattern: str | None = None
    threshold: float = 0.05
    luhn: bool = False
    name_pattern: str | None = None
    source: str = "BUILT_IN"


# The custom card-number detector.
CARD_PAN = Detector(
    "CARD_PAN", "IDENTIFIER", "[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}", 0.05, source="CUSTOM_PAN_CLASSIFIER"
)

# Our own rules for the six built-in categories, whose originals are not public.
BUILT_IN = (
    Detector("EMAIL", "IDENTIFIER", r"^[^@ ]+@[^@ ]+[.][a-z]+$", 0.5),
    Detector("PHONE_NUMBER", "IDENTIFIER", "^[0-9]{3}-[0-9]{3}-[0-9]{4}$", 0.5),
    Detector("NATIONAL_IDENTIFIER", "IDENTIFIER", "^([0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{2}-[0-9]{7})$", 0.5),
    Detector("DATE_OF_BIRTH", "QUASI_IDENTIFIER", name_pattern="(date_of_birth|birth_date|dob)$"),
    Detector("NAME", "IDENTIFIER", name_pattern="^(first|last|full)_name$"),
    Detector("ADDRESS", "QUASI_IDENTIFIER", r"^[0-9]+ .* (St|Street|Ave|Avenue|Rd|Road)$", 0.5),
)

# Detectors for free text, where a value is a whole document. They only have to find a
# match, so the e-mail rule asks for one character before the @: an open-ended run there
# would be retried from every position of a long text without an @.
FREE_TEXT = (
    Detector("EMAIL", "IDENTIFIER", r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", 0.05),
    Detector("PHONE_NUMBER", "IDENTIFIER", r"[0-9]{3}-[0-9]{3}-[0-9]{4}", 0.05),
    Detector("IP_ADDRESS", "QUASI_IDENTIFIER", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0.05),
    Detector("CARD_NUMBER", "IDENTIFIER", r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}", 0.01, luhn=True),
)

SCAN_ROW = "column_name string, semantic_category string, privacy_category string, classifier_source string"


def hit(col: Column, detector: Detector) -> Column:
    """Whether one value shows the category; NULL values do not."""
    if detector.pattern is None:
        return F.lit(False)
    found = col.rlike(detector.pattern)
    if detector.luhn:
        matches = F.regexp_extract_all(col, F.lit(f"({detector.pattern})"), F.lit(1))
        found = found & F.exists(matches, lambda m: F.call_function("luhn_check", F.regexp_replace(m, "[- ]", F.lit(""))))
    return F.coalesce(found, F.lit(False))


def scan(df: DataFrame, detectors: Sequence[Detector], columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column and detector: values seen, values matched, share, decision.

    All pairs are measured by one aggregate over one pass. Only then, with a single row
    left, are the counters unfolded into rows and named by position.
    """
    return decide(counters(df, detectors, columns), detectors)


def counters(
    df: DataFrame, detectors: Sequence[Detector], columns: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """(by ..., column_name, ordinal_position, detector_order, values_seen, values_matched), from one pass.

    ``by`` names columns that split the rows into parts; counters of disjoint parts add up to those of the whole.
    """
    fields = [f for f in df.schema.fields if f.name not in by and (columns is None or f.name in columns)]
    measures, pairs = [], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        text = isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))
        measures.append(F.count(c).alias(f"n_{i}"))
        matched = []
        for j, d in enumerate(detectors):
            if text and d.pattern is not None:
                measures.append(F.count_if(hit(c, d)).alias(f"m_{i}_{j}"))
                matched.append(F.col(f"m_{i}_{j}"))
            else:
                matched.append(F.lit(0).cast("bigint"))
        pairs.append(F.struct(F.col(f"n_{i}").alias("seen"), F.array(*matched).alias("matched")))
    return (
        df.groupBy(*by).agg(*measures)
        .select(*by, F.posexplode(F.array(*pairs)).alias("ci", "c"))
        .select(*by, "ci", F.col("c.seen").alias("values_seen"), F.posexplode("c.matched").alias("detector_order", "values_matched"))
        .select(*by, F.get(F.lit([f.name for f in fields]), F.col("ci")).alias("column_name"), (F.col("ci") + 1).alias("ordinal_position"),
                "detector_order", "values_seen", "values_matched")
    )


def decide(counted: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """The scan result that counters lead to; other columns of ``counted`` are carried along."""

    def of_detector(values: list) -> Column:
        return F.get(F.lit(values), F.col("detector_order"))

    named = F.lit(False)
    for j, d in enumerate(detectors):
        if d.name_pattern is not None:
            named = named | ((F.col("detector_order") == j) & F.col("column_name").rlike(f"(?i){d.name_pattern}"))
    share = F.coalesce(F.col("values_matched") / F.nullif("values_seen", F.lit(0)), F.lit(0.0)).cast("double")
    enough = (F.col("share") >= of_detector([float(d.threshold) for d in detectors])) & (F.col("values_matched") > 0)
    known = ("column_name", "ordinal_position", "detector_order", "values_seen", "values_matched")
    return counted.withColumn("share", share).select(
        *[c for c in counted.columns if c not in known],
        "column_name",
        "ordinal_position",
        of_detector([d.category for d in detectors]).alias("semantic_category"),
        of_detector([d.privacy for d in detectors]).alias("privacy_category"),
        of_detector([d.source for d in detectors]).alias("classifier_source"),
        "detector_order",
        "values_seen",
        "values_matched",
        "share",
        (named | enough).alias("detected"),
    )


# ---- rescans by difference -------------------------------------------------------

#: Paths that a rescan hands to the scan as a list; more of them are chosen by a join, with the same result.
LISTED_FILES = 10_000

FILE = ["file_path", "file_modified"]


def rules_id(detectors: Sequence[Detector]) -> str:
    """A digest of the detectors; counters taken with other ones do not count any more."""
    return hashlib.md5(repr([astuple(d) for d in detectors]).encode()).hexdigest()


def rescan(
    files: DataFrame,
    stored: DataFrame | None,
    detectors: Sequence[Detector],
    as_of: datetime,
    profile: Profile | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Counters of every file of a table, of which only new, changed and expired files are read.

    ``files`` reads files, so that it has ``_metadata``; ``stored`` is what the last call returned, and
    the next content of that relation is what this one returns: one row per file, column and
    detector with ``rules_id`` and ``captured_at``. A file that is gone loses its counters. Counters
    older than the profile's validity, or of other detectors, are taken anew. With no ``stored`` all files are read.

    An empty table has no counters. Files are told apart by path and modification time.
    """
    profile = profile or Profile()
    rules = rules_id(detectors)
    path, changed_at = F.col("_metadata.file_path"), F.col("_metadata.file_modification_time")
    present = cut(files.select(path.alias("file_path"), changed_at.alias("file_modified")).distinct())
    kept = None
    due = present
    if stored is not None:
        valid = stored.filter((F.col("rules_id") == rules) & ~is_expired(profile, as_of))
        kept = valid.join(present, FILE, "left_semi")
        due = present.join(valid.select(*FILE).distinct(), FILE, "left_anti")
    due = cut(due.select("file_path"))
    listed = [r["file_path"] for r in due.limit(LISTED_FILES + 1).collect()]
    marked = files.select("*", path.alias("file_path"), changed_at.alias("file_modified"))
    part = marked.join(due, "file_path", "left_semi") if len(listed) > LISTED_FILES else marked.filter(path.isin(listed))
    fresh = counters(part, detectors, None if columns is None else list(columns), FILE).select(
        "*", F.lit(rules).alias("rules_id"), F.lit(as_of).alias("captured_at")
    )
    return fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh)


def merged(counted: DataFrame, detectors: Sequence[Detector]) -> DataFrame:
    """The scan result of the whole table from the counters of its files."""
    whole = counted.groupBy("column_name", "ordinal_position", "detector_order").agg(
        F.sum("values_seen").alias("values_seen"), F.sum("values_matched").alias("values_matched")
    )
    return decide(whole, detectors)


def is_expired(profile: Profile, as_of: datetime) -> Column:
    return F.col("captured_at") < F.lit(as_of) - F.make_interval(days=F.lit(profile.validity_days))


# ---- tables and schemas ----------------------------------------------------------


def classify_table(df: DataFrame, name: tuple[str, str, str], detectors: Sequence[Detector]) -> DataFrame:
    database, schema, table = name
    return scan(df, detectors).select(
        F.lit(database).alias("database_name"), F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"), "*"
    )


def classify_schema(tables: Mapping[tuple[str, str, str], DataFrame], detectors: Sequence[Detector]) -> DataFrame:
    """Every table of a schema; each is read once."""
    return R.union_all([classify_table(df, name, detectors) for name, df in tables.items()])


def system_tags(scanned: DataFrame, profile: Profile | None = None) -> DataFrame:
    """The detected categories as tag rows: the best-supported category of each column.

    A profile without ``auto_tag`` records what was found but sets no tags.
    """
    best = (
        scanned.filter(F.col("detected") & F.lit((profile or Profile()).auto_tag))
        .groupBy(*KEY)
        .agg(
            F.max(
                F.struct(
                    "share", (-F.col("detector_order")).alias("o"), "semantic_category", "privacy_category",
                )
            ).alias("b")
        )
    )
    tags = F.array(
        F.struct(F.lit("SEMANTIC_CATEGORY").alias("tag_name"), F.col("b.semantic_category").alias("tag_value")),
        F.struct(F.lit("PRIVACY_CATEGORY").alias("tag_name"), F.col("b.privacy_category").alias("tag_value")),
    )
    return best.select(*KEY, F.explode(tags).alias("t")).select(
        *KEY, "t.tag_name", "t.tag_value", F.lit("AUTO_CLASSIFIED").alias("apply_method")
    )


def capture_results(tags: DataFrame, as_of: datetime, custom: Mapping[str, str] | None = None) -> DataFrame:
    """Tag rows to one row per column, over all tables at once."""
    custom = {CARD_PAN.category: CARD_PAN.source} if custom is None else custom
    name = F.lower("tag_name")
    wide = (
        tags.filter(name.isin("semantic_category", "privacy_category"))
        .groupBy(*KEY)
        .agg(
            F.max(F.when(name == "semantic_category", F.col("tag_value"))).alias("semantic_category"),
            F.max(F.when(name == "privacy_category", F.col("tag_value"))).alias("privacy_category"),
            *[
                F.max(F.when((name == "semantic_category") & (F.col("tag_value") == cat), 1).otherwise(0)).alias(f"is_{cat}")
                for cat in custom
            ],
            F.max("apply_method").alias("apply_method"),
        )
    )
    source = F.lit("BUILT_IN")
    for cat, label in custom.items():
        source = F.when(F.col(f"is_{cat}") == 1, F.lit(label)).otherwise(source)
    return wide.select(
        *KEY, "semantic_category", "privacy_category", source.alias("classifier_source"), "apply_method",
        F.lit(as_of).alias("captured_at"),
    )


def expired(results: DataFrame, profile: Profile, as_of: datetime) -> DataFrame:
    """Columns whose classification is older than the profile allows."""
    return results.filter(is_expired(profile, as_of))


def in_scope(tables: DataFrame, profile: Profile, as_of: datetime) -> DataFrame:
    """Objects the profile classifies: old enough, and views only if it says so."""
    old_enough = F.col("created_on") <= F.lit(as_of) - F.make_interval(days=F.lit(profile.min_object_age_days))
    out = tables.filter(F.coalesce(old_enough, F.lit(profile.min_object_age_days == 0)))
    return out if profile.classify_views else out.filter(~F.col("object_type").contains("VIEW"))


def detected_only(results: DataFrame) -> DataFrame:
    return results.filter(F.col("semantic_category").isNotNull() | F.col("privacy_category").isNotNull())


def evaluate(universe: DataFrame, truth: DataFrame, results: DataFrame, prefix: str = "STG_") -> DataFrame:
    """TP / FP / FN / TN for every column of the universe.

    Staged tables are compared to their source's name, so the prefix is stripped once
    on each side and the joins stay equi-joins.
    """
    on = ["table_name", "column_name"]
    u = universe.select(R.strip_prefix(F.col("table_name"), prefix).alias("table_name"), "column_name")
    t = truth.select(*on, "expected_classification", "source_section", "reason", F.lit(True).alias("is_truth"))
    d = detected_only(results).select(
        R.strip_prefix(F.col("table_name"), prefix).alias("table_name"), "column_name",
        "semantic_category", "privacy_category", "classifier_source", F.lit(True).alias("is_detected"),
    )
    real = F.coalesce("is_truth", F.lit(False))
    found = F.coalesce("is_detected", F.lit(False))
    return u.join(t, on, "left").join(d, on, "left").select(
        *on, "expected_classification", "source_section", "semantic_category", "privacy_category", "classifier_source",
        real.alias("actually_sensitive"),
        found.alias("detected_sensitive"),
        F.when(real & found, "TP").when(found, "FP").when(real, "FN").otherwise("TN").alias("outcome"),
        "reason",
    )


def precision_recall(evaluation: DataFrame) -> DataFrame:
    """Counts of the four outcomes, precision and recall; NULL where undefined."""
    counts = evaluation.agg(*[F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN", "TN")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "tp", "fp", "fn", "tn", S.ratio(tp, tp + fp, 4).alias("precision"), S.ratio(tp, tp + fn, 4).alias("recall")
    )


def misses(evaluation: DataFrame) -> DataFrame:
    return evaluation.filter("outcome = 'FN'").select(
        "table_name", "column_name", "expected_classification", "source_section", "reason"
    )


def false_positives(evaluation: DataFrame) -> DataFrame:
    return evaluation.filter("outcome = 'FP'").select(
        "table_name", "column_name", "semantic_category", "privacy_category", "classifier_source"
    )
