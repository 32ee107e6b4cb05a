"""Questions a catalog reader asks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import predicates as P
from custodia.functions import scalars as S
from custodia.operators import certify as C
from custodia.operators import lineage as L
from custodia.operators import graph
from custodia.operators.classify import OBJECT
from custodia.session import cut


#: Length of the indexed pieces of names and descriptions; shorter search texts are looked for in the rows themselves.
GRAM = 3
SEARCHED = ("table_name", "column_name", "description")


@dataclass(frozen=True)
class SearchIndex:
    """A catalog with a number for each row, and (gram, row) postings stored by gram."""

    rows: DataFrame
    postings: DataFrame


def _grams(text: Column) -> Column:
    last = F.length(text) - GRAM + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.substring(text, at, F.lit(GRAM)))


def build_index(catalog: DataFrame) -> SearchIndex:
    """Inverted index over the pieces of three characters of every searched text, in lower case.

    A row has each gram once, whichever of its texts holds it; pieces never span two texts.
    Postings are sorted by gram within their files and the grams asked for are pushed into the
    scan, so a search skips the row groups that hold none of them.
    """
    rows = cut(catalog.withColumn("row_id", F.monotonically_increasing_id()))  # written, so rows and postings agree on the numbers
    pieces = [_grams(F.lower(F.coalesce(F.col(name), F.lit("")))) for name in SEARCHED]
    grams = rows.select("row_id", F.explode(F.array_distinct(F.concat(*pieces))).alias("gram"))
    return SearchIndex(rows, graph.bucketed(grams, "gram", graph.default_buckets(catalog.sparkSession))[0])


def candidates(index: SearchIndex, text: str) -> DataFrame:
    """Numbers of the rows that have all grams of the text. Reads the postings of these grams only."""
    low = text.lower()
    grams = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
    asked = index.postings.filter(F.col("gram").isin(grams))
    return asked.groupBy("row_id").agg(F.count(F.lit(1)).alias("grams")).filter(F.col("grams") == len(grams)).select("row_id")


def search_index(
    index: SearchIndex, text: str = "", database: str | None = None, schema: str | None = None, cde_only: bool = False
) -> DataFrame:
    """What ``search`` finds, by the index: rows with all grams of the text, whose texts are then compared.

    Texts of fewer than three characters have no gram and are looked for in all rows.
    """
    rows = index.rows
    if len(text) >= GRAM:
        rows = rows.join(candidates(index, text), "row_id", "left_semi")
    return search(rows.drop("row_id"), text, database, schema, cde_only)


def search(
    catalog: DataFrame, text: str = "", database: str | None = None, schema: str | None = None, cde_only: bool = False
) -> DataFrame:
    """Rows whose table, column or description contains the text, as written, in any case."""
    out = catalog
    if text:
        fields = [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in SEARCHED]
        out = out.filter(reduce(lambda a, b: a | b, fields))
    if database is not None:
        out = out.filter(F.col("database_name") == database)
    if schema is not None:
        out = out.filter(F.col("schema_name") == schema)
    return out.filter(F.col("cde_flag") == "YES") if cde_only else out


def catalog_metrics(catalog: DataFrame) -> DataFrame:
    """Objects, columns, critical elements, documented columns."""
    return catalog.agg(
        F.count_distinct(F.struct(*OBJECT)).alias("objects"),
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("cde_flag") == "YES").alias("critical_data_elements"),
        F.count_if(P.is_filled(F.col("description"))).alias("documented_columns"),
    )


def object_names(catalog: DataFrame) -> DataFrame:
    return catalog.select(S.dotted(*[F.col(c) for c in OBJECT]).alias("object_name")).distinct()


def assets(catalog: DataFrame) -> DataFrame:
    """One header row per object, with the texts shown when something is missing."""
    first = {
        c: F.min_by(c, "ordinal_position").alias(c) for c in ("data_owner", "data_steward", "certification", "latest_dq_status")
    }
    shown = {
        "data_owner": "Not assigned", "data_steward": "Not assigned",
        "certification": "Not certified", "latest_dq_status": "Not available",
    }
    return catalog.groupBy(*OBJECT).agg(*first.values(), F.count(F.lit(1)).alias("columns")).select(
        S.dotted(*[F.col(c) for c in OBJECT]).alias("object_name"),
        *[F.coalesce(S.blank_to_null(F.col(c)), F.lit(text)).alias(c) for c, text in shown.items()],
        "columns",
    )


def asset_columns(catalog: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    """Column listing of one object."""
    here = (F.col("database_name") == obj[0]) & (F.col("schema_name") == obj[1]) & (F.col("table_name") == obj[2])
    return catalog.filter(here).select(
        "column_name", "column_type", "description", "cde_flag", "criticality_level", "classification"
    )


def certification_status(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """Certification shown per object: the latest run's outcome, else the tag, else none."""
    latest = C.latest_certifications(runs).select(
        "database_name", "schema_name", F.col("object_name").alias("table_name"), "final_status"
    )
    tagged = catalog.groupBy(*OBJECT).agg(F.max("certification").alias("certification"))
    return tagged.join(latest, OBJECT, "left").select(
        *OBJECT,
        F.coalesce("final_status", S.blank_to_null(F.col("certification")), F.lit("Not certified")).alias("certification"),
    )


def object_lineage(snapshot: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    """Edges that touch the object, in listing order."""
    return L.object_edges(snapshot, obj, native_only=False).orderBy(
        "direction", "distance", "source_database", "source_schema", "source_object", "source_column"
    )


def lineage_totals(snapshot: DataFrame, obj: tuple[str, str, str]) -> DataFrame:
    return snapshot.filter(L.touches(obj)).agg(
        F.count(F.lit(1)).alias("lineage_edges"), F.count_if(F.col("lineage_source") == L.NATIVE).alias("native_edges")
    )


def adoption_totals(evidence: DataFrame, *keys: str) -> DataFrame:
    return evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_distinct("role_name").alias("distinct_roles")
    )


def scorecard_summary(current: DataFrame) -> DataFrame:
    """Passed controls, overall status and evaluation time per object."""
    n = len(C.CONTROLS)
    passed = F.count_if(F.col("control_status") == "PASS")
    return current.groupBy(*C.RUN_KEYS).agg(
        F.concat(passed.cast("string"), F.lit(f"/{n}")).alias("scorecard"),
        P.label(passed == n, "CERTIFIED", "IN PROGRESS").alias("overall_status"),
        F.max("evaluated_at").alias("last_evaluated"),
    )


def object_trace(trace: DataFrame) -> DataFrame:
    return trace.orderBy("evidence_type", "distance", "source_database", "source_schema", "source_object", "source_column")


def object_impact(impact: DataFrame) -> DataFrame:
    return impact.select(
        "source_column", "target_database", "target_schema", "target_object", "affected_column", "hop",
        "impact_evidence_type", "data_owner", "data_steward",
    ).orderBy("hop", "target_database", "target_schema", "target_object")
