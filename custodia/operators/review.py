"""Steward review: detections are proposals, only approvals become classification tags."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions import scalars as S
from custodia.operators.classify import KEY, OBJECT, detected_only
from custodia.sinks import store

# Classes a steward may confirm, and the class a category suggests.
CONFIRMABLE = ("PII", "ACCOUNT_DETAILS", "SENSITIVE", "QUASI_IDENTIFIER", "INTERNAL", "PUBLIC")
SUGGESTED = {
    "CARD_PAN": "ACCOUNT_DETAILS",
    "EMAIL": "PII",
    "PHONE_NUMBER": "PII",
    "DATE_OF_BIRTH": "PII",
    "NATIONAL_IDENTIFIER": "PII",
    "NAME": "PII",
    "ADDRESS": "PII",
}

QUEUE_SCHEMA = (
    "review_id string, database_name string, schema_name string, table_name string, column_name string, "
    "detected_semantic_category string, detected_privacy_category string, classifier_source string, "
    "suggested_classification string, confirmed_classification string, review_status string, "
    "reviewed_by string, reviewed_at timestamp, review_notes string, created_at timestamp"
)


def suggest(category: Column) -> Column:
    """The class a detected category suggests; NULL leaves it to the steward."""
    return S.mapped(category, SUGGESTED)


def candidates(results: DataFrame) -> DataFrame:
    return detected_only(results).select(
        S.key_id(*[F.col(k) for k in KEY]).alias("review_id"),
        *KEY,
        F.col("semantic_category").alias("detected_semantic_category"),
        F.col("privacy_category").alias("detected_privacy_category"),
        "classifier_source",
        suggest(F.col("semantic_category")).alias("suggested_classification"),
    )


def refresh_queue(queue: DataFrame, results: DataFrame, as_of: datetime) -> DataFrame:
    """New detections enter as PENDING; known ones are refreshed only while PENDING."""
    return store.upsert(
        queue,
        candidates(results),
        KEY,
        update=["detected_semantic_category", "detected_privacy_category", "classifier_source", "suggested_classification"],
        when=F.col("review_status") == "PENDING",
        insert_values={"review_status": F.lit("PENDING"), "created_at": F.lit(as_of)},
    )


def _is_pending(queue: DataFrame, review_id: str) -> bool:
    hits = queue.filter((F.col("review_id") == review_id) & (F.col("review_status") == "PENDING"))
    return len(hits.limit(2).collect()) == 1


def approve(
    queue: DataFrame, review_id: str, classification: str, notes: str | None, user: str, as_of: datetime
) -> tuple[DataFrame, str]:
    """Confirm one pending review. A refusal is a message, not an error, and changes nothing."""
    if not _is_pending(queue, review_id):
        return queue, f"Review ID not found or not pending: {review_id}"
    if classification not in CONFIRMABLE:
        return queue, f"Invalid confirmed classification: {classification}"
    out = store.transition(
        queue, review_id, "review_id", "review_status", "PENDING",
        _decision(F.lit("APPROVED"), F.lit(classification), F.lit(notes), F.lit(user), as_of),
    )
    return out, f"Classification approved for review ID: {review_id}"


def reject(queue: DataFrame, review_id: str, notes: str | None, user: str, as_of: datetime) -> tuple[DataFrame, str]:
    """Reject one pending review and clear its class."""
    if not _is_pending(queue, review_id):
        return queue, f"Review ID not found or not pending: {review_id}"
    out = store.transition(
        queue, review_id, "review_id", "review_status", "PENDING",
        _decision(F.lit("REJECTED"), F.lit(None), F.lit(notes), F.lit(user), as_of),
    )
    return out, f"Classification rejected for review ID: {review_id}"


def _decision(status: Column, classification: Column, notes: Column, user: Column, as_of: datetime) -> dict[str, Column]:
    return {
        "confirmed_classification": classification.cast("string"),
        "review_status": status,
        "reviewed_by": user,
        "reviewed_at": F.lit(as_of),
        "review_notes": notes.cast("string"),
    }


def decide(queue: DataFrame, decisions: DataFrame, as_of: datetime) -> DataFrame:
    """Apply many decisions in one pass.

    ``decisions``: review_id, action APPROVE or REJECT, classification, notes, user. Reviews
    that are not pending and approvals with an unknown class stay as they are. Of several
    decisions on one review the first counts (see ``first_decisions``).
    """
    valid = first_decisions(decisions)
    approved = F.col("r.action") == "APPROVE"
    return store.transition(
        queue, valid, "review_id", "review_status", "PENDING",
        _decision(
            F.when(approved, "APPROVED").otherwise("REJECTED"),
            F.when(approved, F.col("r.classification")),
            F.col("r.notes"),
            F.col("r.user"),
            as_of,
        ),
    )


def first_decisions(decisions: DataFrame) -> DataFrame:
    """One valid decision per review: the least by user, action, class and notes, NULLs first."""
    valid = decisions.filter(
        (F.col("action") == "REJECT") | ((F.col("action") == "APPROVE") & F.col("classification").isin(*CONFIRMABLE))
    )
    least = valid.groupBy("review_id").agg(F.min(F.struct("user", "action", "classification", "notes")).alias("d"))
    return least.select("review_id", "d.action", "d.classification", "d.notes", "d.user")


def decision_messages(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each decision would be answered with, given the queue before it."""
    pending = queue.filter("review_status = 'PENDING'").groupBy("review_id").agg(F.count(F.lit(1)).alias("n"))
    rid = F.col("review_id")
    bad_class = (F.col("action") == "APPROVE") & ~F.coalesce(F.col("classification").isin(*CONFIRMABLE), F.lit(False))
    first = first_decisions(decisions).select("review_id", F.struct("user", "action", "classification", "notes").alias("first"))
    late = ~bad_class & F.col("first").isNotNull() & ~F.struct("user", "action", "classification", "notes").eqNullSafe(F.col("first"))
    message = (
        F.when((F.coalesce("n", F.lit(0)) != 1) | late, F.concat(F.lit("Review ID not found or not pending: "), rid))
        .when(bad_class, F.concat(F.lit("Invalid confirmed classification: "), F.coalesce("classification", F.lit("NULL"))))
        .when(F.col("action") == "APPROVE", F.concat(F.lit("Classification approved for review ID: "), rid))
        .otherwise(F.concat(F.lit("Classification rejected for review ID: "), rid))
    )
    return decisions.join(pending, "review_id", "left").join(first, "review_id", "left").select("review_id", message.alias("message"))


def queue_counts(queue: DataFrame) -> DataFrame:
    return queue.groupBy("review_status").agg(F.count(F.lit(1)).alias("review_count"))


def approved(queue: DataFrame) -> DataFrame:
    return queue.filter((F.col("review_status") == "APPROVED") & F.col("confirmed_classification").isNotNull())


def unknown_objects(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Objects that the harvested metadata does not know."""
    return rows.select(*OBJECT).distinct().join(tables.select(*OBJECT), OBJECT, "left_anti")


def require_known(rows: DataFrame, tables: DataFrame) -> None:
    """Stop before any tag is written if an object's type is not known."""
    first = unknown_objects(rows, tables).first()
    if first is not None:
        raise ValueError(f"object type not found in table metadata: {'.'.join(first)}")


def approved_tags(queue: DataFrame) -> DataFrame:
    """Approved decisions as column tags."""
    return approved(queue).select(
        *KEY,
        F.lit("COLUMN").alias("domain"),
        F.lit("CLASSIFICATION").alias("tag_name"),
        F.col("confirmed_classification").alias("tag_value"),
        F.lit("MANUAL").alias("apply_method"),
    )


def sync_tags(queue: DataFrame, tags: DataFrame, tables: DataFrame) -> DataFrame:
    """The tag relation with every approved decision in it.

    Reading it fails, so nothing is written, if a decision names an object that ``tables`` (harvested metadata) lacks.
    """
    known = tables.select(*OBJECT, F.lit(True).alias("__known")).distinct()
    named = F.concat(F.lit("object type not found in table metadata: "), S.dotted(*[F.col(k) for k in OBJECT]))
    wanted = approved_tags(queue).join(known, list(OBJECT), "left").filter(F.assert_true(F.coalesce("__known", F.lit(False)), named).isNull())
    return store.upsert(tags, wanted.drop("__known"), [*KEY, "tag_name"], update=["tag_value", "apply_method"])


def sync_history(queue: DataFrame, tags: DataFrame, as_of: datetime) -> DataFrame:
    """Audit rows for the decisions that change a tag; a rerun adds none."""
    have = tags.filter((F.col("tag_name") == "CLASSIFICATION") & (F.col("domain") == "COLUMN"))
    fresh = approved(queue).join(
        have.select(*KEY, F.col("tag_value").alias("confirmed_classification")), [*KEY, "confirmed_classification"], "left_anti"
    )
    return fresh.select(
        F.lit("CLASSIFICATION").alias("tag_name"),
        F.lit("COLUMN").alias("object_type"),
        S.dotted(*[F.col(k) for k in KEY]).alias("object_identifier"),
        F.col("confirmed_classification").alias("tag_value"),
        F.col("reviewed_by").alias("assigned_by"),
        F.lit(as_of).alias("assigned_at"),
        F.concat(F.lit("STEWARD_APPROVAL:"), F.col("review_id")).alias("harvest_id"),
    )
