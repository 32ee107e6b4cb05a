from datetime import timedelta

import pytest

from custodia.functions.scalars import key_id
from custodia.operators import classify as C
from custodia.operators import review as V

from pyspark.sql import functions as F

PAN = "card 4532-0151-1283-0366 on file"


def scan_one(spark, values, detector):
    df = spark.createDataFrame([(v,) for v in values], "memo string")
    return C.scan(df, [detector]).first()


@pytest.mark.parametrize(("hits", "total", "detected"), [(1, 20, True), (1, 21, False), (0, 20, False), (20, 20, True)])
def test_threshold_is_inclusive(spark, hits, total, detected):
    r = scan_one(spark, [PAN] * hits + ["nothing"] * (total - hits), C.CARD_PAN)
    assert (r.values_seen, r.values_matched, r.detected) == (total, hits, detected)


def test_nulls_do_not_count_as_values(spark):
    r = scan_one(spark, [PAN] + [None] * 100, C.CARD_PAN)
    assert (r.values_seen, r.detected) == (1, True)


def test_empty_column_is_not_detected(spark):
    r = scan_one(spark, [None, None], C.CARD_PAN)
    assert (r.values_seen, r.share, r.detected) == (0, 0.0, False)


@pytest.mark.parametrize(("text", "ok"), [("4532015112830366", True), ("4532-0151-1283-0366", True), ("4532 0151 1283 0367", False), ("1111222233334445 4532015112830366", True)])
def test_luhn(spark, text, ok):
    assert scan_one(spark, [text], C.FREE_TEXT[3]).values_matched == int(ok)


def test_name_rules_and_types(spark):
    df = spark.createDataFrame([("Ann", None, 1)], "first_name string, date_of_birth date, n int")
    got = {(r.column_name, r.semantic_category): r.detected for r in C.scan(df, C.BUILT_IN).collect()}
    assert got[("first_name", "NAME")] and got[("date_of_birth", "DATE_OF_BIRTH")]
    assert not any(v for (c, _), v in got.items() if c == "n")


def test_long_texts_are_scanned_to_the_end(spark):
    r = scan_one(spark, ["x" * 200_000 + " a@b.com"], C.FREE_TEXT[0])
    assert r.values_matched == 1


def test_best_supported_category_wins(spark, as_of):
    df = spark.createDataFrame([("a@x.com",), ("b@x.com",), (PAN,)], "contact string")
    tags = C.system_tags(C.classify_table(df, ("D", "S", "T"), [*C.BUILT_IN, C.CARD_PAN]))
    r = C.capture_results(tags, as_of).first()
    assert (r.semantic_category, r.privacy_category, r.classifier_source) == ("EMAIL", "IDENTIFIER", "BUILT_IN")


def test_evaluation_reaches_the_published_ratios(spark):
    """7 TP, 1 FP, 5 FN, 36 TN give 0.875 and 0.5833."""
    names = [f"C{k}" for k in range(49)]
    universe = spark.createDataFrame([("STG_T", n) for n in names], "table_name string, column_name string")
    truth = spark.createDataFrame([("T", n, "PII", "CONFIRMED", "r") for n in names[:12]], "table_name string, column_name string, expected_classification string, source_section string, reason string")
    found = spark.createDataFrame([("STG_T", n, "NAME", "IDENTIFIER", "BUILT_IN") for n in [*names[:7], names[20]]] + [("STG_T", names[30], None, None, "BUILT_IN")],
                                  "table_name string, column_name string, semantic_category string, privacy_category string, classifier_source string")
    e = C.evaluate(universe, truth, found)
    assert tuple(C.precision_recall(e).first()) == (7, 1, 5, 36, 0.875, 0.5833)
    assert C.misses(e).count() == 5
    assert [r.column_name for r in C.false_positives(e).collect()] == ["C20"]
    assert tuple(C.precision_recall(e.limit(0)).first())[4:] == (None, None)


# ---- review ----------------------------------------------------------------------

RESULTS = "database_name string, schema_name string, table_name string, column_name string, semantic_category string, privacy_category string, classifier_source string"


@pytest.fixture
def queue(spark, as_of):
    found = spark.createDataFrame(
        [("A", "S", "T", "EMAIL", "EMAIL", "IDENTIFIER", "BUILT_IN"), ("A", "S", "T", "MEMO", "CARD_PAN", "IDENTIFIER", "CUSTOM_PAN_CLASSIFIER"),
         ("A", "S", "T", "CITY", "CITY", "QUASI_IDENTIFIER", "BUILT_IN"), ("A", "S", "T", "N", None, None, "BUILT_IN")], RESULTS)
    return V.refresh_queue(spark.createDataFrame([], V.QUEUE_SCHEMA), found, as_of)


def review_id(spark, column):
    return spark.range(1).select(key_id(F.lit("A"), F.lit("S"), F.lit("T"), F.lit(column))).first()[0]


def test_new_detections_are_pending_with_a_suggestion(queue, rows):
    assert rows(queue.select("column_name", "suggested_classification", "review_status")) == [
        ("CITY", None, "PENDING"), ("EMAIL", "PII", "PENDING"), ("MEMO", "ACCOUNT_DETAILS", "PENDING")]


def test_approve_then_everything_else_is_refused(spark, queue, as_of):
    rid = review_id(spark, "EMAIL")
    done, message = V.approve(queue, rid, "PII", "ok", "steward", as_of)
    assert message == f"Classification approved for review ID: {rid}"
    row = done.filter(F.col("review_id") == rid).first()
    assert (row.review_status, row.confirmed_classification, row.reviewed_by, row.review_notes) == ("APPROVED", "PII", "steward", "ok")
    again, message = V.approve(done, rid, "PUBLIC", None, "steward", as_of)
    assert message == f"Review ID not found or not pending: {rid}" and again is done
    _, message = V.reject(done, rid, None, "steward", as_of)
    assert message.startswith("Review ID not found")
    _, message = V.approve(queue, "nope", "PII", None, "steward", as_of)
    assert message == "Review ID not found or not pending: nope"


def test_unknown_class_is_refused(spark, queue, as_of):
    same, message = V.approve(queue, review_id(spark, "EMAIL"), "POTENTIALLY_SENSITIVE", None, "steward", as_of)
    assert message == "Invalid confirmed classification: POTENTIALLY_SENSITIVE" and same is queue


def test_reject_clears_the_class(spark, queue, as_of):
    rid = review_id(spark, "MEMO")
    done, message = V.reject(queue, rid, "no", "steward", as_of)
    row = done.filter(F.col("review_id") == rid).first()
    assert message == f"Classification rejected for review ID: {rid}"
    assert (row.review_status, row.confirmed_classification, row.review_notes) == ("REJECTED", None, "no")


def test_refresh_leaves_decided_reviews_alone(spark, queue, as_of):
    rid = review_id(spark, "EMAIL")
    done, _ = V.approve(queue, rid, "PII", None, "steward", as_of)
    new = spark.createDataFrame([("A", "S", "T", "EMAIL", "NAME", "X", "Y"), ("A", "S", "T", "CITY", "NAME", "X", "Y")], RESULTS)
    out = {r.column_name: r for r in V.refresh_queue(done, new, as_of).collect()}
    assert out["EMAIL"].detected_semantic_category == "EMAIL" and out["EMAIL"].review_status == "APPROVED"
    assert out["CITY"].detected_semantic_category == "NAME" and out["CITY"].suggested_classification == "PII"
    assert len(out) == 3


def test_sync_only_approved_and_only_once(spark, queue, as_of):
    done, _ = V.approve(queue, review_id(spark, "EMAIL"), "PII", None, "steward", as_of)
    tags = spark.createDataFrame([], "database_name string, schema_name string, table_name string, column_name string, domain string, tag_name string, tag_value string, apply_method string")
    known = spark.createDataFrame([("A", "S", "T")], "database_name string, schema_name string, table_name string")
    synced = V.sync_tags(done, tags, known)
    with pytest.raises(Exception, match="not found in table metadata: A.S.T"):
        V.sync_tags(done, tags, known.limit(0)).collect()
    assert [(r.column_name, r.tag_value) for r in synced.collect()] == [("EMAIL", "PII")]
    log = V.sync_history(done, tags, as_of).collect()
    assert [(r.object_identifier, r.harvest_id) for r in log] == [("A.S.T.EMAIL", f"STEWARD_APPROVAL:{review_id(spark, 'EMAIL')}")]
    assert V.sync_history(done, synced, as_of).count() == 0
    assert V.sync_tags(done, synced, known).count() == 1


def test_unknown_object_stops_the_sync(spark, queue):
    known = spark.createDataFrame([("A", "S", "T")], "database_name string, schema_name string, table_name string")
    V.require_known(queue, known)
    with pytest.raises(ValueError, match="A.S.T"):
        V.require_known(queue, known.limit(0))


# ---- rescans by difference -------------------------------------------------------


def counted(df, rows):
    return rows(df.select("column_name", "detector_order", "values_seen", "values_matched", "share", "detected"))


def test_rescan_reads_only_what_changed(spark, tmp_path, rows, as_of):
    rules, path = [*C.BUILT_IN, C.CARD_PAN], str(tmp_path / "t")
    table = spark.range(60).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit("@a.org"))).alias("mail"), F.lit("x").alias("last_name"))
    table.filter("id < 40").repartition(2).write.parquet(path)
    first = C.rescan(spark.read.parquet(path), None, rules, as_of)
    first.write.parquet(str(tmp_path / "c1"))
    first = spark.read.parquet(str(tmp_path / "c1"))
    assert counted(C.merged(first, rules), rows) == counted(C.scan(spark.read.parquet(path), rules), rows)

    table.filter("id >= 40").coalesce(1).write.mode("append").parquet(path)
    later = as_of + timedelta(days=1)
    second = C.rescan(spark.read.parquet(path), first, rules, later)
    assert counted(C.merged(second, rules), rows) == counted(C.scan(spark.read.parquet(path), rules), rows)
    fresh = second.filter(F.col("captured_at") == F.lit(later)).select("file_path").distinct().collect()
    assert len(fresh) == 1 and second.select("file_path").distinct().count() == 3

    # Other detectors, and counters older than the profile allows, count everything anew.
    assert C.rescan(spark.read.parquet(path), second, rules[:2], later).filter(F.col("captured_at") < F.lit(later)).isEmpty()
    much_later = as_of + timedelta(days=40)
    assert C.rescan(spark.read.parquet(path), second, rules, much_later).filter(F.col("captured_at") < F.lit(much_later)).isEmpty()


def test_rescan_forgets_files_that_are_gone(spark, tmp_path, rows, as_of):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a@b.org",), ("c",)], "mail string").repartition(2).write.parquet(path)
    first = C.rescan(spark.read.parquet(path), None, C.BUILT_IN, as_of)
    first.write.parquet(str(tmp_path / "c1"))
    gone = sorted(tmp_path.glob("t/*.parquet"))[0]
    gone.unlink()
    (tmp_path / "t" / f".{gone.name}.crc").unlink()
    left = spark.read.parquet(path)
    again = C.rescan(left, spark.read.parquet(str(tmp_path / "c1")), C.BUILT_IN, as_of)
    assert counted(C.merged(again, C.BUILT_IN), rows) == counted(C.scan(left, C.BUILT_IN), rows)


def test_many_changed_files_are_joined(spark, tmp_path, rows, as_of, monkeypatch):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a@b.org",), ("c",), (None,)], "mail string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    whole = counted(C.merged(C.rescan(df, None, C.BUILT_IN, as_of), C.BUILT_IN), rows)
    monkeypatch.setattr(C, "LISTED_FILES", 1)
    assert counted(C.merged(C.rescan(df, None, C.BUILT_IN, as_of), C.BUILT_IN), rows) == whole


def test_profile_decides_about_tags(spark):
    df = spark.createDataFrame([("a@b.org",)], "mail string")
    found = C.classify_table(df, ("D", "S", "T"), C.BUILT_IN)
    assert C.system_tags(found).count() == 2 and C.system_tags(found, C.Profile(auto_tag=False)).count() == 0
