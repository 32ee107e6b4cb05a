"""Physical plans: what must reach the scan, and joins that must never appear."""

import pytest

from custodia.operators import classify, protect
from custodia.plans import marts, staging
from custodia.queries import QUERIES
from custodia.queries.inputs import Inputs
from custodia.sinks import store

DATA = "/root/testdata/sf0.001"

# Queries whose plan is built without running a job, one or more of every group.
LAZY = [
    "m01_mart_deposits", "m02_mart_customer_360", "q03_validity", "q04_consistency", "q05_timeliness", "q06_accuracy", "q15_dq_summary",
    "q17_latest_review", "q18_population", "c07_evaluate", "c11_refresh_queue", "c12_decide", "c14_sync_tags", "r10_policy_gaps",
    "d02_apply_tags", "d09_glossary_coverage", "d10_documentation_coverage", "d12_catalog_master", "e01_adoption_of_all", "e07_control_trusted",
    "e11_certify_scorecard", "e12_scorecard_current", "k08_upsert", "k13_transition", "x04_certification_status", "s12_access_edges",
]


@pytest.fixture
def plan(capsys):
    def of(df, mode="formatted"):
        capsys.readouterr()
        df.explain(mode)
        return capsys.readouterr().out

    return of


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_or_nested_loop_join(spark, plan, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "Window" not in text


@pytest.fixture
def tables(spark, tmp_path):
    """The adapters as stored raw tables, as a user would have them."""
    i = Inputs(spark, DATA)
    out = {}
    for n in ("raw_account", "raw_customer", "raw_transaction"):
        getattr(i, n).write.parquet(str(tmp_path / n))
        out[n] = spark.read.parquet(str(tmp_path / n))
    return out


def test_mart_reads_only_what_it_needs(plan, tables, as_of):
    account = staging.stg_account(tables["raw_account"], as_of)
    customer = staging.stg_customer(tables["raw_customer"], as_of)
    txn = staging.stg_transaction(tables["raw_transaction"], as_of)
    text = plan(marts.mart_deposits(account, customer, txn, as_of))
    pushed = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    read = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    assert any("EqualTo(status,ACTIVE)" in p and "In(account_type" in p for p in pushed)
    assert any("GreaterThan(amount,0.00)" in p and "In(transaction_type" in p for p in pushed)
    assert any("In(customer_type" in p for p in pushed)
    schema = next(r for r in read if "amount" in r)
    assert "memo" not in schema and "transaction_id" not in schema
    assert not any("date_of_birth" in r or "address" in r for r in read)


def test_masked_view_prunes_and_pushes_through(plan, tables):
    view = protect.masked(tables["raw_customer"], {"email": "PII", "tax_id": "PII"}, ["DEPOSITS_ANALYST"])
    text = plan(view.filter("customer_type = 'PERSON'").select("customer_id", "email"))
    assert "EqualTo(customer_type,PERSON)" in text
    assert "ReadSchema: struct<customer_id:bigint,customer_type:string>" in text


def test_scan_is_one_pass(plan, tables):
    text = plan(classify.scan(tables["raw_customer"], [*classify.BUILT_IN, classify.CARD_PAN]), "simple")
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 1


def test_small_upsert_does_not_move_the_target(plan, spark, tables):
    target = tables["raw_account"]
    source = target.limit(3).select("account_id", "status")
    text = plan(store.upsert(target, source, ["account_id"]), "simple")
    assert "SortMergeJoin" not in text
    assert "FullOuter" not in text
