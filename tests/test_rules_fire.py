"""The queries on views made for it find something: no result is empty, all NULL or constant."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,column", [("j12b_normalize_vendor_known", "canonical_vendor"), ("j13b_p18_template_memos_known", "template_memo"),
                                         ("j14b_canonicalize_category_known", "category"), ("c11b_apply_taxonomy_known", "category"),
                                         ("c04b_rule_steps_known", "by_time"), ("c01b_keyword_categories_known", "simple")])
def test_known_values_are_found(spark, name, column):
    values = {r[column] for r in entry.queries()[name](spark, SF).select(column).distinct().collect()}
    assert len(values - {None, "Other"}) >= 1 and len(values) > 1


def test_registry_matches(spark):
    got = {r.vendor: r.canonical_vendor for r in entry.queries()["j12b_normalize_vendor_known"](spark, SF).collect()}
    assert got["Spotify Inc."] == "Spotify" and got["DHL Express"] == "DHL" and got["Corner Cafe"] is None
    memos = {(r.vendor, r.category): r.template_memo for r in entry.queries()["j13b_p18_template_memos_known"](spark, SF).collect()}
    assert memos["Spotify Inc.", "Annual Plan"] == "Spotify Annual Subscription"
    kinds = {r.raw: r.category for r in entry.queries()["j14b_canonicalize_category_known"](spark, SF).collect()}
    assert kinds["office_suplies"] == "Office Supplies" and kinds["Transportation"] == "Transportation" and kinds["unknown"] == "Other"


def test_every_detector_flags_the_risky_ledger(spark):
    kinds = {r.flag_type for r in entry.queries()["u04_all_flags_risky"](spark, SF).select("flag_type").distinct().collect()}
    assert {"amount_outlier", "amount_clustering", "frequency_anomaly", "weekend_activity", "after_hours_activity", "vendor_concentration",
            "high_risk_vendor", "unknown_vendor", "sequential_identical_amounts", "vendor_amount_consistency"} <= kinds, kinds


def test_copies_go_and_are_told_apart(spark):
    q = entry.queries()
    assert q["j18b_row_diff"](spark, SF).count() > 0
    assert q["j01b_drop_exact_copies"](spark, SF).count() == q["j02_drop_key_duplicates"](spark, SF).sparkSession.read.parquet(f"{SF}/orders.parquet").count()
