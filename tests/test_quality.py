import pytest

from adfathom.operators import quality
from adfathom.schema import COLUMNS, EngineError, NotFound, ValidationFailed
from adfathom.sources import csv_scan
from adfathom.plans.engine import Workspace
from adfathom.sources.datasets import DatasetStore, validate_csv_path, validate_csv_text, validate_dataframe

HEADER = (
    "ad_id,xyz_campaign_id,fb_campaign_id,age,gender,interest,"
    "Impressions,Clicks,Spent,Total_Conversion,Approved_Conversion"
)
#: A row of our own and, cell by cell, what the gate makes of it.
CELLS = [4217, 936, 104402, "45-49", "F", 22, 1200, 14, 20.5, 3, 2]
GOOD = ",".join(map(str, CELLS))


def changed(**cells):
    """The row with some cells replaced by name."""
    return ",".join(str(cells.get(name, cell)) for name, cell in zip(COLUMNS, CELLS))


def text(*rows, header=HEADER):
    """The lines of a file."""
    lines = [header]
    lines.extend(rows)
    return "\n".join(lines)


def report_of(spark, *rows, header=HEADER):
    return validate_csv_text(spark, text(*rows, header=header), must_be_ready=False).summary()


def test_good_text_is_ready(spark):
    result = validate_csv_text(spark, text(GOOD))
    report = result.summary()
    assert report["ready_for_analysis"] and report["row_count"] == 1 and report["column_count"] == 11
    assert report["warnings"] == ["Dataset passed validation and is ready for analysis."]
    assert result.table.columns == COLUMNS
    assert tuple(result.table.head()) == tuple(CELLS)


@pytest.mark.parametrize("content", ["", "  \n \n", b"", b"\n"])
def test_nothing_is_an_empty_file(spark, content):
    with pytest.raises(ValidationFailed) as caught:
        validate_csv_text(spark, content)
    assert caught.value.report["warnings"] == ["CSV file is empty."]
    assert not caught.value.report["ready_for_analysis"]


def test_a_header_alone_has_no_rows(spark):
    report = report_of(spark)
    assert report["warnings"] == ["CSV file contains no data rows."]
    assert (report["row_count"], report["column_count"]) == (0, 11)


def test_a_missing_column_is_named(spark):
    report = report_of(
        spark,
        GOOD.rpartition(",")[0],
        header=HEADER.replace(",Approved_Conversion", ""),
    )
    assert report["warnings"] == ["Missing required columns: purchases."]
    assert (report["row_count"], report["column_count"]) == (1, 10)
    assert set(report["missing_values_by_column"].values()) == {0}


def test_two_spellings_of_one_column_conflict(spark):
    report = report_of(spark, GOOD + ",9", header=HEADER + ",spend")
    assert report["warnings"] == [
        "Multiple source columns map to the same internal columns: spend."
    ]


def test_an_exact_repeat_of_a_header_is_another_column(spark):
    report = report_of(spark, GOOD + ",9", header=HEADER + ",Spent")
    assert report["ready_for_analysis"]


def test_headers_differing_by_case_conflict(spark):
    report = report_of(spark, GOOD + ",9", header=HEADER + ",clicks")
    assert "clicks" in report["warnings"][0] and not report["ready_for_analysis"]


def test_extra_columns_are_dropped(spark):
    result = validate_csv_text(spark, text(GOOD + ",note", header=HEADER + ",Remark (free)"))
    assert result.table.columns == COLUMNS


def test_messy_headers_map(spark):
    header = " AD id , xyz campaign-id,FB.campaign.id,Age,GENDER,Interest,impressions,clicks,Spend!,leads,purchases"
    assert report_of(spark, GOOD, header=header)["ready_for_analysis"]


def test_what_is_no_number_is_invalid(spark):
    cells = ["not-a-number", "1d", "1f", "0x1p3", "1,000", "inf", "1e400", "--5"]
    report = report_of(spark, *[changed(impressions=f'"{c}"', clicks=0) for c in cells])
    assert report["invalid_numeric_values"]["impressions"] == len(cells)
    assert report["missing_values_by_column"]["impressions"] == 0
    assert not report["ready_for_analysis"]


def test_no_value_words_are_missing_not_invalid(spark):
    cells = ["NA", "N/A", "null", "NaN", "nan", "None", "#N/A", "<NA>", "", "   ", '""']
    report = report_of(
        spark, *[changed(ad_id=i, impressions=c) for i, c in enumerate(cells)]
    )
    assert report["missing_values_by_column"]["impressions"] == len(cells)
    assert report["invalid_numeric_values"]["impressions"] == 0
    assert report["warnings"] == ["Missing values were found in: impressions."]


def test_one_number_in_many_spellings_is_one_row(spark):
    cells = ["1200", " 1200 ", "1200.0", "+1200", "1.2e3", "001200"]
    report = report_of(spark, *[changed(impressions=c) for c in cells])
    assert report["duplicate_count"] == len(cells) - 1 and report["row_count"] == 1


def test_long_ids_stay_apart(spark):
    rows = [changed(ad_id=2**60 + i) for i in range(3)]
    result = validate_csv_text(spark, text(*rows))
    assert {r["ad_id"] for r in result.table.collect()} == {2**60, 2**60 + 1, 2**60 + 2}


def test_copies_are_removed_and_do_not_block(spark):
    result = validate_csv_text(spark, text(GOOD, GOOD, changed(age=" 45-49  ")))
    report = result.summary()
    assert report["ready_for_analysis"] and report["duplicate_count"] == 2 and report["row_count"] == 1
    assert report["warnings"] == ["Removed 2 exact duplicate row(s)."]
    assert result.table.count() == 1


def test_only_white_space_is_trimmed(spark):
    cells = ["\tfern\x0b", "\x0c fern ", "fern"]
    result = validate_csv_text(spark, text(*[changed(age=c) for c in cells]))
    assert [r["age"] for r in result.table.collect()] == ["fern"]


def test_each_range_rule_counts_once(spark):
    negative = report_of(spark, changed(spend=-20.5))
    assert negative["negative_values"]["spend"] == 1
    clicks = report_of(spark, changed(impressions=2, clicks=3))
    assert clicks["clicks_greater_than_impressions"] == 1
    purchases = report_of(spark, changed(leads=1, purchases=2))
    assert purchases["purchases_greater_than_leads"] == 1
    assert not (negative["ready_for_analysis"] or clicks["ready_for_analysis"] or purchases["ready_for_analysis"])


def test_messages_keep_their_order(spark):
    report = report_of(
        spark, GOOD, GOOD, "x,,1,30-34,M,15,-2,3,1.43,1,2", "y,1,,30-34,,15,1,1,1,1,1"
    )
    assert report["warnings"] == [
        "Removed 1 exact duplicate row(s).",
        "Missing values were found in: campaign_id, ad_set_id, gender.",
        "Invalid numeric values were found in: ad_id.",
        "Negative values were found in: impressions.",
        "1 row(s) have clicks greater than impressions.",
        "1 row(s) have purchases greater than leads.",
    ]


def test_fractions_are_cut_off(spark):
    result = validate_csv_text(spark, text(changed(impressions=1200.9)))
    assert result.table.head()["impressions"] == 1200


def test_blank_lines_are_skipped_and_short_rows_filled(spark):
    report = report_of(spark, "", GOOD, "   ", changed(ad_id=9).rpartition(",")[0], "")
    assert report["row_count"] == 2
    assert report["missing_values_by_column"]["purchases"] == 1


def test_a_row_with_too_many_fields_is_an_error(spark):
    with pytest.raises(ValidationFailed, match="could not be parsed"):
        validate_csv_text(spark, text(GOOD, GOOD + ",7,8"))


def test_quoted_cells_may_hold_commas_quotes_and_line_breaks(spark):
    row = changed(age='"30-34, ""young""\nadults"')
    result = validate_csv_text(spark, text(row))
    assert result.table.head()["age"] == '30-34, "young"\nadults'


def test_quarantine_names_the_broken_rules(spark):
    raw = csv_scan.read_csv_text(spark, text(GOOD, "1,,1,30-34,M,15,-2,3,abc,1,2"))
    distinct = quality.distinct_rows(quality.normalised(csv_scan.canonical_text(raw)))
    rows = quality.quarantine_rows(distinct).collect()
    assert [(r["ad_id"], r["broken_rules"]) for r in rows] == [
        ("1", ["missing:campaign_id", "invalid:spend", "negative:impressions", "clicks>impressions", "purchases>leads"])
    ]


def test_issue_counts_and_totals(spark):
    raw = csv_scan.read_csv_text(spark, text("1,,1,,M,15,-2,0,abc,1,0"))
    report = quality.quality_report(quality.distinct_rows(quality.normalised(csv_scan.canonical_text(raw))))
    counts = {(r["kind"], r["column_name"]): r["n"] for r in quality.issue_counts(report).collect()}
    assert counts == {
        ("missing_values_by_column", "campaign_id"): 1,
        ("missing_values_by_column", "age"): 1,
        ("invalid_numeric_values", "spend"): 1,
        ("negative_values", "impressions"): 1,
    }
    totals = {r["kind"]: r["total"] for r in quality.issue_totals(report).collect()}
    assert totals == {"missing_values_by_column": 2, "invalid_numeric_values": 1, "negative_values": 1}


def test_store_flow(spark, tmp_path):
    default = tmp_path / "default.csv"
    store = DatasetStore(spark, str(tmp_path / "data"), str(default))
    for ask in (store.current, store.active, store.latest_report):
        with pytest.raises(NotFound):
            ask()
    assert store.status()["warnings"] == ["Default dataset file is missing."]

    default.write_text(text(GOOD))
    assert store.active().count() == 1
    assert store.latest_report().head()["ready_for_analysis"]
    store.load_default()
    second = text(GOOD, changed(ad_id=5))
    report = store.store_text(second).summary()
    assert report["row_count"] == 2
    rows, n = store.preview()
    assert n == 2 and [r["ad_id"] for r in rows.collect()] == [5, 4217]
    assert store.saved_report().head().asDict(recursive=True) == report

    with pytest.raises(ValidationFailed):
        store.store_text(text(changed(spend=-1)))
    assert store.current().count() == 2, "a refused upload must not replace the table"
    with pytest.raises(ValidationFailed):
        store.store_csv(str(tmp_path / "data.txt"))
    status = store.status()
    assert status["current_dataset_valid"] and status["default_dataset_valid"]
    assert status["latest_report"]["row_count"] == 2


def test_reports_are_rebuilt_when_none_was_saved(spark, tmp_path):
    default = tmp_path / "default.csv"
    default.write_text(text(GOOD, GOOD))
    store = DatasetStore(spark, str(tmp_path / "data"), str(default))
    assert store.latest_report().head()["duplicate_count"] == 1
    assert store.saved_report() is None
    validate_csv_path(spark, str(default)).table.write.parquet(store._table_path("first"))
    spark.createDataFrame([("first",)], "value string").write.text(store.versions_path)
    assert store.latest_report().head()["duplicate_count"] == 0
    assert store.saved_report() is not None


def test_a_folder_of_csv_files_is_one_table(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        (folder / f"part-{i}.csv").write_text(text(changed(ad_id=i)))
    assert validate_csv_path(spark, str(folder)).table.count() == 3


def test_missing_file(spark, tmp_path):
    with pytest.raises(NotFound):
        validate_csv_path(spark, str(tmp_path / "none.csv"))


def test_header_must_map_before_rows_are_read(spark):
    raw = csv_scan.read_csv_text(spark, "a,b\n1,2")
    with pytest.raises(EngineError):
        csv_scan.canonical_text(raw)


def test_a_row_with_too_many_fields_is_refused_even_if_the_first_surplus_one_is_empty(spark, tmp_path):
    for line in (GOOD + ",,9", GOOD + ",", GOOD + ",x"):
        with pytest.raises(ValidationFailed, match="more than 11 fields"):
            validate_csv_text(spark, text(GOOD, line))
    assert validate_csv_text(spark, text(changed(age='"45,49"'))).table.head()["age"] == "45,49"


def test_files_with_different_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text(text(changed(ad_id=1)))
    (folder / "b.csv").write_text(text(changed(ad_id=2), header=HEADER.replace("Impressions,Clicks", "Clicks,Impressions")))
    with pytest.raises(ValidationFailed, match="different headers"):
        validate_csv_path(spark, str(folder))


def test_line_breaks_in_quotes_can_be_read_by_path(spark, tmp_path):
    path = tmp_path / "broken.csv"
    path.write_text(text(changed(age='"45\n49"'), changed(ad_id=2)))
    store = DatasetStore(spark, str(tmp_path / "data"), str(path))
    assert store.store_csv(str(path)).table.count() == 2


def test_measures_that_sums_cannot_hold_are_invalid(spark):
    report = report_of(spark, changed(spend="1e300"), changed(impressions=10**15))
    assert report["invalid_numeric_values"]["spend"] == 1 and report["invalid_numeric_values"]["impressions"] == 1
    assert not report["ready_for_analysis"]


def test_nan_of_a_data_frame_is_missing(spark):
    rows = [tuple(CELLS[:8] + [float("nan")] + CELLS[9:])]
    report = validate_dataframe(spark.createDataFrame(rows, COLUMNS), must_be_ready=False).summary()
    assert report["missing_values_by_column"]["spend"] == 1 and report["invalid_numeric_values"]["spend"] == 0


def test_answers_follow_the_stored_table_and_versions_stay(spark, tmp_path):
    work = Workspace(spark, str(tmp_path / "work"))
    with pytest.raises(NotFound):
        work.datasets.current()
    for spend in (5.0, 500.0):
        work.datasets.store_text(text(changed(spend=spend)))
        assert work.overview()["totals"].head()["spend"] == spend
    assert work.datasets.status()["latest_report"]["row_count"] == 1


def test_one_file_means_the_same_by_path_and_as_text(spark, tmp_path):
    """Line breaks, doubled quotes and commas in quoted cells, NA words, blank lines and unlike case in the header."""
    header = HEADER.upper() + ',"Note, free"'
    content = "\r\n".join(
        [header, GOOD + ',"two\nlines, ""quoted"""', "", changed(ad_id=2, age="N/A") + ",", changed(ad_id=3, spend="1d") + ",x"]
    )
    path = tmp_path / "ads.csv"
    path.write_bytes(content.encode())
    by_path = validate_csv_path(spark, str(path), must_be_ready=False)
    as_text = validate_csv_text(spark, content, must_be_ready=False)
    assert by_path.summary() == as_text.summary()
    assert sorted(by_path.table.collect(), key=str) == sorted(as_text.table.collect(), key=str)
    found = by_path.summary()
    assert found["row_count"] == 3 and found["missing_values_by_column"]["age"] == 1
    assert found["invalid_numeric_values"]["spend"] == 1


def test_quarantine_parses_a_cell_once_for_all_rules(spark):
    rows = spark.createDataFrame([("1",) * len(COLUMNS)], ", ".join(f"{c} string" for c in COLUMNS))
    plan = quality.quarantine_rows(quality.distinct_rows(rows))._jdf.queryExecution().optimizedPlan().toString()
    # once to choose the rows, once to list their rules
    assert plan.count("RLIKE") <= 2 * len(quality.NUMERIC_COLUMNS)
