from pyspark.sql import functions as F

import pytest

from flowintel import dims
from flowintel.operators import clean
from flowintel.sources.files import raw_schema


def raw_row(**values):
    row = {c: "0" for c in dims.RAW_COLUMNS}
    row.update({"Label": "Benign", "Flow Duration": "100", "Tot Fwd Pkts": "2", "Timestamp": "14/02/2018 08:31:01"})
    row.update(values)
    return tuple(row[c] for c in dims.RAW_COLUMNS)


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), raw_schema())


def test_column_mapping_is_complete():
    assert len(dims.RAW_COLUMNS) == len(set(dims.COLUMN_MAPPING.values())) == 80
    assert dims.COLUMN_MAPPING["Flow Byts/s"] == "flow_byts_s"
    assert dims.COLUMN_MAPPING["TotLen Fwd Pkts"] == "totlen_fwd_pkts"
    assert dims.CLASS_INDEX["Infiltration"] == 11 and dims.CLASS_INDEX["SSH-BruteForce"] == 13


def test_cleaning_rules_and_accounting(spark):
    df = raw(
        spark,
        raw_row(**{"Label": "Infilteration", "Flow Duration": "1000", "Flow Byts/s": "1234.5", "Tot Bwd Pkts": "4"}),
        raw_row(**{"Flow Duration": "0", "Flow Byts/s": "Infinity", "Flow Pkts/s": "NaN"}),
        tuple(dims.RAW_COLUMNS),
        raw_row(**{"Flow Duration": "-500"}),
        raw_row(**{"Flow Duration": "200", "Tot Fwd Pkts": "0"}),
        raw_row(Label=None),
        raw_row(**{"Flow Duration": "abc"}),
    )
    kept, metrics = clean.clean_and_transform(df)
    m = metrics.first()
    assert (m.input_rows, m.repeated_header_rows, m.null_label_rows, m.pre_cleaning_rows) == (7, 1, 1, 5)
    assert (m.retained_rows, m.negative_duration_dropped, m.null_duration_rows) == (3, 2, 1)
    assert (m.diagnostic_zero_fwd_pkts_count, m.semantically_invalid_dropped) == (1, 2)
    rows = kept.collect()
    assert len(rows) == 3 and len(kept.columns) == 83
    typo = next(r for r in rows if r.raw_label == "Infilteration")
    assert (typo.label, typo.flow_duration, typo.tot_bwd_pkts, str(typo.event_date)) == (
        "Infiltration", 1000.0, 4.0, "2018-02-14")
    zero = next(r for r in rows if r.flow_duration == 0)
    assert zero.flow_byts_s == 0.0 and zero.flow_pkts_s == 0.0


def test_token_profile(spark):
    rows = [raw_row(**{"Flow Byts/s": v}) for v in ("Infinity", "-Infinity", "NaN", None, "", "12.5", "-inf", "+inf")]
    found = {r.column_name: r for r in clean.profile_tokens(raw(spark, *rows)).collect()}
    b = found["Flow Byts/s"]
    assert (b.null_or_empty, b.pos_infinity, b.neg_infinity, b.nan, b.rows_profiled) == (2, 2, 2, 1, 8)
    assert set(found) == set(dims.PROFILED_COLUMNS)


@pytest.mark.parametrize("token", ["Infinity", "+Infinity", "-Infinity", "inf", "-inf", "NaN", "nan", "", None])
def test_rate_tokens_become_zero(spark, token):
    row = clean.clean_flows(raw(spark, raw_row(**{raw_name: token for raw_name in (
        "Flow Byts/s", "Flow Pkts/s", "Fwd Pkts/s", "Bwd Pkts/s")}))).first()
    assert [row[c] for c in dims.RATE_COLUMNS] == [0.0] * 4


def test_ratio_guard(spark):
    cases = [("Infinity", "1"), ("-Infinity", "1"), ("NaN", "1"), ("", "1"), (None, "1"), ("3.5", "1"), ("2.0", "0"), ("4.5", "5")]
    rows = [raw_row(**{"Down/Up Ratio": v, "Tot Fwd Pkts": n, "Dst Port": str(i)}) for i, (v, n) in enumerate(cases)]
    got = clean.clean_flows(raw(spark, *rows)).orderBy("dst_port").collect()
    assert [r.down_up_ratio for r in got] == [0, 0, 0, 0, 0, 3.5, 0, 4.5]


def test_invalid_timestamps(spark):
    stamps = ["15/02/2018 10:20:30", "2018-02-15 10:20:30", "not_a_timestamp", "", None]
    kept, metrics = clean.clean_and_transform(raw(spark, *[raw_row(Timestamp=t) for t in stamps]))
    m = metrics.first()
    assert (m.invalid_timestamp_dropped, m.retained_rows) == (4, 1)
    assert kept.where(F.col("event_date").isNull()).count() == 0
    assert str(kept.first().event_date) == "2018-02-15"


def test_unmapped_label_passes_and_is_not_trimmed(spark):
    got = {r.raw_label: r.label for r in clean.clean_flows(
        raw(spark, raw_row(Label="ZeroDay"), raw_row(Label=" Bot"), raw_row(Label="Bot"))).collect()}
    assert got == {"ZeroDay": "ZeroDay", " Bot": " Bot", "Bot": "Bot"}


def test_integrity_flag(spark):
    df = clean.clean_flows(raw(spark, raw_row(), raw_row(Timestamp="15/02/2018 01:00:00")))
    good = clean.verify_integrity(df, expected_rows=2, expected_dates=2).first()
    assert good.passed_integrity_checks and good.partition_dates == ["2018-02-14", "2018-02-15"]
    assert not clean.verify_integrity(df, expected_rows=3).first().passed_integrity_checks


def test_required_columns(spark):
    with pytest.raises(ValueError, match=r"\['a', 'b'\]"):
        clean.require_columns(spark.range(1), ["b", "a", "id"])


def test_wide_rows_of_text_are_not_built(spark):
    """Text made by a projection is typed in that projection, and labels take no join; the values are those of separate steps."""
    text = [f"IF(id % 7 = 3, NULL, string(id * {k + 1})) AS `{c}`" for k, c in enumerate(dims.RAW_COLUMNS)]
    special = {
        "Label": "element_at(array('Benign', 'Infilteration', 'Label', 'Other', NULL, ' Bot'), int(id % 6) + 1)",
        "Timestamp": "element_at(array('14/02/2018 08:31:01', '2018-02-14', NULL, '1/2/2018 08:00:00'), int(id % 4) + 1)",
        "Flow Byts/s": "element_at(array('inf', 'NaN', '', 'abc', NULL, '-Infinity', '2.5', '1e3'), int(id % 8) + 1)",
        "Down/Up Ratio": "element_at(array('x', 'NaN', '', '3', NULL), int(id % 5) + 1)",
        "Tot Fwd Pkts": "element_at(array('0', '-0', '0.0', 'x', NULL, '4'), int(id % 6) + 1)",
        "Dst Port": "element_at(array('80', ' 81 ', '8e1', NULL, '99999999999'), int(id % 5) + 1)",
    }
    made = spark.range(0, 500, 1, 2).selectExpr(*[f"{special[c]} AS `{c}`" if c in special else e for c, e in zip(dims.RAW_COLUMNS, text)])
    flows = clean.typed_flows(made)
    plan = flows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Project [") == 2
    stored = spark.createDataFrame(made.collect(), made.schema)
    separate = stored.where("Label <> 'Label'").selectExpr(
        "CASE Label WHEN 'Infilteration' THEN 'Infiltration' ELSE Label END AS label", "Label AS raw_label", "try_cast(`Dst Port` AS int) AS dst_port",
        "try_cast(`Tot Fwd Pkts` AS double) AS tot_fwd_pkts", "try_cast(`Idle Min` AS double) AS idle_min",
        "CASE WHEN `Flow Byts/s` IS NULL OR `Flow Byts/s` IN ('', 'inf', 'NaN', '-Infinity') THEN 0.0D ELSE try_cast(`Flow Byts/s` AS double) END AS flow_byts_s",
        "CASE WHEN try_cast(`Tot Fwd Pkts` AS double) = 0 OR `Down/Up Ratio` IS NULL OR `Down/Up Ratio` IN ('', 'NaN') THEN 0.0D "
        "ELSE try_cast(`Down/Up Ratio` AS double) END AS down_up_ratio",
        "try_to_timestamp(Timestamp, 'dd/MM/yyyy HH:mm:ss') AS timestamp_parsed", "to_date(try_to_timestamp(Timestamp, 'dd/MM/yyyy HH:mm:ss')) AS event_date")
    assert sorted(map(str, flows.select(separate.columns).collect())) == sorted(map(str, separate.collect()))
