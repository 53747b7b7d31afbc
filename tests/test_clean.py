from datetime import datetime, timedelta

import pandas as pd
import pytest
from helpers import SCHEMA
from pyspark.sql import functions as F

from driftline.operators import clean as C
from driftline.sources import tables as R


def frame(spark, rows, schema="SID string, ISO_TIME timestamp_ntz, WMO_WIND double, WMO_PRES double"):
    return spark.createDataFrame(
        [(s, datetime(2019, 1, 1) + timedelta(hours=h), *rest) for s, h, *rest in rows], schema)


def test_fill_is_causal_limited_and_by_rows(spark):
    df = frame(spark, [("A", 0, None, 1.0), ("A", 6, 50.0, 1.0), ("A", 12, None, 1.0),
                       ("A", 48, None, 1.0), ("A", 54, None, 1.0), ("B", 0, None, 1.0)])
    got = [r.WMO_WIND for r in C.ffill_causal(df).orderBy("SID", "ISO_TIME").collect()]
    assert got == [None, 50.0, 50.0, 50.0, None, None]  # two rows, also across a gap


def test_dedupe_prefers_complete_rows_and_shrinks_before_the_shuffle(spark, tables):
    one = tables["single"]
    copies = one.where("ISO_TIME = '2019-08-01'").crossJoin(spark.range(5000)).drop("id") \
        .withColumn("WMO_WIND", F.lit(None).cast("double"))
    got = C.dedupe_most_complete(copies.unionByName(one))
    assert got.count() == 26 and got.where("WMO_WIND IS NULL").count() == 0
    assert "partial_min" in got._jdf.queryExecution().executedPlan().toString()


def test_segments_break_at_gaps_and_do_not_truncate_numbers(spark, tables):
    got = C.assign_segments(tables["gapped"].drop("SEGMENT_ID"))
    assert {r.SEGMENT_ID: r.n for r in got.groupBy("SEGMENT_ID").agg(F.count("*").alias("n")).collect()} \
        == {"G_S01": 10, "G_S02": 12}
    hops = frame(spark, [("A", 12 * i, 1.0, 1.0) for i in range(105)])
    names = [r.SEGMENT_ID for r in C.assign_segments(hops).orderBy("ISO_TIME").collect()]
    assert names[0] == "A_S01" and names[99] == "A_S100"
    counts = C.segment_counts(got).first()
    assert (counts.storms, counts.segments, counts.fragmented) == (1, 2, 1)


def test_spacing_check_raises(tables):
    C.check_spacing_strict(tables["gapped"])
    with pytest.raises(AssertionError, match="30.0"):
        C.check_spacing_strict(tables["gapped"].withColumn("SEGMENT_ID", F.col("SID")))


def test_short_segments_go(tables):
    assert C.filter_short_segments(tables["gapped"], 11).count() == 12


def test_bad_text_becomes_null_not_an_error(spark):
    row = ("A", "2019.0", "NA", "MM", "2019-01-01 00:00:00", "x", "190", " ", "990", "5", "nan", "TS", "1", "main")
    cols = list(C.K.REQUIRED_COLUMNS)
    df = spark.createDataFrame([row, ("A", "bad", *row[2:]), (*row[:4], "no time", *row[5:])],
                               ", ".join(f"{c} string" for c in cols))
    typed = C.coerce_types(df)
    assert typed.count() == 2 and dict(typed.dtypes)["ISO_TIME"] == "timestamp_ntz"
    first = typed.first()
    assert first.LAT is None and first.WMO_WIND is None and first.STORM_DIR is None
    assert C.normalize_longitude(typed).first().LON == -170
    assert C.filter_season(df).count() == 2
    report = {r.column_name: r.n_coerced for r in C.coercion_report(df).collect()}
    assert report["LAT"] == 3 and report["ISO_TIME"] == 1


def test_missing_columns_are_named(tables):
    with pytest.raises(ValueError, match="WMO_PRES"):
        C.select_columns(tables["single"].drop("WMO_PRES"))
    with pytest.raises(ValueError, match="LAT"):
        R.require_columns(tables["single"].drop("LAT"))


def test_fill_simulation_equals_brute_force(spark):
    rows = [("A", 0, None, 1.0), ("A", 6, 3.0, None), ("B", 0, None, 2.0), ("B", 6, None, None)]
    got = C.fill_simulation(frame(spark, rows)).first()
    pdf = pd.DataFrame(rows, columns=["SID", "h", "w", "p"])
    filled = pdf.groupby("SID")[["w", "p"]].transform(lambda x: x.ffill().bfill())
    assert got.wind_missing_after == filled["w"].isna().sum()
    assert got.pressure_missing_after == filled["p"].isna().sum()
    assert got.rows_still_missing == filled.isna().any(axis=1).sum()


def test_csv_round_trip_keeps_na_and_blanks(spark, tables, tmp_path):
    base = str(tmp_path / "clean")
    df = tables["clean"].withColumn("NATURE", F.lit(" ss"))
    R.write_csv(df, f"{base}.csv")
    back = R.read_table(spark, base)
    assert back.where("BASIN = 'NA'").count() == 26 and back.where("NATURE = ' ss'").count() == 104
    assert dict(back.dtypes)["LAT"] == "double" and dict(back.dtypes)["ISO_TIME"] == "timestamp_ntz"
    text = str(tmp_path / "raw.csv")
    spark.createDataFrame([("NA", "#N/A"), ("null", "N/A")], "a string, b string") \
        .write.option("header", True).csv(text)
    assert {tuple(r) for r in R.read_raw(spark, text).collect()} == {("NA", None), (None, "N/A")}


def test_schema_of_the_chain(spark, tables):
    raw = tables["clean"].drop("SEGMENT_ID")
    out = C.clean(raw)
    assert out.count() == 104 and set(out.columns) == {c.split()[0] for c in SCHEMA.split(", ")}


def test_screened_rows_give_the_chain_and_its_counts(spark, tables):
    raw = tables["clean"].drop("SEGMENT_ID").withColumn("TRACK_TYPE", F.lit(" Main "))
    first = raw.where("SID = 'A'").limit(1)
    odd = [first.withColumn(c, F.lit(v).cast(dict(raw.dtypes)[c])) for c, v in (
        ("TRACK_TYPE", "spur"), ("TRACK_TYPE", None), ("SEASON", None), ("SEASON", 1900), ("ISO_TIME", None),
        ("LAT", 95.0), ("LON", None), ("NATURE", "ET"), ("NATURE", None), ("WMO_WIND", None), ("SID", None),
        ("ISO_TIME", "2019-08-01 03:00:00"), ("ISO_TIME", "2019-08-01 03:30:00"))]
    for row in odd:
        raw = raw.unionByName(row)
    rows = C.screen(raw.repartition(5)).cache()
    chain = C.clean_screened(rows)
    assert chain.exceptAll(C.clean(raw)).count() == 0 and chain.count() == C.clean(raw).count() == 104
    funnel = {r.stage: r.n_rows for r in C.retention_funnel(rows).collect()}
    assert funnel == {"raw": 117, "track_type": 115, "season": 113, "valid_time": 112, "coordinates": 110, "nature": 108,
                      "unique": 107, "synoptic": 105, "intensity": 105, "segment_length": 104}
    summary = C.cleaning_summary(chain, rows).first()
    assert (summary.raw_rows, summary.clean_rows, summary.storms) == (117, 104, 4)
    none = C.retention_funnel(C.screen(raw.limit(0))).collect()
    assert len(none) == 10 and all(r.n_rows == 0 for r in none)


def test_counts_of_the_chain_read_raw_rows_once(spark, tables, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    raw = tables["clean"].drop("SEGMENT_ID").withColumn("LAT", counted.asNondeterministic()("LAT"))
    path = str(tmp_path / "screened")
    C.screen(raw).write.parquet(path)
    rows = spark.read.parquet(path)
    assert C.retention_funnel(rows).count() == 10 and C.cleaning_summary(C.clean_screened(rows), rows).count() == 1
    assert seen.value == 104
