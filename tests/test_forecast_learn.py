import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tidecast.operators import calibrate as K
from tidecast.operators import forecast as P
from tidecast.operators import kpi
from tidecast.operators import learn as N
from tidecast.operators import ledger as L
from tidecast.operators import metrics as M
from tidecast.operators import macro, models, text
from tidecast.session import fresh_path
from tidecast.sources import sinks
from tidecast.streaming import jobs

D = dt.date


def test_strict_hit(spark):
    df = spark.createDataFrame([(100.0, 110.0), (100.0, 111.0), (99.0, 109.0), (99.0, 110.0), (0.0, 3.0)], "actual double, pred double")
    assert [r[0] for r in df.select(M.hit_strict()).collect()] == [1, 0, 1, 0, None]


def test_zero_actual_counts_in_mae_not_in_wmape(spark):
    df = spark.createDataFrame([(D(2025, 1, 1), 0.0, 10.0), (D(2025, 1, 2), 100.0, 110.0)], "date date, actual double, pred double")
    r = M.metrics(df).first()
    assert (r["n"], r["mae"], r["wmape"], r["hit_rate"]) == (2, 10.0, 10.0, 100.0)


def test_blend_uses_what_is_there(spark):
    df = spark.createDataFrame([(100.0, None, None, None, 0.5, 0.5)], "ml double, neural double, seasonal double, ai double, ml_weight double, ai_weight double")
    assert P.blend(df).first()["combined"] == pytest.approx(100.0)


def test_closed_when_others_have_rows(spark):
    day = spark.createDataFrame([("A", D(2025, 9, 2), 5.0), ("A", D(2025, 8, 26), 10.0), ("B", D(2025, 8, 26), 10.0)], "entity string, date date, guests double")
    cal = spark.createDataFrame([(D(2025, 9, 2), "NATIONAL_DAY")], "date date, holiday_type string")
    base = spark.createDataFrame(
        [("NATIONAL_DAY", 2025, D(2025, 9, 2), e, 1, 10.0) for e in ("A", "B")],
        "period_type string, year int, start date, entity string, wd int, base double")
    r = {(x["entity"], str(x["date"])): x["ratio"] for x in K.ratios(day, base, cal, "2025-12-31").collect()}
    assert r == {("A", "2025-09-02"): 0.5, ("B", "2025-09-02"): 0.0}


def test_validation_decisions(spark):
    df = spark.createDataFrame(
        [(100.0, 97.0, 0.5, 0.47), (100.0, 90.0, 0.5, 0.5), (100.0, 106.0, 0.5, 0.5), (100.0, 100.0, 0.5, 0.5)],
        "a double, b double, c double, d double")
    got = [r[0] for r in df.select(N.decide(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == ["HOLD", "CONFIRM", "ROLLBACK", "HOLD"]


def test_constant_factor_has_no_correlation(spark):
    rows = [(2024, m, 100.0 + m, 10.0 * m, float(m), float(-m), 3.0, 5.0) for m in range(1, 7)]
    j = spark.createDataFrame(rows, "year int, month int, guests double, revenue double, gold double, gas double, deposit_rate double, lending_rate double")
    got = {(r["target"], r["factor"]): (round(r["r"], 6), r["strength"]) for r in macro.correlations(j).collect()}
    assert got[("guests", "gold")] == (1.0, "strong") and got[("guests", "gas")] == (-1.0, "strong")
    assert got[("revenue", "lending_rate")] == (0.0, "N/A")


def test_parse_answer(spark):
    texts = ['ok [{"date":"2025-01-01","forecast":5}] bye', 'a {"date":"2025-01-02","forecast":7} b {"x":1}', "nothing", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    assert sorted(map(tuple, text.parse_answer(df, "t").select("id", "date", "forecast").collect())) == [(0, "2025-01-01", 5.0), (1, "2025-01-02", 7.0)]


def test_final_cap_scales_the_day(spark):
    row = ("A", D(2025, 3, 3), False, None, False, None, 1.0, 100.0, 100.0, 100.0, 10.0, 10.0)
    df = spark.createDataFrame(
        [(*row, "MORNING", 80.0), (*row, "EVENING", 120.0)],
        "entity string, date date, is_holiday boolean, holiday_type string, is_special_event boolean, event_type string, holiday_impact double, "
        "max_daily_normal double, max_daily_normal_weekday double, max_daily_normal_weekend double, min_daily_normal_weekday double, "
        "min_daily_normal_weekend double, shift string, forecast double").withColumn("max_by_special", F.create_map().cast("map<string,double>"))
    assert {r["shift"]: r["forecast"] for r in P.final_cap(df).collect()} == {"MORNING": 40.0, "EVENING": 60.0}


def test_merge_keeps_past_and_replaces_future(spark):
    s = "run_date date, entity string, date date, pred double"
    old = spark.createDataFrame([(D(2025, 1, 1), "A", D(2025, 1, 5), 1.0), (D(2025, 1, 1), "A", D(2025, 1, 2), 2.0), (None, "B", D(2024, 12, 1), 3.0)], s)
    new = spark.createDataFrame([(D(2025, 1, 3), "A", D(2025, 1, 5), 9.0), (D(2025, 1, 3), "A", D(2025, 1, 2), 8.0)], s)
    assert sorted(r["pred"] for r in L.merge(old, new, "2025-01-03").collect()) == [2.0, 3.0, 9.0]


def test_kpi_falls_back_to_hourly_rows(spark):
    rows = [(D(2025, 1, 1), "A", D(2025, 1, 2), h, None, 5.0, 4.0) for h in (8, 9, 10, 20)]
    led = spark.createDataFrame(rows, "run_date date, entity string, date date, hour int, shift string, pred double, actual double")
    got = {r["shift"]: r["pred"] for r in kpi.prepare(led).collect()}
    assert got == {"MORNING": 10.0, "EVENING": 5.0}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8, 9])
def test_median_without_me(spark, n):
    vals = [float((i * 7) % 5) for i in range(n)]
    df = spark.createDataFrame([("c", f"e{i}", v) for i, v in enumerate(vals)], "cluster string, entity string, v double")
    got = {r["entity"]: r["others"] for r in models._median_without_me(df, ["cluster"], "v").collect()}
    for i in range(n):
        assert got[f"e{i}"] == pytest.approx(statistics.median(vals[:i] + vals[i + 1:]))


def test_state_versions(spark):
    root = fresh_path(spark, "state-test")
    for v in (1.0, 2.0):
        sinks.save_state(spark.createDataFrame([("A", v)], "entity string, value double"), root)
    assert sinks.load_state(spark, root).first()["value"] == 2.0


def test_streamed_bias_equals_batch_over_two_runs(spark):
    s = "entity string, date date, error double"
    src, out = fresh_path(spark, "bias-src"), fresh_path(spark, "bias-out")
    days = [("A", D(2025, 1, i), float(i)) for i in range(1, 7)] + [("B", D(2025, 1, 2), 4.0)]
    parts = [[r for r in days if r[1].day <= 3], [r for r in days if r[1].day > 3]]
    for part in parts:
        spark.createDataFrame(part, s).coalesce(1).write.mode("append").parquet(src)
        jobs.track_bias(jobs.file_stream(spark, src, s), out, f"{out}-cp")
    want = {r["entity"]: r["bias"] for r in jobs.fold_bias(spark.createDataFrame(days, s)).collect()}
    got = {r["entity"]: r["bias"] for r in jobs.newest_bias(spark, out).collect()}
    assert got == pytest.approx(want)


def test_late_rows_are_dropped_by_the_watermark(spark):
    s = "entity string, open_time timestamp, guests double, transaction_id string"
    src, out = fresh_path(spark, "late-src"), fresh_path(spark, "late-out")
    t = lambda h, m=0, d=1: dt.datetime(2025, 1, d, h, m)
    first = [("A", t(8), 1.0, "a"), ("A", t(12), 1.0, "b"), ("A", t(12), 1.0, "b")]
    later = [("A", t(8, 30), 5.0, "late"), ("A", t(9, d=2), 1.0, "c")]
    for part in (first, later):
        spark.createDataFrame(part, s).coalesce(1).write.mode("append").parquet(src)
        jobs.run_to_table(jobs.hourly(jobs.dedup_txn(jobs.file_stream(spark, src, s), "10 minutes"), None), out, f"{out}-cp")
    got = {(r["start"].hour, r["n"], r["guests"]) for r in spark.read.parquet(out).collect()}
    assert got == {(8, 1, 1.0), (12, 1, 1.0)}


def test_a_day_split_over_two_batches_is_one_day(spark):
    src, out = fresh_path(spark, "split-src"), fresh_path(spark, "split-out")
    s = "entity string, date date, error double"
    for error in (10.0, 20.0):
        spark.createDataFrame([("A", dt.date(2025, 1, 1), error)], s).coalesce(1).write.mode("append").parquet(src)
    stream = jobs.file_stream(spark, src, spark.read.parquet(src).schema, files_per_batch=1)
    jobs.track_bias(stream, out, f"{out}-cp")
    row = jobs.newest_bias(spark, out).first()
    assert (round(row["bias"], 9), row["days"]) == (4.5, 1)


def test_models_without_training_rows_give_null(spark):
    cols = ["a", *models.PROTECTED]
    row = {c: 1.0 for c in [*cols, "shift_id", "weekday", "is_weekend", "is_holiday", "holiday_impact"]}
    h = spark.createDataFrame([{**row, "entity": "A", "date": D(2025, 1, 1), "guests": 5.0, "sample_weight": 1.0}])
    assert models.gbt_forecast(h.limit(0), h, cols).first()["forecast"] is None
    assert models.stack_forecast(h.limit(0), h, cols).first()["forecast"] is None
    _, passed, r2 = models._gated(h.limit(0), cols, "guests")
    assert (passed, r2) == (False, 0.0)


def test_hourly_rows_count_where_a_run_has_no_shift_rows(spark):
    """One entity's shift rows do not hide another entity's hourly rows."""
    s = "run_date date, entity string, date date, shift string, hour int, pred double, actual double"
    run, d = D(2025, 1, 1), D(2025, 1, 2)
    rows = [(run, "A", d, "MORNING", None, 10.0, 12.0), (run, "A", d, None, 9, 1.0, 1.0), (run, "B", d, None, 9, 3.0, 4.0), (run, "B", d, None, 10, 5.0, 6.0)]
    rows += [(None, "A", d, None, 9, 7.0, 8.0)]
    got = sorted((r.run_date is None, r.entity, r["shift"], r.pred, r.actual) for r in kpi.prepare(spark.createDataFrame(rows, s)).collect())
    assert got == [(False, "A", "MORNING", 10.0, 12.0), (False, "B", "MORNING", 8.0, 10.0), (True, "A", "MORNING", 7.0, 8.0)]


def test_pairs_for_every_entity_with_three_weeks(spark):
    days = [(e, D(2025, 1, 1) + dt.timedelta(i), float(10 + i)) for e, n in (("A", 60), ("B", 21), ("C", 20)) for i in range(n)]
    day = spark.createDataFrame(days, "entity string, date date, guests double")
    cal = spark.createDataFrame([(D(2025, 1, 1), True), (D(2025, 1, 2), False)], "date date, is_holiday boolean")
    got = text.pairs(day, cal, template=text.PairTemplate(system="S", holiday="HOL")).collect()
    assert {r.entity: sum(x.entity == r.entity for x in got) for r in got} == {"A": 14, "B": 1}
    assert "2025-01-01;Wed;10;HOL\n" in next(r.text for r in got if r.entity == "B")
    assert text.pairs(day, cal, min_rows=102).count() == 0
