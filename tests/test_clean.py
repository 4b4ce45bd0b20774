from pyspark.sql import functions as F

from tidecast.functions import clean
from tidecast.sources import readers


def col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_keys(spark):
    assert col(spark, ["00766.0", " ab ", "000"], clean.norm_key) == ["766", "AB", "0"]
    assert col(spark, [" {ab-1} "], clean.clean_id) == ["AB-1"]


def test_numbers(spark):
    assert col(spark, ["1.5", "x", None, "NaN"], clean.num_coerce) == [1.5, 0.0, 0.0, 0.0]


def test_shift_limits(spark):
    df = spark.createDataFrame([(h,) for h in (7, 8, 15, 16, 23)], "h int")
    got = [r[0] for r in df.select(clean.shift_of(F.col("h"))).collect()]
    assert got == ["OTHER", "MORNING", "MORNING", "EVENING", "EVENING"]


def test_parse_hour(spark):
    values = ["18:30", "11.0", "25", None, "2025-01-01 09:15:00", "07:05:01", "soon"]
    assert col(spark, values, clean.parse_hour) == [18, 11, None, None, 9, 7, None]
    assert col(spark, values, lambda c: clean.parse_hour(c, 0)) == [18, 11, 0, 0, 9, 7, 0]


def test_dates_and_status(spark):
    got = col(spark, ["2025-03-04 00:00:00", "2025-03-04", "04/03/2025", "12/25/2025", "no"], clean.parse_date_multi)
    assert [str(d) if d else None for d in got] == ["2025-03-04", "2025-03-04", "2025-03-04", "2025-12-25", None]
    assert col(spark, ["Đóng ", "Bán nửa ngày", "Mở", None, "convert"], clean.closure_status) == [
        "CLOSED", "HALF_DAY", "OPEN", "OPEN", "CLOSED"]


def test_codes_and_names(spark):
    assert col(spark, ["01VN1234", "9876543", "AB"], clean.ext_code) == ["1234", "6543", "AB"]
    assert col(spark, ["Phở-Lotus KingBBQ  Đường"], clean.name_norm) == ["pho lotus king bbq duong"]


def test_chain_prefers_brand_code_then_list_order(spark):
    df = spark.createDataFrame([("BlueHouse Center", None), ("Blue House", "ss"), ("Other", None)], "restaurant_name string, brand_code string")
    got = [r["chain"] for r in readers.chain_of(df, {"SS": "South"}, ["Blue House", "Blue"]).collect()]
    assert got == ["Blue House", "South", None]


def test_cancelled(spark):
    assert col(spark, ["", None, " NaN ", "ill"], clean.not_cancelled) == [True, True, True, False]
