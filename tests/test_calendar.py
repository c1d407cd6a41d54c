import datetime as dt

from pyspark.sql import functions as F

from panelcast.functions import calendar as cal


def _flags(spark, days):
    df = spark.createDataFrame([(d,) for d in days], "date DATE")
    out = cal.date_features(df, "date", cyclical_features=True, holidays=True, business=True)
    return {r["date"]: r for r in out.collect()}


def test_holidays_and_observed_days(spark):
    days = [dt.date(2020, 11, 26), dt.date(2020, 7, 3), dt.date(2021, 6, 18), dt.date(2020, 6, 19),
            dt.date(2021, 1, 18), dt.date(2020, 5, 25), dt.date(1999, 12, 31), dt.date(2020, 12, 24),
            dt.date(2021, 12, 24), dt.date(2020, 9, 7), dt.date(2020, 10, 12), dt.date(2020, 2, 17),
            dt.date(2020, 11, 11), dt.date(2020, 11, 27)]
    f = _flags(spark, days)
    assert f[dt.date(2020, 11, 26)]["is_holiday"] == 1   # Thanksgiving
    assert f[dt.date(2020, 7, 3)]["is_holiday"] == 1     # July 4th on Saturday -> Friday
    assert f[dt.date(2021, 6, 18)]["is_holiday"] == 1    # Juneteenth 2021 on Saturday -> Friday
    assert f[dt.date(2020, 6, 19)]["is_holiday"] == 0    # before 2021
    assert f[dt.date(2021, 1, 18)]["is_holiday"] == 1    # MLK day
    assert f[dt.date(2020, 5, 25)]["is_holiday"] == 1    # Memorial day
    assert f[dt.date(1999, 12, 31)]["is_holiday"] == 1   # New Year 2000 on Saturday
    assert f[dt.date(2020, 12, 24)]["is_holiday"] == 0
    assert f[dt.date(2021, 12, 24)]["is_holiday"] == 1   # Christmas on Saturday
    assert f[dt.date(2020, 9, 7)]["is_holiday"] == 1
    assert f[dt.date(2020, 10, 12)]["is_holiday"] == 1
    assert f[dt.date(2020, 2, 17)]["is_holiday"] == 1
    assert f[dt.date(2020, 11, 11)]["is_holiday"] == 1
    assert f[dt.date(2020, 11, 27)]["is_holiday"] == 0


def test_calendar_fixture(spark):
    df = spark.createDataFrame([], "date DATE")
    days = spark.sql("SELECT explode(sequence(DATE'2019-12-25', DATE'2021-01-05')) AS date")
    out = {r["date"]: r for r in cal.date_features(days, "date", business=True).collect()}
    assert out[dt.date(2021, 1, 3)]["weekofyear"] == 53          # ISO week 53
    assert out[dt.date(2020, 2, 29)]["dayofyear"] == 60          # leap day
    assert out[dt.date(2020, 12, 31)]["dayofyear"] == 366
    assert out[dt.date(2020, 3, 31)]["is_quarter_end"] == 1
    assert out[dt.date(2020, 4, 30)]["is_quarter_end"] == 0
    assert out[dt.date(2020, 4, 30)]["is_month_end"] == 1
    assert out[dt.date(2020, 4, 1)]["is_quarter_start"] == 1
    assert out[dt.date(2020, 1, 6)]["dayofweek"] == 0            # Monday = 0
    assert out[dt.date(2020, 1, 5)]["is_weekend"] == 1
    assert abs(out[dt.date(2020, 3, 1)]["month_sin"] - 1.0) < 1e-12
    assert len(out) == 378
    assert df.count() == 0


def test_holiday_join_matches_rule(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2002-12-31')) AS date")
    calendar = days.filter(cal.us_federal_holiday("date") == 1)
    joined = cal.holiday_flag(days, "date", calendar)
    rule = days.withColumn("r", cal.us_federal_holiday("date"))
    diff = joined.join(rule, "date").filter(F.col("is_holiday") != F.col("r")).count()
    assert diff == 0


def test_time_features_days_since_start(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (1, dt.date(2020, 1, 11)), (2, dt.date(2020, 1, 5))],
                               "k INT, date DATE")
    g = {(r["k"], r["date"]): r["days_since_start"] for r in cal.time_features(df, "date").collect()}
    assert g[(1, dt.date(2020, 1, 11))] == 10 and g[(2, dt.date(2020, 1, 5))] == 4
    k = {(r["k"], r["date"]): r["days_since_start"] for r in cal.time_features(df, "date", keys=["k"]).collect()}
    assert k[(2, dt.date(2020, 1, 5))] == 0
