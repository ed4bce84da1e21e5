import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.sources import factors, prices
from panelforge.streaming.bars import bars

ROWS = "date date, ticker string, px double, volume double"


def download(spark, ticker, start, end):
    if ticker == "BAD":
        raise OSError("unreachable")
    return spark.createDataFrame([(dt.date(2020, 1, d), ticker, float(d), float("nan") if d == 2 else 9.0) for d in (1, 2, 3)], ROWS)


def test_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    panel = prices.fetch_panel(spark, cache, ["A", "BAD", "B"], "2020-01-01", "2020-12-31", download)
    assert panel.count() == 6 and prices.cached(spark, cache, "A") and not prices.cached(spark, cache, "BAD")
    again = prices.fetch_single(spark, cache, "A", "1999-01-01", "1999-12-31")
    assert again.count() == 3 and again.where("volume is null").count() == 1
    assert prices.scan_tickers(spark, cache, ["B"]).count() == 3
    with pytest.raises(ValueError):
        prices.fetch_panel(spark, cache, ["BAD"], "", "", download)
    with pytest.raises(ValueError):
        prices.fetch_single(spark, cache, "C", "", "")
    assert prices.clear_cache(spark, cache) == 2 and prices.clear_cache(spark, str(tmp_path / "none")) == 0


def test_factor_files(spark, tmp_path):
    five, mom = tmp_path / "five.csv", tmp_path / "mom.csv"
    five.write_text("A preamble\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20200102, 1.00,-0.50,0.1,0.2,0.3,0.006\n20200103,-99.99,0.5,0.1,0.2,0.3,0.006\n 202001,9,9,9,9,9,9\nCopyright\n")
    mom.write_text("text\n20200102,  2.0\n20200106,1.0\n")
    got = factors.six_factors(spark, str(five), str(mom)).collect()
    assert len(got) == 1 and got[0].date == dt.date(2020, 1, 2) and abs(got[0].mkt_rf - 0.01) < 1e-12 and abs(got[0].mom - 0.02) < 1e-12
    alone = factors.read_factors(spark, str(five), factors.FIVE)
    assert alone.count() == 2 and alone.where("mkt_rf is null").count() == 1

    def broken():
        raise OSError("gone")

    assert factors.with_fallback(broken, lambda: alone).count() == 2


def test_streamed_bars_equal_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, h), float(h), None) for h in range(0, 24, 5)] + [("A", dt.datetime(2024, 1, 2, 3), float("nan"), 4.0), (None, dt.datetime(2024, 1, 1), 1.0, 1.0)]
    data = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, px double, volume double")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    try:
        q.processAllAvailable()
        streamed = {tuple(r) for r in spark.table("bars").collect()}
    finally:
        q.stop()
    assert streamed == {tuple(r) for r in bars(data).collect()} and len(streamed) == 2
    assert bars(data).where(F.col("px").isNull()).count() == 1
