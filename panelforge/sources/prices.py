"""Cached price and volume tables, one partition per ticker, and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.columns import number
from panelforge.operators.panel import align

SCHEMA = "date date, px double, volume double"


def cache_path(cache: str, ticker: str) -> str:
    return f"{cache.rstrip('/')}/ticker={ticker}"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cached(spark: SparkSession, cache: str, ticker: str) -> bool:
    fs, at = _fs(spark, cache_path(cache, ticker))
    return fs.exists(at)


def write_prices(prices: DataFrame, cache: str) -> None:
    """Parquet sink partitioned by ticker; only the tickers written are replaced."""
    prices.select("date", "px", "volume", "ticker").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker").parquet(cache)


def fetch_single(spark: SparkSession, cache: str, ticker: str, start: str, end: str, download: Callable[[SparkSession, str, str, str], DataFrame] | None = None, use_cache: bool = True) -> DataFrame:
    """``date, ticker, px, volume`` of one ticker. A cache hit is read whole, whatever the dates; a miss calls ``download`` and writes the cache."""
    if use_cache and cached(spark, cache, ticker):
        return spark.read.schema(SCHEMA).parquet(cache_path(cache, ticker)).select("date", F.lit(ticker).alias("ticker"), number("px").alias("px"), number("volume").alias("volume"))
    if download is None:
        raise ValueError(f"{ticker} is not cached and there is no downloader")
    got = download(spark, ticker, start, end).select("date", F.lit(ticker).alias("ticker"), number("px").alias("px"), number("volume").alias("volume"))
    if got.isEmpty():
        raise ValueError(f"no data for {ticker}")
    write_prices(got, cache)
    return got


def fetch_panel(spark: SparkSession, cache: str, tickers: Sequence[str], start: str, end: str, download: Callable | None = None, use_cache: bool = True, limit: int = 5) -> DataFrame:
    """The aligned panel of several tickers. One that fails is left out; if all fail, that is an error."""
    got, failed = [], []
    for ticker in tickers:
        try:
            got.append(fetch_single(spark, cache, ticker, start, end, download, use_cache))
        except Exception as e:  # noqa: BLE001
            failed.append(f"{ticker}: {e}")
    if not got:
        raise ValueError("no ticker could be read: " + "; ".join(failed))
    panel = got[0]
    for other in got[1:]:
        panel = panel.unionByName(other)
    return align(panel, limit)


def scan_tickers(spark: SparkSession, cache: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """The whole cache as one long table; a choice of tickers prunes partitions."""
    rows = spark.read.schema(SCHEMA + ", ticker string").parquet(cache)
    return rows.where(F.col("ticker").isin(list(tickers))) if tickers else rows


def clear_cache(spark: SparkSession, cache: str) -> int:
    """Delete all cached tickers; how many there were."""
    fs, at = _fs(spark, cache)
    if not fs.exists(at):
        return 0
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("ticker=")]
    for path in found:
        fs.delete(path, True)
    return len(found)
