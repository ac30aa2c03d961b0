"""The index snapshot: constituents and change log, cached as Parquet."""

from __future__ import annotations

import logging
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorspark.functions.symbols import to_date
from factorspark.operators import membership
from factorspark.sources.aliases import builtin_renames
from factorspark.sources.html_tables import parse_membership

log = logging.getLogger(__name__)
MAX_AGE = timedelta(days=7)


@dataclass
class UniverseData:
    """Tables constituents and changes, as known at ``fetched_at``."""

    constituents: DataFrame
    changes: DataFrame
    fetched_at: datetime
    source_url: str = ""

    def is_stale(self, max_age: timedelta = MAX_AGE, *, now: datetime | None = None) -> bool:
        at = self.fetched_at if self.fetched_at.tzinfo else self.fetched_at.replace(tzinfo=UTC)
        return (now or datetime.now(UTC)) - at > max_age

    def members_as_of(self, dates: DataFrame | str | date, *, renames: DataFrame | None = None, normalize: bool = True) -> DataFrame:
        """(as_of, ticker) for a date or a table of them (as_of)."""
        spark = self.constituents.sparkSession
        if not isinstance(dates, DataFrame):
            dates = spark.createDataFrame([(to_date(dates),)], "as_of date")
        return membership.members_as_of(self.constituents, self.changes, dates, fetched_at=self.fetched_at.date(),
                                        renames=builtin_renames(spark) if renames is None else renames, normalize=normalize)

    def to_parquet(self, folder: str) -> None:
        self.constituents.write.mode("overwrite").parquet(f"{folder}/constituents.parquet")
        self.changes.write.mode("overwrite").parquet(f"{folder}/changes.parquet")
        meta = [(self.fetched_at.isoformat(), self.source_url)]
        self.constituents.sparkSession.createDataFrame(meta, "fetched_at string, source_url string").coalesce(1).write.mode("overwrite").json(f"{folder}/meta.json")

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> UniverseData:
        """A cached snapshot; dates may be stored as dates or ISO strings."""
        c = spark.read.parquet(f"{folder}/constituents.parquet").withColumn("date_added", F.to_date("date_added"))
        h = spark.read.parquet(f"{folder}/changes.parquet").withColumn("date", F.to_date("date"))
        m = spark.read.schema("fetched_at string, source_url string").json(f"{folder}/meta.json").first()
        return cls(c, h, datetime.fromisoformat(m["fetched_at"]), m["source_url"] or "")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cache_exists(spark: SparkSession, folder: str) -> bool:
    return all(_exists(spark, f"{folder}/{n}") for n in ("constituents.parquet", "changes.parquet", "meta.json"))


def fetch_html(url: str, *, timeout: float = 30) -> str:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return r.read().decode("utf-8", "replace")


def refresh_universe(spark: SparkSession, folder: str, fetch: Callable[[], str], *, source_url: str = "") -> UniverseData:
    c, h = parse_membership(spark, fetch())
    data = UniverseData(c, h, datetime.now(UTC), source_url)
    data.to_parquet(folder)
    return data


def load_universe(spark: SparkSession, folder: str, fetch: Callable[[], str], *, force_refresh: bool = False, max_age: timedelta = MAX_AGE) -> UniverseData:
    """A fresh cache, else a refresh, else (with a warning) the stale cache; a cold failure raises."""
    cached = UniverseData.from_parquet(spark, folder) if cache_exists(spark, folder) else None
    if cached is not None and not force_refresh and not cached.is_stale(max_age):
        return cached
    try:
        return refresh_universe(spark, folder, fetch)
    except Exception:
        if cached is None:
            raise
        log.warning("refresh failed; using the cache of %s", cached.fetched_at, exc_info=True)
        return cached


def get_universe(spark: SparkSession, as_of: str | date, folder: str, fetch: Callable[[], str], **how) -> list[str]:
    """Sorted members on one date."""
    rows = load_universe(spark, folder, fetch, **how).members_as_of(as_of).select("ticker").orderBy("ticker").collect()
    return [r["ticker"] for r in rows]
