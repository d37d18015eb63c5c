"""The tables an analysis shares, each computed once and staged."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitaframe.config import DEFAULTS, Settings
from vitaframe.operators import anomalies as an
from vitaframe.operators import baseline as bl
from vitaframe.operators import cleaning as cl
from vitaframe.operators import correlation as co
from vitaframe.operators.daily import daily_wide
from vitaframe.session import stage_table
from vitaframe.sources.tables import EVENT_SETTINGS, event_meals, event_records


class Workspace:
    """Records, and the tables derived from them, by name.

    A derived table is written to the shared checkpoint folder when it is first
    asked for and read back from there, so that later queries neither repeat
    the work nor carry a long lineage.
    """

    def __init__(
        self,
        records: DataFrame,
        meals: DataFrame,
        settings: Settings = DEFAULTS,
        label: str = "analysis",
    ):
        self.records = records
        self.meals = meals
        self.settings = settings
        self.label = label
        self._staged: dict[str, DataFrame] = {}

    def recipe(self, name: str) -> DataFrame:
        """The table as a plan on the tables before it."""
        recipes: dict[str, Callable[[], DataFrame]] = {
            # Outlier limits and outlier flags both read the rows flagged so far. Payload
            # stays with the records.
            "flagged": lambda: cl.flag_out_of_range(
                cl.flag_duplicates(cl.without_payload(self.records)), self.settings
            ),
            "cleaned": lambda: cl.flag_missing(
                cl.flag_outliers(self["flagged"], self.settings)
            ),
            "daily": lambda: daily_wide(self["cleaned"]),
            "baselines": lambda: bl.health_baselines(self["cleaned"], self.settings),
            "hourly": lambda: bl.hourly_pattern(self["cleaned"]),
            "weekdays": lambda: bl.weekday_pattern(self["cleaned"]),
            "correlations": lambda: co.daily_correlations(self["daily"], self.settings),
            "lags": lambda: co.lag_correlations(self["daily"], self.settings),
            "rolling": lambda: co.rolling_correlations(self["daily"], self.settings),
            "trends": lambda: co.rolling_summary(self["rolling"]),
            "anomaly_days": lambda: an.anomaly_days(self["daily"], self.settings),
            "anomalies": lambda: an.anomaly_summary(self["anomaly_days"]),
        }
        return recipes[name]()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._staged:
            self._staged[name] = stage_table(self.recipe(name), f"{self.label}-{name}")
        return self._staged[name]

    def insight_tables(self) -> dict[str, DataFrame]:
        names = ["baselines", "hourly", "weekdays", "correlations", "lags", "anomalies"]
        return {**{n: self[n] for n in names}, "rolling": self["trends"]}


_OPEN: dict[tuple[str, str, str], Workspace] = {}


def table_version(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of a table's files, as far as its top folder, in one text."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(
        (f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(where)
    )
    return hashlib.sha256(repr(files).encode()).hexdigest()


def event_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of one set of tables; kept for the running application.

    Tables that have been rewritten since get a new one.
    """
    version = table_version(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    key = (spark.sparkContext.applicationId, sf_dir, version)
    if key not in _OPEN:
        label = "events-" + hashlib.sha256(sf_dir.encode()).hexdigest()[:12]
        _OPEN[key] = Workspace(
            event_records(spark, sf_dir), event_meals(spark, sf_dir), EVENT_SETTINGS, label
        )
    return _OPEN[key]
