"""All registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables
from .action_queries import ACTIONS
from .area_queries import AREA_TABLE
from .detector_queries import DETECTORS
from .feed_queries import FEEDS
from .io_queries import IO_TABLE
from .report_queries import REPORTS
from .sequential_queries import SEQUENTIAL
from .signal_queries import SIGNALS
from .spatial_queries import SPATIAL
from .stateful_queries import STATEFUL
from .summary_queries import SUMMARIES
from .version_queries import VERSIONS
from .zone_queries import ZONE_TABLE

Query = Callable[[SparkSession, str], DataFrame]


def bound(job: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: job(Tables(spark, sf_dir))


_ALL = REPORTS | DETECTORS | ZONE_TABLE | SPATIAL | SIGNALS | ACTIONS | AREA_TABLE | SEQUENTIAL | IO_TABLE | VERSIONS | STATEFUL | FEEDS | SUMMARIES
QUERIES: dict[str, Query] = {name: bound(job) for name, (job, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
