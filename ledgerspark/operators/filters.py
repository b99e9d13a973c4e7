"""Filters of datasets: session scope, project, model and local dates."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.exprs import canonical_path, model_key
from ledgerspark.schema import RANKING_SORTS

from .graph import reach

SCOPES = ("own", "descendants")


@dataclass(frozen=True)
class Filters:
    timezone: str = "UTC"
    session: str = ""
    scope: str = "own"
    project: str = ""
    model: str = ""
    start: str = ""
    end: str = ""
    sort: str = "calls"

    @classmethod
    def parse(cls, values: dict[str, str]) -> Filters:
        """Checked filters from text values; unknown keys are ignored, bad values raise ValueError."""
        known = {f: str(values.get(f) or "").strip() for f in cls.__dataclass_fields__}
        given = cls(**{f: v for f, v in known.items() if v})
        try:
            ZoneInfo(given.timezone)
        except (ZoneInfoNotFoundError, ValueError) as e:
            raise ValueError(f"unknown time zone: {given.timezone}") from e
        days = [date.fromisoformat(d) if d else None for d in (given.start, given.end)]
        if all(days) and days[0] > days[1]:
            raise ValueError("the start is after the end")
        if given.scope not in SCOPES:
            raise ValueError(f"unknown scope: {given.scope}")
        if given.sort not in RANKING_SORTS:
            raise ValueError(f"unknown sort: {given.sort}")
        return given

    @property
    def any(self) -> bool:
        return bool(self.session or self.project or self.model or self.start or self.end)

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        """UTC wall times of the first local midnight and of the one after the last day."""

        def midnight(day: str, more: int) -> datetime | None:
            if not day:
                return None
            at = datetime.combine(date.fromisoformat(day) + timedelta(days=more), time(), ZoneInfo(self.timezone))
            return at.astimezone(timezone.utc).replace(tzinfo=None)

        return midnight(self.start, 0), midnight(self.end, 1)


def scope_of(edges: DataFrame, filters: Filters) -> DataFrame:
    """``session_id`` of the filter's session, with all below it if its scope says so."""
    root = edges.sparkSession.createDataFrame([(filters.session,)], "root string")
    if filters.scope == "own":
        return root.select(F.col("root").alias("session_id"))
    return reach(edges, root).select(F.col("node").alias("session_id")).distinct()


def project_keys(projects: DataFrame, paths: DataFrame) -> DataFrame:
    """``path, project_key`` for distinct ``path`` values: the id of the longest root at or above it.

    A path is joined by equality with each of its own prefixes, so roots may be many.
    """
    sep = F.when(F.col("canon").contains("\\"), "\\").otherwise("/")
    listed = paths.select("path").distinct().where("path is not null and path <> ''").withColumn("canon", canonical_path(F.col("path"))).withColumn("sep", sep)
    cut = F.split("canon", F.when(F.col("sep") == "\\", r"\\").otherwise("/"))
    prefixes = F.concat(F.transform(F.sequence(F.lit(1), F.size("cut")), lambda n: F.array_join(F.slice("cut", 1, n), "\u0000")), F.array(F.lit("\u0000")))
    each = listed.withColumn("cut", cut).select("path", "canon", F.explode(prefixes).alias("p"), "sep").withColumn("prefix", F.replace("p", F.lit("\u0000"), F.col("sep")))
    roots = projects.select(F.col("id").alias("project_id"), canonical_path(F.col("root")).alias("_root")).where("_root is not null")
    found = each.join(roots, each.prefix == roots._root).groupBy("path").agg(F.max_by("project_id", F.struct(F.length("_root"), F.col("project_id"))).alias("project_id"))
    return listed.join(found, "path", "left").select("path", F.coalesce("project_id", "canon").alias("project_key"))


def with_project(df: DataFrame, projects: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``project_key`` beside ``project``: unknown where there is none.

    ``keys`` is a kept table of ``path, project_key``; without it the rows' own projects are looked up.
    """
    keys = project_keys(projects, df.select(F.col("project").alias("path"))) if keys is None else keys
    return df.join(keys, df.project == keys.path, "left").drop("path").withColumn("project_key", F.coalesce("project_key", F.lit("unknown")))


def where(df: DataFrame, filters: Filters, edges: DataFrame, projects: DataFrame, keyed: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """Rows that pass, with ``project_key`` if it is asked for or filtered by.  Rows without time don't
    pass a date filter."""
    first, last = filters.bounds()
    if first is not None:
        df = df.where(F.col("timestamp") >= F.lit(first.isoformat(" ")).cast("timestamp_ntz"))
    if last is not None:
        df = df.where(F.col("timestamp") < F.lit(last.isoformat(" ")).cast("timestamp_ntz"))
    if filters.model:
        df = df.where(model_key() == filters.model)
    if filters.session:
        df = df.where(F.col("session_id") == filters.session) if filters.scope == "own" else df.join(scope_of(edges, filters), "session_id", "left_semi")
    if not (keyed or filters.project):
        return df
    df = with_project(df, projects, keys)
    return df.where(F.col("project_key") == filters.project) if filters.project else df
