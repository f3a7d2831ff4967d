"""A registry of sources: what each can say about which fields, how far it is trusted, and its adapter.

An adapter turns records into candidates, DataFrame to DataFrame; the registry is a small table
(a row for each source), so that the sources of a field are a query and not a walk.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators import rules

CANDIDATE = "field string, value string, confidence double, scope string, evidence string"


class Adapter(Protocol):
    """``candidates``: (key, field, value, confidence, scope, evidence) of the records that the source knows."""

    def candidates(self, records: DataFrame, key: str, fields: list[str]) -> DataFrame: ...


@dataclass(frozen=True)
class Source:
    name: str
    fields: tuple[str, ...]
    scope: str
    priority: int
    ceiling: float
    adapter: Adapter | None = None


def no_candidates(records: DataFrame, key: str) -> DataFrame:
    """The candidates of an adapter that has none (yet)."""
    names = [c.strip().split(" ") for c in CANDIDATE.split(",")]
    return records.where(F.lit(False)).select(key, *(F.lit(None).cast(t).alias(n) for n, t in names))


@dataclass
class Registry:
    """Sources by name; one registered again replaces the former and keeps its place.  Their
    number is that of adapters written, so the table is small."""

    sources: dict[str, Source] = field(default_factory=dict)

    def register(self, source: Source) -> None:
        self.sources[source.name] = source

    def table(self, spark: SparkSession) -> DataFrame:
        """(source, at, fields, scope, priority, ceiling), ``at`` by registration."""
        rows = [(s.name, i, list(s.fields), s.scope, s.priority, s.ceiling) for i, s in enumerate(self.sources.values())]
        return spark.createDataFrame(rows, "source string, at int, fields array<string>, scope string, priority int, ceiling double")

    def sources_for(self, spark: SparkSession, name: str | Column) -> DataFrame:
        """The sources of a field, least priority first, then as registered."""
        return self.table(spark).where(F.array_contains("fields", name)).orderBy("priority", "at")

    def ranked(self, spark: SparkSession, fields: DataFrame, column: str = "field") -> DataFrame:
        """``fields`` with ``sources``, the names of each field's sources by priority; none is an empty list."""
        held = self.table(spark).select(F.explode("fields").alias(column), F.struct("priority", "at", "source").alias("s"))
        per = held.groupBy(column).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["source"]).alias("sources"))  # as many as there are sources
        return fields.join(per, column, "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))

    def candidates(self, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
        """(key, field, value, confidence, scope, evidence, source, priority) of all adapters.

        Fields that a source isn't registered for are no candidates of it; confidences are at
        most its ceiling; a missing scope is the source's.  Sources without an adapter add none.
        """
        parts = []
        for s in self.sources.values():
            wanted = [f for f in fields if f in s.fields]
            rows = s.adapter.candidates(records, key, wanted) if s.adapter and wanted else no_candidates(records, key)
            rows = rows.where(F.col("field").isin(wanted)) if wanted else rows
            parts.append(rows.select(key, "field", "value", F.least("confidence", F.lit(s.ceiling)).alias("confidence"), F.coalesce("scope", F.lit(s.scope)).alias("scope"), "evidence", F.lit(s.name).alias("source"), F.lit(s.priority).alias("priority")))
        return reduce(DataFrame.unionByName, parts) if parts else no_candidates(records, key).withColumns({"source": F.lit(""), "priority": F.lit(0)})


@dataclass(frozen=True)
class SpecAdapter:
    """Candidates from a specification table (make, model, field, value, evidence) of any length."""

    specs: DataFrame
    confidence: float = 0.95
    scope: str = "MODEL_LEVEL"

    def candidates(self, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
        found = records.select(key, "make", "model").join(self.specs.where(F.col("field").isin(fields)), ["make", "model"])
        return found.select(key, "field", "value", F.lit(self.confidence).alias("confidence"), F.lit(self.scope).alias("scope"), "evidence")


# The fields that a portal's variant pages always say, and the models of which both count.
OVERLAP_FIELDS = ["ebd", "rear_parking_sensors"]
OVERLAP_BOTH = ["Swift", "Windsor EV"]


@dataclass(frozen=True)
class OverlapAdapter:
    """Yes for at most two fields of exactly matching variants, of most models for the first
    wanted one only: a second source beside others, to compare them by."""

    listed: DataFrame  # (key, make, model, variant, fuel_type, transmission) of the portal
    site: str

    def candidates(self, records: DataFrame, key: str, fields: list[str]) -> DataFrame:
        wanted = [f for f in fields if f in OVERLAP_FIELDS]
        if not wanted:
            return no_candidates(records, key)
        names = ("make", "model", "variant", "fuel_type", "transmission")
        theirs = self.listed.select(key, F.struct(*names).alias("__theirs"))
        held = records.select(key, *names, F.struct(*names).alias("__ours")).join(theirs, key)
        status, _ = rules.variant_match("__ours", "__theirs")
        count = F.when(F.col("model").isin(OVERLAP_BOTH), len(wanted)).otherwise(1)
        held = held.where(status == "EXACT").select(key, "make", "model", "variant", F.posexplode(F.array(*map(F.lit, wanted))).alias("__at", "field"), count.alias("__count")).where("__at < __count")
        page = F.concat(F.lit(f"https://{self.site}/"), F.col("make"), F.lit("-"), F.col("model"), F.lit("/"), F.col("variant"))
        return held.select(key, "field", F.lit("Yes").alias("value"), F.lit(0.9).alias("confidence"), F.lit(None).cast("string").alias("scope"), page.alias("evidence"))
