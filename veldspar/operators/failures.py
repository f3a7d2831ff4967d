"""Failures as data: what one row or one source can't do is a row of an error table, not the end of a job.

Work that can fail is a Python function over a text, run in Arrow batches; a failure becomes the
``error`` of its row.  Parsers of requests are tried one after the other, row by row, and union
of sources keeps what the good ones gave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions import intent


def attempted(rows: DataFrame, column: str, work: Callable[[str], str | None], value: str = "value", error: str = "error") -> DataFrame:
    """``rows`` with what ``work`` makes of a text and, where it raises, the error's text instead.

    Null texts are not tried.  One bad row leaves all others their results.
    """
    names = [n for n in rows.columns if n not in (value, error)]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def one(t: str | None) -> tuple[str | None, str | None]:
        if t is None:
            return None, None
        try:
            return work(t), None
        except Exception as e:  # whatever the work raises is this row's error
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(t) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array([g[i] for g in got], pa.string()) for i in (0, 1))], names=[*names, value, error])

    return rows.select(*names).mapInArrow(run, ", ".join([*(f"`{n}` {kinds[n]}" for n in names), f"`{value}` string", f"`{error}` string"]))


def split(tried: DataFrame, key: str, source: str, value: str = "value", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, (source, key, error) of the others)."""
    bad = tried.where(F.col(error).isNotNull())
    return tried.where(F.col(error).isNull()).drop(error), bad.select(F.lit(source).alias("source"), F.col(key), F.col(error).alias("error"))


def union_of(sources: dict[str, Callable[[], DataFrame]], columns: list[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(bag union of all sources that can be read, in their order; (source, error) of the others).

    A source is read when it is asked for, and its plan is checked then (a missing table, folder
    or column counts as its failure); a source without rows adds none.
    """
    union, errors = None, []
    for name, read in sources.items():
        try:
            rows = read().select(*columns, F.lit(name).alias("source"))
            rows.schema  # noqa: B018  resolves names and files
        except (PySparkException, OSError, ValueError) as e:
            errors.append((name, str(e).splitlines()[0]))
            continue
        union = rows if union is None else union.unionByName(rows)
    return union, errors


def dispatched(requests: DataFrame, text: str = "query", model: dict[str, str] | None = None, fails: Column | None = None) -> DataFrame:
    """Requests by the hybrid parser, row by row by the plain one where that fails.

    Adds ``parser_used`` (``hybrid`` or ``regex_fallback``), ``intent`` (a struct of the hybrid
    parser's fields; null for the fallback) and ``filters``: (price_min, price_max, seats,
    transmission, body_type, makes, mileage_min, mileage_max).  The hybrid parser fails where
    ``fails`` says so (say, no model's answer is there) and on a null text.
    """
    before = [F.col(f"`{c}`") for c in requests.columns]
    hybrid = intent.parsed(requests, text, model=model)
    told = [c for c in hybrid.columns if c not in requests.columns]
    one = hybrid.select(*before, F.struct(*told).alias("intent"))
    plain = intent.plain(one, text)
    bad = F.col(text).isNull() | F.coalesce(fails if fails is not None else F.lit(False), F.lit(False))
    names = ["price_min", "price_max", "seats", "transmission", "body_type", "makes", "mileage_min", "mileage_max"]
    kinds = dict(plain.select(*names).dtypes)
    have = {n for n, _ in hybrid.select(*told).dtypes}
    hybrid_of = {n: F.col(f"intent.{n}") if n in have else F.lit(None) for n in names}
    filters = F.struct(*(F.when(bad, F.col(n)).otherwise(hybrid_of[n].try_cast(kinds[n])).alias(n) for n in names))
    return plain.select(*before, F.when(bad, "regex_fallback").otherwise("hybrid").alias("parser_used"), F.when(~bad, F.col("intent")).alias("intent"), filters.alias("filters"))
