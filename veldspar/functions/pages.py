"""Fields of raw pages: headings, embedded JSON and label tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.text import label

STATE = "window.__INITIAL_STATE__"


def stripped(html: Column) -> Column:
    """Text without tags, blanks as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def heading(html: Column) -> Column:
    """The text of the first h1, null without one."""
    return F.nullif(stripped(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)), F.lit(""))


def title(html: Column) -> Column:
    return F.nullif(stripped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def balanced(text: str, begin: int) -> str | None:
    """The JSON object or array that begins at ``begin``; null if it does not end."""
    closing, depth, inside, at = {"{": "}", "[": "]"}[text[begin]], 0, False, begin
    while at < len(text):
        c = text[at]
        if inside:
            at += c == "\\"  # the escaped character has no meaning
            inside = c != '"'
        elif c == '"':
            inside = True
        elif c == text[begin]:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return text[begin : at + 1]
        at += 1
    return None


_WINDOW = 1 << 16
_ODD = 16


def _closed(part: np.ndarray, opening: int, closing: int) -> int | None:
    """The length of the object or array that begins a byte array; 0 if it goes on, null if the
    index can't tell (too many escaped quotes that open a string)."""
    quote = np.flatnonzero(part == 34)
    real = np.ones(len(quote), bool)
    slash = np.flatnonzero(part == 92)
    if len(slash) and len(quote):
        last = np.flatnonzero(np.r_[slash[1:] != slash[:-1] + 1, True])  # ends of runs of backslashes
        odd = np.zeros(len(part) + 1, bool)
        odd[slash[last[np.diff(last, prepend=-1) % 2 == 1]] + 1] = True
        escaped = odd[quote]
        real = ~escaped
        for turn in range(_ODD + 1):  # outside of strings a backslash has no meaning
            outside = np.flatnonzero(escaped & ~real & ((np.cumsum(real) & 1) == 0))
            if not len(outside):
                break
            if turn == _ODD:
                return None
            real[outside[0]] = True
    at = np.flatnonzero((part == opening) | (part == closing))
    at = at[(np.searchsorted(quote[real], at) & 1) == 0]
    done = np.flatnonzero(np.cumsum(np.where(part[at] == opening, 1, -1), dtype=np.int32) == 0)
    return int(at[done[0]]) + 1 if len(done) else 0


def balanced_bytes(data: bytes, begin: int) -> bytes | None:
    """:func:`balanced` of UTF-8 bytes by a structural index: quotes by the parity of the
    backslashes before them, strings by the parity of quotes, depth by sums over the brackets
    outside of strings.  Looked at in growing windows, so short objects in long pages are cheap."""
    whole = np.frombuffer(data, np.uint8)[begin:]
    opening, closing = (123, 125) if whole[0] == 123 else (91, 93)
    width = _WINDOW
    while True:
        n = _closed(whole[:width], opening, closing)
        if n is None:
            found = balanced(data[begin:].decode("utf-8", "replace"), 0)
            return found.encode() if found is not None else None
        if n or width >= len(whole):
            return data[begin : begin + n] if n else None
        width *= 8


def _state(data: bytes, marker: bytes) -> bytes | None:
    at = data.find(marker)
    at = data.find(b"=", at) if at >= 0 else -1
    at = data.find(b"{", at) if at >= 0 else -1
    return balanced_bytes(data, at) if at >= 0 else None


def with_state(pages: DataFrame, html: str = "html", marker: str = STATE) -> DataFrame:
    """``pages`` with ``state``, the JSON text of the object assigned after the marker; null without one.

    A regular expression cannot balance brackets, so this is a structural index over Arrow's
    own bytes; only pages with the marker are looked at.
    """
    fields = [f for f in pages.schema.fields if f.name != "state"]
    names, sign = [f.name for f in fields], marker.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(html).cast(pa.large_binary())
            states = pa.array([_state(t.as_buffer().to_pybytes(), sign) if t.is_valid else None for t in column], pa.large_binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), states.cast(pa.large_string()).cast(pa.string())], names=[*names, "state"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "state string"])
    out = pages.select(*names).mapInArrow(run, schema)
    return out.withColumn("state", F.when(F.try_parse_json("state").isNotNull(), F.col("state")))


def linked_data(html: Column) -> Column:
    """The valid JSON texts of ld+json scripts, in order."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(blocks, lambda b: (F.trim(b) != "") & F.try_parse_json(b).isNotNull())


def offer(blocks: Column) -> Column:
    """(price, currency) texts of the first ld+json object, or member of its graph, that has one."""
    def held(b: Column) -> Column:
        graph = F.coalesce(F.from_json(F.get_json_object(b, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))
        return F.concat(F.array(b), graph)

    def told(b: Column) -> Column:
        get = lambda *paths: F.coalesce(*(F.get_json_object(b, p) for p in paths))
        return F.struct(get("$.offers.price", "$.offers.lowPrice", "$.price").alias("price"), get("$.offers.priceCurrency", "$.priceCurrency").alias("currency"))

    all_ = F.transform(F.flatten(F.transform(blocks, held)), told)
    return F.try_element_at(F.filter(all_, lambda o: o["price"].isNotNull() | o["currency"].isNotNull()), F.lit(1))


def price_breakup(state: Column, version: Column) -> Column:
    """The JSON text of the first price entry of a version in a state's ``priceBreakup`` map."""
    map_ = F.from_json(F.get_json_object(state, "$.priceBreakup"), "map<string,string>")
    return F.get_json_object(F.try_element_at(map_, version), "$[0]")


_ITEM = "struct<itemName:string,value:string,renderedTemplates:map<string,string>>"
_MASTER = f"array<struct<name:string,subCategories:array<struct<name:string,items:array<{_ITEM}>>>>>"


def items(pages: DataFrame, key: str, trim: str = "trim") -> DataFrame:
    """(key, category, subcategory, at, name, value) of the specification tree in JSON texts:
    categories first, then the two summary lists, in their order."""
    value = lambda x: F.coalesce(F.nullif(F.trim(x["value"]), F.lit("")), F.try_element_at(F.filter(F.map_values(x["renderedTemplates"]), lambda v: v.isNotNull() & (F.trim(v) != "")), F.lit(1)))
    flat = lambda category, sub, xs: F.transform(F.coalesce(xs, F.expr(f"cast(array() as array<{_ITEM}>)")), lambda x: F.struct(category.alias("category"), sub.alias("subcategory"), x["itemName"].alias("name"), value(x).alias("value"), F.coalesce(F.map_values(x["renderedTemplates"]), F.array().cast("array<string>")).alias("rendered")))
    tree = F.from_json(F.get_json_object(trim, "$.specsFeaturesMaster"), _MASTER)
    none = F.expr("cast(array() as array<struct<category:string,subcategory:string,name:string,value:string,rendered:array<string>>>)")
    master = F.flatten(F.transform(tree, lambda c: F.flatten(F.transform(c["subCategories"], lambda s: flat(c["name"], s["name"], s["items"])))))
    lists = [flat(F.lit("versionDetail"), F.lit(n), F.from_json(F.get_json_object(trim, f"$.versionDetail.{n}"), f"array<{_ITEM}>")) for n in ("specsSummary", "featureSpecs")]
    every = F.concat(F.coalesce(master, none), *lists)
    return pages.select(key, F.posexplode(every).alias("at", "x")).select(key, "at", "x.*")


def looked_up(found: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """(key, field, value): for each field the first item with one of its labels.

    ``aliases`` (field, at, label) is a small table of fixed labels.  Exact names come before
    names or rendered texts that hold a label; then the item's and the label's place decide.
    """
    named = found.withColumn("__n", label(F.coalesce("name", F.lit("")))).withColumn("__r", F.transform("rendered", label))
    wanted = F.broadcast(aliases.select("field", F.col("at").alias("__a"), label(F.col("label")).alias("__l")))
    exact = named.join(wanted, F.col("__n") == F.col("__l")).select(key, "field", F.lit(1).alias("step"), "at", "__a", "value")
    part = named.join(wanted, F.col("__n").contains(F.col("__l")) | F.exists("__r", lambda t: t.contains(F.col("__l")))).select(key, "field", F.lit(2).alias("step"), "at", "__a", "value")
    first = F.min_by("value", F.struct("step", "at", "__a"))
    return exact.union(part).groupBy(key, "field").agg(first.alias("value"))


def assembled(looked: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """One row for each page: every field's text through its column expression over ``value``."""
    chosen = [F.max(F.when(F.col("field") == f, c)).alias(f) for f, c in fields.items()]
    return looked.groupBy(key).agg(*chosen)
