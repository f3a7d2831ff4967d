"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Each source gets a target: its weight's share of all words, capped at ``MAX_REPEATS``
   times its size, the excess going to the others by weight (water filling in closed form
   over the table of sources).
2. A source's documents are dealt into about sqrt(n) blocks by a hash.  The mix takes the
   whole source ``floor(target / size)`` times and, of one more pass, blocks in permuted
   order until the target is reached; the last block is cut at the document that comes
   nearest.  The numbers of blocks are the source's quota.
3. A binary tree splits the quotas of all sources among the output shards: each node gives
   its left child half of its blocks, how many of each source being a multivariate
   hypergeometric draw (as if the blocks were drawn blindly from one urn).  Draws are
   inverse-CDF with hashed uniforms, so reruns agree.
4. A shard draws its quota of each source as disjoint runs of that source's permuted
   blocks, and shuffles its rows locally by a hash.

Everything is DataFrame expressions.  Hot sources are split by their blocks: both the
block table of a source and the documents of a block grow as the square root of the
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm import words as W
from veldspar.session import written

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
SHARDS = 8
SHARD_ROWS = 1_000_000


def _sized(documents: DataFrame, seed: int) -> DataFrame:
    """The input with its size, source key (null has its own) and permutation hash (by the text where the id is null)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    return (
        documents.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint"))
        .withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("z")))
        .withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), name)))
    )


def shards_for(rows: int) -> int:
    """A power of two with about ``SHARD_ROWS`` rows a shard, ``SHARDS`` at least."""
    return max(SHARDS, 1 << max(0, -(-rows // SHARD_ROWS) - 1).bit_length())


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), blocks)


def targets(sized: DataFrame) -> DataFrame:
    """``__key, source_size, n, blocks, target, passes, rest`` of each source."""
    per = sized.groupBy("__key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("__key")) - 1  # 'z' (null) sorts after every 's...'
    per = per.withColumn("weight", (F.pmod(place, F.lit(3)) + 1).cast("double")).withColumn("cap", F.col("source_size") * float(MAX_REPEATS))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "__key")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    free = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct(F.col("cap") / F.col("weight"), "__key", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.coalesce(free * F.col("weight"), F.col("cap")), F.col("cap"))
    out = per.withColumn("target", target).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.sqrt("n"))).cast("bigint"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    out = out.withColumn("passes", F.least(F.lit(MAX_REPEATS), passes).cast("int"))
    return out.withColumn("rest", F.when(F.col("passes") < MAX_REPEATS, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(F.lit(0.0))).select("__key", "source_size", "blocks", "target", "passes", "rest")


def _drawn(good: Column, others: Column, draws: Column, u: Column) -> Column:
    """A hypergeometric draw: how many of ``draws`` blocks, from ``good + others``, are good.

    Weights run out from the mode by the ratio of neighbouring terms, over 12 standard
    deviations (all that doubles can tell from 0), and ``u`` picks by cumulated weight.
    """
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def at(s: Column) -> Column:
        g, o, n = s["g"], s["o"], s["n"]
        total = g + o
        lo, hi = F.greatest(F.lit(0).cast("bigint"), n - o), F.least(n, g)
        mode = F.greatest(lo, F.least(hi, F.floor((n + 1) * (g + 1) / (total + 2.0)).cast("bigint")))
        width = F.ceil(12 * F.sqrt(F.greatest(F.lit(0.0), n * (g / total) * (o / total)))).cast("bigint") + 12
        bounds = F.struct(F.greatest(lo, mode - width).alias("a"), F.least(hi, mode + width).alias("b"), mode.alias("m"), g.alias("g"), o.alias("o"), n.alias("n"))

        def spread(v: Column) -> Column:
            step = lambda up: lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) * up(k)))
            more = lambda k: (v["g"] - k) * (v["n"] - k) / ((k + 1.0) * (v["o"] - v["n"] + k + 1))
            less = lambda k: k * (v["o"] - v["n"] + k) / ((v["g"] - k + 1.0) * (v["n"] - k + 1))
            none = F.expr("cast(array() as array<bigint>)")
            above = F.aggregate(F.when(v["b"] > v["m"], F.sequence(v["m"], v["b"] - 1)).otherwise(none), F.array(F.lit(1.0)), step(more))
            below = F.aggregate(F.when(v["m"] > v["a"], F.sequence(v["m"], v["a"] + 1, F.lit(-1).cast("bigint"))).otherwise(none), F.array(F.lit(1.0)), step(less))
            weights = F.concat(F.reverse(below), F.slice(above, 2, F.greatest(F.lit(0), F.size(above) - 1)))
            return let(F.struct(weights.alias("w"), v["a"].alias("a")), pick)

        def pick(v: Column) -> Column:
            whole = F.aggregate(v["w"], F.lit(0.0), lambda s, x: s + x)
            start = F.struct(F.lit(0.0).alias("c"), F.lit(0).cast("bigint").alias("k"))
            walked = F.aggregate(v["w"], start, lambda s, x: F.struct((s["c"] + x).alias("c"), (s["k"] + F.when(s["c"] + x < u * whole, 1).otherwise(0)).cast("bigint").alias("k")))
            return v["a"] + F.least(walked["k"], (F.size(v["w"]) - 1).cast("bigint"))

        return F.when((total == 0) | (n == 0), F.lit(0).cast("bigint")).otherwise(let(bounds, spread))

    return let(F.struct(good.cast("bigint").alias("g"), others.cast("bigint").alias("o"), draws.cast("bigint").alias("n")), at)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, __key, quota``: the splitting tree over (__key, quota) rows; ``shards`` a power of two."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("__key", F.col("quota").cast("bigint").alias("quota")))).alias("held")).withColumn("node", F.lit(1))
    for _ in range(shards.bit_length() - 1):
        total = F.aggregate("held", F.lit(0).cast("bigint"), lambda s, x: s + x["quota"])
        nodes = nodes.withColumn("__all", total)
        start = F.struct(F.col("__all").alias("left"), F.floor(F.col("__all") / 2).cast("bigint").alias("draws"), F.expr("cast(array() as array<bigint>)").alias("got"))

        def one(s: Column, x: Column) -> Column:
            digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string"), F.lit(":"), x["__key"])), 1, 12)
            k = _drawn(x["quota"], s["left"] - x["quota"], s["draws"], F.conv(digits, 16, 10).cast("double") / float(1 << 48))
            return F.transform(F.array(k), lambda v: F.struct((s["left"] - x["quota"]).alias("left"), (s["draws"] - v).alias("draws"), F.concat(s["got"], F.array(v)).alias("got")))[0]

        nodes = nodes.withColumn("__got", F.aggregate("held", start, one)["got"])
        left = F.zip_with("held", "__got", lambda h, k: F.struct(h["__key"].alias("__key"), k.alias("quota")))
        right = F.zip_with("held", "__got", lambda h, k: F.struct(h["__key"].alias("__key"), (h["quota"] - k).alias("quota")))
        pair = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("held")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("held"))))
        nodes = nodes.select(pair.alias("p")).select("p.node", "p.held")
    return nodes.select((F.col("node") - shards).alias("shard"), F.explode("held").alias("h")).select("shard", F.col("h.__key").alias("__key"), F.col("h.quota").alias("quota"))


def block_plan(sized: DataFrame, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The table of sources, and ``__key, block, ahead, shards`` of blocks.

    ``ahead``: words of the source's blocks before this one in permuted order; ``shards``:
    the shard of each of the block's draws, one per pass that takes it.
    """
    meta = written(sized.select("__key", "size", "__h"), "mix-sizes")
    sources = written(targets(meta), "mix-sources")
    per_block = meta.join(sources.select("__key", "blocks"), "__key").groupBy("__key", _block(F.col("__h"), F.col("blocks")).alias("block")).agg(F.sum("size").alias("words"))
    dealt = per_block.withColumn("__b", F.md5(F.concat(F.lit(f"{seed}:b:"), "__key", F.lit(":"), F.col("block").cast("string"))))
    order = Window.partitionBy("__key").orderBy("__b", "block")
    dealt = dealt.withColumn("ahead", F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = written(dealt.join(sources.select("__key", "passes", "rest"), "__key"), "mix-blocks")
    draws = dealt.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).where((F.col("pass") < F.col("passes")) | ((F.col("ahead") < F.col("rest")) & (F.col("passes") < MAX_REPEATS)))
    draws = draws.withColumn("__i", F.row_number().over(Window.partitionBy("__key").orderBy(F.md5(F.concat("__b", F.col("pass").cast("string"))), "block", "pass")) - 1)
    leaves = split_quotas(draws.groupBy("__key").agg(F.count("*").alias("quota")), shards, seed)
    runs = leaves.withColumn("hi", F.sum("quota").over(Window.partitionBy("__key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))).groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("hi", "shard"))).alias("runs"))
    shard = F.filter("runs", lambda r: r["hi"] > F.col("__i"))[0]["shard"]
    placed = draws.join(runs, "__key").select("__key", "block", F.struct("pass", shard.alias("shard")).alias("d"))
    placed = placed.groupBy("__key", "block").agg(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["shard"]).alias("shards"))
    blocks = dealt.select("__key", "block", "ahead").join(placed, ["__key", "block"], "left")
    return sources, written(blocks.withColumn("shards", F.coalesce("shards", F.expr("cast(array() as array<int>)"))), "mix-plan")


def _mixed(held: DataFrame, shards: int | None, seed: int) -> DataFrame:
    """Renamed rows (see ``W.set_aside``) with ``size, source_size, target, shards``."""
    names = held.columns
    sized = _sized(held, seed)
    sources, blocks = block_plan(sized, shards or shards_for(held.count()), seed)
    rows = sized.join(sources, "__key").withColumn("block", _block(F.col("__h"), F.col("blocks")))
    inside = Window.partitionBy("__key", "block").orderBy("__h", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(blocks.select("__key", "block", F.col("ahead").alias("__ahead"), F.col("shards").alias("__draws")), ["__key", "block"])
    more = (F.col("passes") < MAX_REPEATS) & (F.col("__ahead") + F.col("__before") + F.col("size") / 2 <= F.col("rest"))
    copies = F.slice("__draws", 1, F.col("passes") + F.when(more, 1).otherwise(0))
    return rows.select(*names, "size", "source_size", "target", copies.alias("shards"))


def mixed(documents: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """The input's columns with ``size, source_size, target, shards``.

    ``shards`` lists the output shard of each copy that the mix takes of the row; its length
    is the number of copies, 0 to ``MAX_REPEATS``.  A null text has size 0; a null source is
    a source; null ids are told apart by their texts; repeated rows count as rows; an empty
    table gives no rows; extra columns keep their values, but those of the four names above
    are replaced.
    """
    held, columns = W.set_aside(documents, ("doc_id", "text", "source"))
    found = ["size", "source_size", "target", "shards"]
    return _mixed(held, shards, seed).select(*(c for c, n in zip(columns, documents.columns, strict=True) if n not in found), *found)


def draw(documents: DataFrame, shards: int | None = None, seed: int = 7) -> DataFrame:
    """The mix itself: each taken copy a row with the input's columns, dealt to its shard and
    shuffled there by a hash; cases as in :func:`mixed`, and all extra columns keep their values."""
    held, columns = W.set_aside(documents, ("doc_id", "text", "source"))
    rows = _mixed(held, shards, seed).select(*held.columns, F.posexplode("shards").alias("__copy", "__shard"))
    key = F.xxhash64(F.lit(seed), "doc_id", "text", "__copy")
    return rows.withColumn("__at", key).repartition("__shard", F.pmod("__at", F.lit(64))).sortWithinPartitions("__shard", "__at").select(*columns)


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "size", "source_size", "target", (F.size("shards") * F.col("size")).cast("bigint").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'z') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS h FROM documents
), p AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n, CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS DOUBLE) AS weight,
         sum(size) * 3.0::DOUBLE AS cap FROM d GROUP BY key
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM p
), t AS (
  SELECT *, least(coalesce((SELECT arg_min(level, (cap / weight, key)) FROM l WHERE cap / weight > level) * weight, cap), cap) AS target,
         greatest(1, ceil(sqrt(n)))::BIGINT AS blocks FROM l
), s AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::INT AS passes FROM t
), r AS (SELECT *, CASE WHEN passes < 3 THEN target - passes * source_size ELSE 0 END AS rest FROM s
), b AS (
  SELECT d.*, source_size, target, passes, rest, CAST('0x' || substr(h, 1, 8) AS BIGINT) % blocks AS block FROM d JOIN r USING (key)
), c AS (
  SELECT key, block, coalesce(sum(w) OVER (PARTITION BY key ORDER BY md5('7:b:' || key || ':' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM (SELECT key, block, sum(size) AS w FROM b GROUP BY 1, 2)
), x AS (
  SELECT b.*, ahead + coalesce(sum(size) OVER (PARTITION BY b.key, b.block ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b JOIN c ON b.key = c.key AND b.block = c.block
)
SELECT doc_id, size, source_size, target, CAST((passes + CASE WHEN passes < 3 AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x
"""
