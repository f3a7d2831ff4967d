"""Merkle manifest of a dataset with parent-preimage paths.

A tree's nodes are SHA-256 digests as lowercase hex text.  A parent is the digest of its
children's digests, concatenated; that text, its preimage, is what is stored.  A leaf that
joins the preimages of its ancestors finds itself in a slot of 64 characters of the first, its
parent in a slot of the second, and so on up: what stands beside the slot are the siblings,
and a changed leaf is spliced into the slots one after the other to fold a new root.

Each language is a tree, and the languages' roots are the leaves of one more.  Places of
leaves come from counts of ranges of their order, so no task sees a whole language.  Trees
grow in tiers: ``FAN ** LEVELS`` consecutive nodes are a block, whose levels are array
expressions on one row, so a tier is one shuffle and 64 times smaller than the one below.
Paths go down the same tiers: a block takes what stands above it, and each of its nodes adds
its own ancestors in the block.  A hot language is many blocks, and all joins are by block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.session import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 2
LEVELS = 6
HEX = 64


@dataclass
class Manifest:
    """``leaves``: doc_id, tree, at, size, leaf, claim.  ``tiers``: tree, block, depth, preimages,
    left (nodes of the tree one tier up) of each tier from the leaves up.  ``roots``: tree, tier, subroot.  ``top``: the tiers of the
    tree of subroots (places in ``places``), ``root`` its one digest."""

    leaves: DataFrame
    tiers: list[DataFrame]
    roots: DataFrame
    places: DataFrame
    top: list[DataFrame]
    root: DataFrame


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    """The leaf of a document from its columns."""
    return F.sha2(F.concat(*(encoded(values[f]) for f in FIELDS)), 256)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``at``: the place of a row among those of its ``tree``, from 0; ``size``: how many these are.

    Ranges of (tree, order) are counted by tree, and a row's place is its place within its
    range after the ranges before.  Rows are written first, as ranges must not move meanwhile.
    """
    cut = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    cut = written(cut.withColumn("range", F.spark_partition_id()).withColumn("id", F.monotonically_increasing_id()), "merkle-places")
    runs = cut.groupBy("tree", "range").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    whole = Window.partitionBy("tree")  # a row for each range at most
    before = F.sum("n").over(whole.orderBy("range")) - F.col("n")
    runs = written(runs.select("tree", "range", "first", before.alias("before"), F.sum("n").over(whole).alias("size")), "merkle-ranges")
    return cut.join(runs, ["tree", "range"]).withColumn("at", F.col("before") + F.col("id") - F.col("first")).drop("range", "id", "first", "before")


def _grown(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """(tiers, roots) of the trees of ``nodes`` (tree, at, size, digest); size is of the whole tree."""
    width, tiers, most = fan**levels, [], nodes.agg(F.max("size").alias("n")).first().n or 0
    root = lambda: nodes.where("size = 1").select("tree", F.lit(len(tiers)).alias("tier"), F.col("digest").alias("subroot"))
    roots = root()
    while most > 1:
        held = nodes.where("size > 1").groupBy("tree", F.floor(F.col("at") / width).alias("block"), "size").agg(F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("m"))  # ``width`` of them
        held = held.withColumn("here", F.transform("m", lambda x: x["digest"])).drop("m").withColumn("left", F.col("size")).withColumn("depth", F.lit(0))
        for level in range(levels):
            goes = F.col("left") > 1
            parents = F.sequence(F.lit(0), F.floor((F.size("here") - 1) / fan).cast("int"))
            held = held.withColumn(f"p{level}", F.when(goes, F.transform(parents, lambda i: F.array_join(F.slice("here", i * fan + 1, fan), ""))).otherwise(F.array().cast("array<string>")))
            held = held.withColumn("here", F.when(goes, F.transform(f"p{level}", lambda x: F.sha2(x, 256))).otherwise(F.col("here")))
            held = held.withColumn("depth", F.col("depth") + goes.cast("int")).withColumn("left", F.ceil(F.col("left") / fan))
        held = held.select("tree", "block", "depth", F.array(*(f"p{level}" for level in range(levels))).alias("preimages"), F.col("here")[0].alias("digest"), "left")
        held = written(held, "merkle-tier")
        tiers.append(held.select("tree", "block", "depth", "preimages", "left"))
        nodes, most = held.select("tree", F.col("block").alias("at"), F.col("left").alias("size"), "digest"), -(-most // width)
        roots = roots.unionByName(root())
    return tiers, written(roots, "merkle-roots")


def _paths(nodes: list[DataFrame], tiers: list[DataFrame], above: DataFrame, carried: list[str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The bottom ``nodes`` with ``path`` and the ``carried`` columns of their tree.

    ``above`` (tree, tier, path, carried) says what stands over each tree's root, and at which
    tier the root is.  ``nodes[t]`` (tree, at, size) are the nodes of tier t, which are the blocks of
    tier t - 1; those of tier 0 may have more columns.
    """
    over = None
    for tier in reversed(range(len(tiers) + 1)):
        out = nodes[tier].where("size = 1").join(above.where(F.col("tier") == tier).drop("tier"), "tree")  # roots
        if tier < len(tiers):
            blocks = tiers[tier].drop("left").join(over.withColumnRenamed("at", "block"), ["tree", "block"])
            inside = F.pmod("at", F.lit(fan**levels)).cast("int")
            own = [F.struct(F.pmod(F.floor(inside / fan**i), F.lit(fan)).cast("int").alias("slot"), F.get(F.get("preimages", F.lit(i)), F.floor(inside / fan ** (i + 1)).cast("int")).alias("preimage")) for i in range(levels)]
            low = nodes[tier].withColumn("block", F.floor(F.col("at") / fan**levels)).join(blocks, ["tree", "block"])
            low = low.withColumn("path", F.concat(F.slice(F.array(*own), F.lit(1), F.col("depth")), "path")).drop("block", "depth", "preimages")
            out = low.unionByName(out)
        over = out.drop("size")
    return over


def excised(step: Column) -> Column:
    """The siblings' digests: a preimage without the 64 characters of its own slot."""
    begin = step["slot"] * HEX
    return F.concat(F.substring(step["preimage"], F.lit(1), begin), F.substring(step["preimage"], begin + HEX + 1, F.length(step["preimage"])))


def spliced(step: Column, digest: Column) -> Column:
    """A preimage with another digest in its own slot."""
    begin = step["slot"] * HEX
    return F.concat(F.substring(step["preimage"], F.lit(1), begin), digest, F.substring(step["preimage"], begin + HEX + 1, F.length(step["preimage"])))


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest folds to along its path."""
    return F.aggregate(path, digest, lambda d, step: F.sha2(spliced(step, d), 256))


def siblings(path: Column) -> Column:
    """All siblings' digests along a path, concatenated."""
    return F.array_join(F.transform(path, excised), "")


def manifest(documents: DataFrame, claims: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``documents``; ``claims`` are column expressions in place of columns, from
    which a second digest, ``claim``, is taken of every document (another copy's values, say).

    Leaves of a language ascend by ``doc_id``, null first, ties by digest; repeated rows are
    leaves of their own.  A null language is a tree, before all others.  Other columns are
    ignored; an empty table has no leaves, no roots and no root.
    """
    own = {f: F.col(f) for f in FIELDS}
    tree = F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit(""))  # ordered like the languages, null first
    rows = documents.select(F.col("doc_id"), tree.alias("tree"), leaf_digest(own).alias("leaf"), leaf_digest(own | (claims or {})).alias("claim"))
    rows = written(_placed(rows, ["doc_id", "leaf"]), "merkle-leaves")
    tiers, roots = _grown(rows.select("tree", "at", "size", F.col("leaf").alias("digest")))
    places = _placed(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "subroot", "tier"), ["name"])
    places = written(places, "merkle-languages")
    top, root = _grown(places.select("tree", "at", "size", F.col("subroot").alias("digest")))
    return Manifest(rows, tiers, roots, places, top, root)


def proofs(held: Manifest) -> DataFrame:
    """``doc_id, leaf, claim, subroot, root, path``: each leaf with its path of (slot, preimage) from its parent to the root."""
    none = F.expr("cast(array() as array<struct<slot:int,preimage:string>>)")
    at_top = held.root.select("tree", "tier", none.alias("path"), F.col("subroot").alias("root"))
    langs = held.places.select("tree", "at", "size", "name", "subroot", F.col("tier").alias("ends"))
    upper = lambda tiers: [t.select("tree", F.col("block").alias("at"), F.col("left").alias("size")) for t in tiers]
    over = _paths([langs, *upper(held.top)], held.top, at_top, ["root"])
    over = written(over.select(F.col("name").alias("tree"), F.col("ends").alias("tier"), "path", "subroot", "root"), "merkle-over")
    return _paths([held.leaves, *upper(held.tiers)], held.tiers, over, ["subroot", "root"]).select("doc_id", "leaf", "claim", "subroot", "root", "path")


def audited(held: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: whether each claim folds to the root."""
    root = folded(F.col("path"), F.col("claim"))
    out = proofs(held).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(doc_id: Column, n_chars: Column) -> Column:
    """``n_chars`` with 1 added where 7 divides the CRC-32 of the id's decimal digits."""
    more = (n_chars.cast("decimal(20,0)") + 1).cast("string")  # the greatest long has a successor too
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, more).otherwise(n_chars.cast("string"))


def digest(documents: DataFrame) -> DataFrame:
    """The contract's rows: the audit of ``documents`` against a copy with tampered ``n_chars``."""
    return audited(manifest(documents, {"n_chars": tampered(F.col("doc_id"), F.col("n_chars"))}))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS id, lang, doc_id, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
  FROM documents
), w AS (
  SELECT id, lang, doc_id, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n AS VARCHAR)) || ':' || n, '-') || tail) AS claim
  FROM (SELECT *, n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS n FROM v)
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM w
), l(lang, level, pos, n, digest) AS (
  SELECT lang, 0, pos, count(*) OVER (PARTITION BY lang), leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM l WHERE n > 1 GROUP BY lang, level, pos // 2, n
), subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM l WHERE n = 1
), m(level, pos, n, digest) AS (
  SELECT 0, pos, count(*) OVER (), subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM m WHERE n > 1 GROUP BY level, pos // 2, n
), p AS (
  SELECT id, x.level AS step, (leaves.pos >> x.level) & 1 AS slot, s.digest AS sibling
  FROM leaves JOIN (SELECT DISTINCT lang, level FROM l WHERE n > 1) x ON leaves.lang IS NOT DISTINCT FROM x.lang
    LEFT JOIN l s ON s.lang IS NOT DISTINCT FROM x.lang AND s.level = x.level AND s.pos = xor(leaves.pos >> x.level, 1)
  UNION ALL
  SELECT id, depth + x.level, (r.pos >> x.level) & 1, s.digest
  FROM leaves JOIN subroots r ON leaves.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT lang, max(level) AS depth FROM l GROUP BY lang) d ON leaves.lang IS NOT DISTINCT FROM d.lang
    CROSS JOIN (SELECT DISTINCT level FROM m WHERE n > 1) x LEFT JOIN m s ON s.level = x.level AND s.pos = xor(r.pos >> x.level, 1)
), f(id, step, digest) AS (
  SELECT id, CAST(0 AS BIGINT), claim FROM leaves
  UNION ALL
  SELECT f.id, CAST(f.step + 1 AS BIGINT), sha256(CASE WHEN slot = 0 THEN digest || coalesce(sibling, '') ELSE sibling || digest END) FROM f JOIN p ON f.id = p.id AND f.step = p.step
), proof AS (SELECT id, string_agg(sibling, '' ORDER BY step) AS s FROM p GROUP BY id
), ends AS (SELECT id, max_by(digest, step) AS folded_root FROM f GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(s, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots r ON leaves.lang IS NOT DISTINCT FROM r.lang CROSS JOIN (SELECT digest AS root FROM m WHERE n = 1) LEFT JOIN proof ON leaves.id = proof.id JOIN ends ON leaves.id = ends.id
"""
