"""The Merkle manifest against a plain version."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from veldspar.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, tree int, path string, size string"


def h(text):
    return sha256(text.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, more=0):
    i, text, lang, source, n = d[:5]
    return h("".join(map(enc, (i, source, lang, None if n is None else n + more, text))))


def levels(row, fan):
    out = [row]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def climb(at, tree, fan):
    """(siblings, folding function) of a leaf in a tree of levels."""
    sides = []
    for row in tree[:-1]:
        first = at // fan * fan
        sides.append((row[first:at], row[at + 1 : first + fan]))
        at //= fan
    return sides


def plain(docs, fan=2):
    by = {}
    for d in docs:
        by.setdefault(d[2], []).append(d)
    key = lambda d: (d[0] is not None, d[0] or 0, leaf(d))
    trees = {k: (sorted(v, key=key), levels([leaf(d) for d in sorted(v, key=key)], fan)) for k, v in by.items()}
    langs = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    top = levels([trees[k][1][-1][0] for k in langs], fan)
    out = []
    for k in langs:
        for at, d in enumerate(trees[k][0]):
            sides = climb(at, trees[k][1], fan) + climb(langs.index(k), top, fan)
            got = leaf(d, 1 if d[0] is not None and crc32(str(d[0]).encode()) % 7 == 0 else 0)
            for left, right in sides:
                got = h("".join([*left, got, *right]))
            proof = h("".join("".join([*a, *b]) for a, b in sides))
            out.append((d[0], leaf(d), trees[k][1][-1][0], top[-1][0], proof, got, got == top[-1][0]))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    sizes = {"en": 300, "de": 65, "é": 64, "zz": 1, "": 2, None: 3, "z": 5}
    out = [(i, r.choice(["", None, "né " * r.randint(0, 40), "x" * 70_000 if r.random() < 0.02 else "y"]), lang, r.choice([None, "", "s:1"]), r.choice([None, 0, r.randint(-5, 10**6)])) for lang, n in sizes.items() for i in r.sample(range(10**6), n)]
    out += [(None, "a", "en", None, 1), (None, "a", "en", None, 1), (7, "t", "de", "s", 1), (7, "t", "de", "s", 1), (7, "u", "de", "s", 1), (14, "a", "en", None, 2**63 - 1)]
    return out


def test_audit_equals_plain_trees(spark, docs):
    df = spark.createDataFrame([(*d, 1, "p", "q") for d in docs], DOC)
    want = plain(docs)
    assert rows(merkle.digest(df)) == want
    assert {x[6] for x in want} == {True, False}


def test_one_leaf_one_language_and_none(spark):
    one = [(5, "text", "en", "s", 4)]
    assert rows(merkle.digest(spark.createDataFrame([(*d, 1, "p", "q") for d in one], DOC))) == plain(one)
    assert rows(merkle.digest(spark.createDataFrame([], DOC))) == []


def test_wider_runs(spark, docs):
    """Runs of three: slots of 64 characters in longer preimages."""
    nodes = spark.createDataFrame([("a", i, 50, h(str(i))) for i in range(50)] + [("b", 0, 1, h("b"))], "tree string, at long, size long, digest string")
    tiers, roots = merkle._grown(nodes, fan=3, levels=2)
    tree = levels([h(str(i)) for i in range(50)], 3)
    assert {x.tree: x.subroot for x in roots.collect()} == {"a": tree[-1][0], "b": h("b")} and len(tiers) == 2
    over = roots.select("tree", "tier", merkle.F.expr("cast(array() as array<struct<slot:int,preimage:string>>)").alias("path"), "subroot")
    upper = [t.select("tree", merkle.F.col("block").alias("at"), merkle.F.col("left").alias("size")) for t in tiers]
    got = merkle._paths([nodes, *upper], tiers, over, ["subroot"], 3, 2).select("at", merkle.folded(merkle.F.col("path"), merkle.F.col("digest")).alias("f"), "subroot", merkle.siblings(merkle.F.col("path")).alias("s"), "tree").collect()
    assert len(got) == 51 and all(x.f == x.subroot for x in got)
    assert all(x.s == "".join("".join([*a, *b]) for a, b in climb(x["at"], tree, 3)) for x in got if x.tree == "a")


def test_a_manifest_tells_which_copy_differs(spark, docs):
    df = spark.createDataFrame([(*d, 1, "p", "q") for d in docs[:80]], DOC)
    held = merkle.manifest(df, {"text": merkle.F.when(merkle.F.col("doc_id") == docs[3][0], "changed").otherwise(merkle.F.col("text"))})
    assert {x.doc_id for x in merkle.audited(held).where("not verified").collect()} == {docs[3][0]}
