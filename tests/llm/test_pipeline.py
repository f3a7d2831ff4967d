"""The corpus pipeline over a small table against its stages done plainly."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from veldspar.llm import near_dups, toxicity  # noqa: E402
from veldspar.llm import words as W  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with toxic ones, exact and near copies, benchmark passages, odd rows."""
    r, at = random.Random(41), tmp_path_factory.mktemp("pipeline")
    items = [(i, prose(r, 25)) for i in range(3)]
    texts = [prose(r, 60) for _ in range(120)]
    rows = [(i, t + (" dreadful vile insult" if i % 5 == 0 else "")) for i, t in enumerate(texts)]
    rows += [(200 + i, texts[i]) for i in (1, 2, 3)] + [(210 + i, texts[i].replace(texts[i].split()[30], "edited", 1)) for i in (6, 7)]
    rows += [(220 + i, prose(r, 30) + " " + items[i][1] + " " + prose(r, 30)) for i in range(3)] + [(300, None), (301, ""), (302, "!!"), (303, items[0][1])]
    docs = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t or "")) for i, t in rows]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(120)]
    for name, held, kind in (("documents", docs, DOC), ("benchmark", items, "item_id long, text string"), ("labels", labels, "doc_id long, quality int, toxic int")):
        spark.createDataFrame(held, kind).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at), docs, items


def test_stages_one_by_one(spark, folder):
    at, docs, items = folder
    rows = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.train(rows, spark.read.parquet(f"{at}/labels.parquet"))
    score = toxicity._scorer(model)
    want = [d for d in docs if score(pa.array([d[1]], pa.string()))[0] < toxicity.THRESHOLD]
    assert {d[0] for d in docs if d[0] < 120 and d[0] % 5 == 0}.isdisjoint(d[0] for d in want) and len(want) > 100
    (_, toxic), (_, near), (_, clean), (_, mix), (_, ids) = corpus_pipeline.STAGES
    rows = toxic(spark, rows, at)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))

    held = [W.split(pa.array([d[1]], pa.string())).hashes for d in want]
    top = {i: i for i in range(len(want))}

    def least(i):
        return i if top[i] == i else least(top[i])

    for i, a in enumerate(held):
        for j in range(i):
            if len(a) and len(held[j]) and near_dups.similar(a, held[j]):
                x, y = least(i), least(j)
                top[max(x, y, key=lambda k: want[k][0])] = min(x, y, key=lambda k: want[k][0])
    want = [d for i, d in enumerate(want) if least(i) == i]
    rows = near(spark, rows, at)
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))

    def cut(text):
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text or "")]
        words = [(text[a:b]).lower() for a, b in spans]
        hit = [False] * len(words)
        for _, item in items:
            v = item.lower().split()
            for j in range(len(v) - 9):
                for k in range(len(words) - 9):
                    if words[k : k + 10] == v[j : j + 10]:
                        hit[k : k + 10] = [True] * 10
        if sum(hit) > 0.5 * len(words):
            return None, False
        out, left = "", 0
        for k in range(len(words)):
            if hit[k]:
                out += text[left : spans[k][0]] if not (k and hit[k - 1]) else ""
                left = spans[k][1]
        return (out + text[left:] if text is not None else None), True

    want = [(i, cut(t)[0], lang, s, len(cut(t)[0]) if t is not None else n) for i, t, lang, s, n in want if cut(t)[1]]
    rows = clean(spark, rows, at)
    got = {x.doc_id: (x.text, x.lang, x.source) for x in rows.collect()}
    assert got == {w[0]: w[1:4] for w in want} and 303 not in got and all(items[0][1] not in (t or "") for t, *_ in got.values())

    size = {d[0]: len((d[1] or "").split()) for d in want}
    drawn = Counter(x.doc_id for x in mix(spark, rows, at).collect())
    by = {s: [d[0] for d in want if d[3] == s] for s in {d[3] for d in want}}
    total, weights = sum(size.values()), dict(zip(sorted(by, key=lambda s: (s is None, s or "")), (1, 2, 3, 1), strict=True))
    goal, full = {}, set()
    while True:  # water filling, source by source
        rest = total - sum(3 * sum(map(size.get, by[s])) for s in full)
        goal = {s: 3 * sum(map(size.get, by[s])) if s in full else rest * weights[s] / sum(weights[x] for x in by if x not in full) for s in by}
        more = {s for s in by if s not in full and goal[s] > 3 * sum(map(size.get, by[s]))}
        if not more:
            break
        full |= more
    assert max(drawn.values()) <= 3 and all(abs(sum(drawn[i] * size[i] for i in by[s]) - goal[s]) <= max(size.values()) for s in by)


def test_run_encodes_what_the_stages_keep(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for x in docs.collect():
        ids = [*library.encode(x.text or "", add_special_tokens=False).ids, 2]
        want[x.doc_id, len(ids), crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, at).collect()
    assert Counter((x.doc_id, x.n_tokens, x.ids_crc32) for x in got) == want
    ordered = sorted(got, key=lambda x: x.start)
    assert [x.start for x in ordered] == [0, *np.cumsum([x.n_tokens for x in ordered])[:-1].tolist()] and [x.doc_id for x in ordered] == sorted(x.doc_id for x in got)


def test_run_of_empty_tables(spark, tmp_path):
    for name, kind in (("documents", DOC), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
