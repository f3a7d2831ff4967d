"""Benchmark decontamination with a generalised suffix automaton.

Test items are lower-cased, split into words and put into one automaton whose states
know which items contain them.  Training texts stream through it; at each word the
automaton holds the longest suffix that occurs in an item, and wherever that reaches
``window`` words the words under it are hit.  An item shorter than the window counts as
one window of its own length.

A word pair that occurs in no item ends every match, so only stretches whose pairs all
occur in items are streamed; this loses nothing and leaves the rest of the corpus to a
few vectorised steps.  Documents are never shuffled.  Items are dealt into blocks of a
bounded number of words, one automaton each, which every worker builds for itself; a pass
over the documents carries a bounded number of blocks, and further blocks take further
passes, one after the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm import words as W
from veldspar.session import written

BLOCK_WORDS = 100_000
BLOCKS_PER_PASS = 2


class Automaton:
    """Generalised suffix automaton over word hashes; items are given as hash lists."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, tokens in items:
            last = 0
            for t in tokens:
                last = self._extend(last, t)
        self.owners: dict[int, set[str]] = {}
        self.whole: dict[int, list[tuple[int, str]]] = {}
        pairs, single, least = [], [], window
        for name, tokens in items:
            if not tokens:
                continue
            least = min(least, len(tokens))
            state = 0
            for i, t in enumerate(tokens):
                state = self.next[state][t]
                if i + 1 >= window:
                    state = self._shrunk(state)
                    self.owners.setdefault(state, set()).add(name)
            if len(tokens) < window:
                self.whole.setdefault(state, []).append((len(tokens), name))
            if len(tokens) == 1:
                single.append(np.array(tokens, np.uint64))
            pairs.append(W.windows(np.array(tokens, np.uint64), 2))
        self.least = least
        self.single = np.unique(np.concatenate([*single, np.zeros(0, np.uint64)]))
        self.pairs = np.unique(np.concatenate([*pairs, np.zeros(0, np.uint64)]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def _extend(self, last: int, t: int) -> int:
        if t in self.next[last]:
            q = self.next[last][t]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, q, t)
        cur = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and t not in self.next[p]:
            self.next[p][t] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][t]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, q, t)
        return cur

    def _clone(self, p: int, q: int, t: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(t) == q:
            self.next[p][t] = new
            p = self.link[p]
        return new

    def _shrunk(self, state: int) -> int:
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, tokens: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end position, matched length, items) wherever a window ends."""
        state, length = 0, 0
        for i, t in enumerate(tokens):
            while state and t not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if t in self.next[state]:
                state = self.next[state][t]
                length += 1
            if length >= self.window and (got := self.owners.get(self._shrunk(state))):
                yield i, self.window, got
            if self.whole:
                s = state
                while s > 0:
                    for size, name in self.whole.get(s, ()):
                        if size <= length:
                            yield i, size, {name}
                    s = self.link[s]

    def stretches(self, w: W.Words) -> list[tuple[int, int]]:
        """Word ranges outside which no window can lie; each within one row."""
        found = []
        if len(self.pairs) and len(w.hashes) > 1:
            pair = W.windows(w.hashes, 2)
            hit = self.maybe[(pair & np.uint64((1 << 20) - 1)).astype(np.int64)]
            hit &= w.rows[1:] == w.rows[:-1]
            at = np.flatnonzero(hit)
            at = at[self.pairs[np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)] == pair[at]]
            if len(at):
                gap = np.flatnonzero((np.diff(at) != 1) | (np.diff(w.rows[at]) != 0))
                a, b = at[np.r_[0, gap + 1]], at[np.r_[gap, len(at) - 1]] + 2
                keep = b - a >= min(self.least, self.window)
                found += zip(a[keep].tolist(), b[keep].tolist(), strict=True)
        if len(self.single) and len(w.hashes):
            at = np.flatnonzero(np.isin(w.hashes, self.single))
            found += [(i, i + 1) for i in at.tolist()]
        return found


def _passes(benchmark: DataFrame) -> Iterator[tuple[str, list]]:
    """(name, blocks) of each pass; a block lists (item, text) with a bounded number of words."""
    size = F.coalesce(F.length("text"), F.lit(0)) / 2 + 1
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    blocks = max(1, int(-(-(items.agg(F.sum(size)).first()[0] or 0) // BLOCK_WORDS)))
    for a in range(0, blocks, BLOCKS_PER_PASS):
        own = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")
        rows = items.withColumn("block", own).where(F.col("block").between(a, a + BLOCKS_PER_PASS - 1)).collect()  # about BLOCKS_PER_PASS * BLOCK_WORDS words
        yield uuid.uuid4().hex, [[(r.item, r.text) for r in rows if r.block == b] for b in range(a, min(a + BLOCKS_PER_PASS, blocks))]


_built: dict[tuple, list[Automaton]] = {}


def _automata(name: str, blocks: list, window: int) -> list[Automaton]:
    """The automata of a pass, built once by each worker, which keeps those of one pass only."""
    if (name, window) not in _built:
        _built.clear()
        out = []
        for block in blocks:
            w = W.split(pa.array([t for _, t in block], pa.string()))
            out.append(Automaton([(item, w.hashes[w.first[i] : w.first[i + 1]].tolist()) for i, (item, _) in enumerate(block)], window))
        _built[name, window] = out
    return _built[name, window]


def _found(w: W.Words, automata: list[Automaton]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Hit words, and the items that each row holds."""
    hit, items = np.zeros(len(w.hashes), bool), {}
    for auto in automata:
        for begin, end in auto.stretches(w):
            for i, size, names in auto.stream(w.hashes[begin:end].tolist()):
                hit[begin + i + 1 - size : begin + i + 1] = True
                items.setdefault(int(w.rows[begin]), set()).update(n for n in names if n is not None)
    return hit, items


_SPAN = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))


def _runs(hit: np.ndarray, w: W.Words, r: int) -> list[tuple[int, int]]:
    """Maximal hit runs of a row, as word indexes within the row."""
    edge = np.diff(np.r_[False, hit[w.first[r] : w.first[r + 1]], False].astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, finish, schema) -> DataFrame:
    """``docs`` through all automata; ``finish(batch, words, hit, items)`` makes the last pass's rows.

    A pass holds a bounded number of blocks.  What it has marked is written beside the rows to
    the shared folder before the next begins, so driver and workers hold one pass at a time.
    """
    names, session = docs.columns, docs.sparkSession.sparkContext
    between = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "__marks array<struct<b:bigint,e:bigint>>", "__items array<string>"])
    passes, first = _passes(benchmark), True
    held = next(passes)
    while held is not None:
        after = next(passes, None)
        shared = session.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=after is None) -> Iterator[pa.RecordBatch]:
            automata = _automata(*shared.value, window)
            for batch in batches:
                for part in W.chunks(batch, "text"):
                    w = W.split(part.column("text"))
                    hit, items = _found(w, automata)
                    if not first:
                        marks, held = part.column("__marks").to_pylist(), part.column("__items").to_pylist()
                        for r, m in enumerate(marks):
                            for x in m:
                                hit[w.first[r] + x["b"] : w.first[r] + x["e"]] = True
                            if held[r]:
                                items.setdefault(r, set()).update(held[r])
                    if last:
                        yield finish(part, w, hit, items)
                        continue
                    marks = [[{"b": a, "e": b} for a, b in _runs(hit, w, r)] for r in range(part.num_rows)]
                    held = [sorted(items.get(r, ())) for r in range(part.num_rows)]
                    cols = [*(part.column(c) for c in names), pa.array(marks, _SPAN), pa.array(held, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(cols, names=[*names, "__marks", "__items"])

        docs = docs.mapInArrow(run, schema if after is None else between)
        if after is not None:
            docs = written(docs, "decontaminate-pass")
            shared.destroy()
        held, first = after, False
    return docs


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document what of it occurs in test items.

    Returns ``doc_id, n_words, n_hit, spans, items``: ``spans`` are the maximal hit word
    runs as byte ranges of the UTF-8 text, ``items`` the distinct item ids as strings,
    sorted.  A null or empty text has no words; a null item text has no windows; words of an
    item without an id are hit like others, but it is in no list; repeated rows are judged one by one; an empty benchmark hits nothing; no documents give
    no rows.  Extra columns are ignored.
    """
    out_type = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.string()))])

    def finish(part, w, hit, items):
        n = part.num_rows
        n_hit = np.bincount(w.rows[hit], minlength=n)
        spans: list[list] = [[] for _ in range(n)]
        for r in np.flatnonzero(n_hit).tolist():
            a, base = w.first[r], w.offsets[r]
            spans[r] = [{"b": int(w.begin[a + i] - base), "e": int(w.end[a + j - 1] - base)} for i, j in _runs(hit, w, r)]
        cols = [part.column("doc_id").cast(pa.int64()), pa.array(np.diff(w.first)), pa.array(n_hit), pa.array(spans, _SPAN), pa.array([sorted(items.get(r, ())) for r in range(n)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, schema=out_type)

    schema = "doc_id bigint, n_words bigint, n_hit bigint, spans array<struct<b:bigint,e:bigint>>, items array<string>"
    return _judged(documents.select("doc_id", "text"), benchmark, window, finish, schema)


def cleaned(documents: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """Documents without the test passages, in the columns of ``documents``.

    Hit spans are cut from the text; a document of whose words more than ``max_coverage``
    are hit goes altogether.  Documents without a hit pass unchanged, null and empty texts
    included; repeated rows are cut alike; extra columns of any name keep their values, but
    ``n_chars``, where present, follows the text; an empty table gives no rows.
    """
    held, columns = W.set_aside(documents, ("text",))
    names = held.columns

    def finish(part, w, hit, items):
        part = part.select(names) if part.num_columns > len(names) else part
        n_hit = np.bincount(w.rows[hit], minlength=part.num_rows)
        if not n_hit.any():
            return part
        texts, keep = part.column("text").to_pylist(), n_hit <= max_coverage * np.diff(w.first)
        for r in np.flatnonzero((n_hit > 0) & keep).tolist():
            base, a, left, kept = w.offsets[r], w.first[r], 0, []
            whole = w.data[base : w.offsets[r + 1]]
            for i, j in _runs(hit, w, r):
                kept.append(whole[left : w.begin[a + i] - base].tobytes())
                left = w.end[a + j - 1] - base
            kept.append(whole[left:].tobytes())
            texts[r] = b"".join(kept).decode("utf-8")
        cols = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in names]
        return pa.RecordBatch.from_arrays(cols, schema=part.schema).filter(pa.array(keep))

    out = _judged(held, benchmark, window, finish, held.schema).select(*columns)
    if "n_chars" not in documents.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(dict(documents.dtypes)["n_chars"]))


def digest(found: DataFrame) -> DataFrame:
    """The columns that the query returns."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
