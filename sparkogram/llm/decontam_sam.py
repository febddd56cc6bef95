"""Benchmark decontamination with a generalised suffix automaton.

All test items, normalised to words, go into one suffix automaton over words.
Training texts are streamed through it; after each word the state gives the
longest suffix that occurs in some item.  A match of at least ``window`` words
is a span made of item windows; items shorter than a window count when they
occur whole.  Every state knows the items it occurs in, so a span names its
sources.

The automaton holds at most ``max_tokens`` item words; a larger benchmark is
split by item into blocks in the shared folder.  A task holds a few batches of
documents and takes the blocks' automata over them one after another, so what it
holds does not grow with the benchmark, and every row keeps its own result.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.llm.substring_rlz import _mask
from sparkogram.llm.textops import ALNUM, alnum_words, pieces, sizes, tidy
from sparkogram.llm.warc import _place
from sparkogram.runtime import scratch_path

#: Bytes of documents that several automata pass over in turn.
_HELD = 32 << 20


def _unite(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint ranges in order; those that meet become one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class ItemAutomaton:
    """Generalised suffix automaton of word sequences with item sets on its states.

    Nearly all states have one edge and one item, so both are numbers in flat
    arrays; only further edges and item sets of several are Python objects.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.link, self.len = array("i", [-1]), array("i", [0])
        self.word, self.to = array("i", [-1]), array("i", [-1])  # the first edge
        self.more: dict[int, int] = {}  # further edges: state and word to state
        self.fan: dict[int, list[int]] = {}  # words of a state's further edges
        coded = [(name, array("i", [self.ids.setdefault(w, len(self.ids)) for w in words])) for name, words in items if words]
        for _, seq in coded:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        n = len(self.len)
        self.names = sorted({name for name, _ in coded}, key=lambda x: (x is None, x))
        number = {name: i for i, name in enumerate(self.names)}
        self.item = array("i", [-1]) * n  # the item of a state, -2: several, in ``items``
        self.items: dict[int, set[int]] = {}
        self.whole: dict[int, list[tuple[int, int]]] = {}
        for name, seq in coded:
            who, at = number[name], 0
            for c in seq:
                at = up = self.step(at, c)
                while up > 0 and self.len[up] >= window and self._mark(up, who):
                    up = self.link[up]
            if len(seq) < window:
                self.whole.setdefault(at, []).append((len(seq), who))
        # the nearest state, itself included, towards the root with a whole short item
        self.short = array("i", [0]) * n
        if self.whole:
            for s in sorted(range(1, n), key=self.len.__getitem__):
                self.short[s] = s if s in self.whole else self.short[self.link[s]]
        self.least = min([window, *(len(seq) for _, seq in coded)])

    def step(self, state: int, c: int) -> int:
        """The state behind an edge, or -1."""
        return self.to[state] if self.word[state] == c else self.more.get(state << 32 | c, -1)

    def _mark(self, state: int, who: int) -> bool:
        """Add an item to a state; False if it was there."""
        old = self.item[state]
        if old == who or (old == -2 and who in self.items[state]):
            return False
        if old == -2:
            self.items[state].add(who)
        elif old >= 0:
            self.item[state], self.items[state] = -2, {old, who}
        else:
            self.item[state] = who
        return True

    def _extend(self, last: int, c: int) -> int:
        q = self.step(last, c)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, 0)
        p = last
        while p >= 0 and self.step(p, c) < 0:
            self._edge(p, c, cur)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, c)
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, size: int, link: int) -> int:
        self.len.append(size), self.link.append(link), self.word.append(-1), self.to.append(-1)
        return len(self.len) - 1

    def _edge(self, state: int, c: int, to: int) -> None:
        if self.word[state] in (-1, c):
            self.word[state], self.to[state] = c, to
        else:
            if state << 32 | c not in self.more:
                self.fan.setdefault(state, []).append(c)
            self.more[state << 32 | c] = to

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1, self.link[q])
        self.word[new], self.to[new] = self.word[q], self.to[q]
        for w in self.fan.get(q, ()):
            self._edge(new, w, self.more[q << 32 | w])
        self.link[q] = new
        while p >= 0 and self.step(p, c) == q:
            self._edge(p, c, new)
            p = self.link[p]
        return new

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Disjoint [first, end) ranges of hit words and the items that occur."""
        get = self.ids.get
        codes = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes >= 0).astype(np.int8), [0]])))
        found: list[tuple[int, int]] = []
        who: set[int] = set()
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= self.least:
                self._stream(codes[a:b].tolist(), a, found, who)
        return _unite(found), {self.names[i] for i in who}

    def _stream(self, codes: list[int], base: int, found: list, who: set[int]) -> None:
        state = size = 0
        word, to, more, link, length, window = self.word, self.to, self.more, self.link, self.len, self.window
        for i, c in enumerate(codes, base + 1):
            nxt = to[state] if word[state] == c else more.get(state << 32 | c, -1)
            while nxt < 0 and state:
                state = link[state]
                size = length[state]
                nxt = to[state] if word[state] == c else more.get(state << 32 | c, -1)
            state, size = (nxt, size + 1) if nxt >= 0 else (0, 0)
            if size >= window:
                found.append((i - size, i))
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                if self.item[up] == -2:
                    who |= self.items[up]
                else:
                    who.add(self.item[up])
            up = self.short[state]
            while up:
                for n, name in self.whole[up]:
                    if n <= size:
                        found.append((i - n, i))
                        who.add(name)
                up = self.short[link[up]]


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Lists of batches of about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += int(sum(sizes(c).sum() for c in batch.columns if c.type in (pa.string(), pa.binary())))
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def finder(blocks: list, window: int) -> Callable[[list[pa.Array]], list[list[tuple[int, list[tuple[int, int]], set[str]]]]]:
    """Function from text columns to the words, spans and items of every row.

    ``blocks`` are items, or files with them; the automaton used last is kept.
    """
    order, last = list(range(len(blocks))), (-1, None)

    def automaton(k: int) -> ItemAutomaton:
        nonlocal last
        if last[0] != k:
            last = (-1, None)  # the old one goes first
            block = blocks[k]
            if isinstance(block, str):
                system, path = _place(block)
                got = pq.read_table(path, filesystem=system).to_pydict()
                block = [(i, alnum_words(t.encode())) for i, t in zip(got["i"], got["t"], strict=True)]
            last = (k, ItemAutomaton(block, window))
        return last[1]

    def find(columns: list[pa.Array]):
        columns = [c.cast(pa.binary()) for c in columns]
        found = [[(0, [], set()) for _ in c] for c in columns]
        for k in order:
            spans_of = automaton(k).spans
            for column, rows in zip(columns, found, strict=True):
                for at, t in enumerate(column):
                    words = alnum_words(t.as_py() or b"")
                    spans, names = spans_of(words)
                    _, old, who = rows[at]
                    rows[at] = (len(words), _unite(old + spans) if old else spans, who | names)
        order.reverse()
        return found

    return find


def match_batches(blocks: list, window: int):
    """mapInArrow function: (doc_id, text) to (doc_id, n_words, spans, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(blocks, window)
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for held in _held(pieces(batches, 1), _HELD if len(blocks) > 1 else 0):
            for batch, found in zip(held, find([b.column(1) for b in held]), strict=True):
                n = [words for words, _, _ in found]
                spans = [[{"first": a, "end": b} for a, b in got] for _, got, _ in found]
                names = [sorted(who - {None}) + [None] * (None in who) for _, _, who in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(names, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "spans", "items"],
                )

    return run


SCHEMA = "doc_id long, n_words long, spans array<struct<first:int,end:int>>, items array<string>"


def _blocks(items: DataFrame, item_id: str, text: str, max_tokens: int) -> list:
    """Item blocks of about ``max_tokens`` words, several as files; a text of n bytes has at most n / 2 + 1 words."""
    src = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    total = src.agg(F.sum(F.expr("octet_length(t) div 2 + 1"))).first()[0] or 0
    count = -(-total // max_tokens) or 1
    if count == 1:
        return [[(r["i"], alnum_words(r["t"].encode())) for r in src.collect()]]
    folder = scratch_path(items.sparkSession, "items")
    system, base = _place(folder)
    system.create_dir(base, recursive=True)
    for k in range(count):
        part = src.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k).collect()
        rows = pa.table({"i": pa.array([r["i"] for r in part], pa.string()), "t": pa.array([r["t"] for r in part], pa.string())})
        pq.write_table(rows, f"{base}/{k}.parquet", filesystem=system)
    return [f"{folder}/{k}.parquet" for k in range(count)]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    max_tokens: int = 200_000,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document; spans are disjoint word ranges.

    Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.
    Defined results: null or empty texts have no words, spans or items; items
    without words are ignored; items with a null id hit and are one null in
    ``items``, which counts and has no name, as in the SQL; repeated items and ids with equal
    text count once in ``items``; an empty benchmark hits nothing; repeated
    and null document ids keep a row each; other columns are ignored.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(tidy(match_batches(_blocks(items, item_id, item_text, max_tokens), window)), SCHEMA)


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    got = contamination(docs, items, **options)
    n_hit = F.expr("aggregate(spans, 0L, (acc, s) -> acc + s.end - s.first)")
    return got.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the byte ranges from the first to the last word of each span."""
    plain = text.translate(ALNUM)
    words = plain.split()
    gone = _mask(len(words), spans)
    out, at, pos, start = [], 0, 0, None
    end = 0
    for w, g in zip(words, gone.tolist(), strict=True):
        pos = plain.index(w, pos)
        if g and start is None:
            start = pos
        elif not g and start is not None:
            out.append(text[at:start])
            at, start = end, None
        pos += len(w)
        end = pos
    if start is not None:
        out.append(text[at:start])
        at = end
    return b"".join([*out, text[at:]])


def cut_batches(at: int, max_coverage: float, blocks: list, window: int):
    """Rows with the text in column ``at``, without its spans; rows hit beyond the limit go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(blocks, window)
        for held in _held(pieces(batches, at), _HELD if len(blocks) > 1 else 0):
            for batch, found in zip(held, find([b.column(at) for b in held]), strict=True):
                texts, stay = [], []
                for t, (n, got, _) in zip(batch.column(at).cast(pa.binary()), found, strict=True):
                    text, spans = t.as_py(), [{"first": a, "end": b} for a, b in got]
                    hit = sum(b - a for a, b in got)
                    stay.append(not spans or (hit <= max_coverage * n and hit < n))
                    texts.append(_cut(text, spans) if spans else text)
                cols, names = batch.columns, batch.schema.names
                cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(stay, pa.bool_()))

    return run


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    max_coverage: float = 0.5,
    max_tokens: int = 200_000,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``docs`` without benchmark spans; documents covered beyond ``max_coverage`` go whole.

    A document is dropped when more than that share of its words is hit, or when
    no word is left.  This is a narrow pass: each row is judged by its own text,
    so null and repeated ids need no rule; null and empty texts stay as they are;
    an empty table stays empty; columns are unchanged, whatever their names.
    """
    at = docs.columns.index(text)
    return docs.mapInArrow(tidy(cut_batches(at, max_coverage, _blocks(items, item_id, item_text, max_tokens), window)), docs.schema)
