"""Substring deduplication by relative Lempel-Ziv parsing.

The reference collection is indexed in blocks.  A block is named by an *anchor*:
every window of ``min_words`` consecutive words is owned by the smallest hash
among its k-word grams, a function of the window's words alone, so equal windows
of any documents belong to the same block and a document only has to be parsed
against the blocks it has windows in.  Consecutive windows with one owner form a
*phrase* (some twenty windows); phrases are what is dealt out to blocks.

1. one narrow pass cuts each text into phrases (anchor, content hash, position);
2. anchors met in one document only are dropped before anything else moves;
3. equal phrases collapse into a class; for all but its smallest document the
   whole phrase is one factor, so a passage in a third of all documents costs one row;
4. in blocks with several classes, each class is factored greedily against the
   classes of smaller documents: of the sources that hold a window the longest
   agreement is taken, and windows across a factor's boundary are looked up on
   their own, so every window is judged;
5. a block too large for one task (the surroundings of a passage differ in very
   many documents) is dealt out under longer names, whole windows: its factors
   are runs of windows with one source;
6. factors that go on in the same source join across phrase borders, and their
   spans are united per text and cut out.

Aggregates are written before they are joined back: then a join has plain
exchanges on both sides and adaptive execution can split a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.llm.textops import _powers, fresh, gram_hashes, mix, pieces, sliding_min, tidy, word_hashes
from sparkogram.runtime import cut, drop_scratch

GRAM = 8
#: Windows of a block that one task indexes (about 100 MB); a larger block is dealt out by whole windows.
MAX_WINDOWS = 1 << 18
#: Places of a window that are compared for the longest agreement; the first place decides whether it repeats.
PLACES = 8


def phrases(words: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content hash, first word, number of windows) of a text's phrases."""
    empty = np.empty(0, np.uint64)
    n = len(words)
    if n < min_words:
        return empty, empty, empty.astype(np.int32), empty.astype(np.int32)
    hashes, gram = word_hashes(words), min(GRAM, min_words)
    owner = sliding_min(gram_hashes(hashes, gram), min_words - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    count = np.diff(np.append(first, len(owner)))
    power, inverse = _powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power)])
    end = first + count + min_words - 1
    content = mix((total[end] - total[first]) * inverse[first] + count.astype(np.uint64))
    return owner[first], content, first.astype(np.int32), count.astype(np.int32)


PHRASES = "anchor long, content long, doc_id long, print long, first int, windows int"
EXCERPTS = "anchor long, content long, doc_id long, first int, words binary, large boolean"
FACTORS = "anchor long, content long, shift int, repeated int, source long, at int"
WINDOWS = "one long, two long, anchor long, content long, doc_id long, at int, shift int"
_KIND = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(fields: str, columns: list) -> pa.RecordBatch:
    """A batch of columns, given as Arrow arrays or lists, in the order of ``fields``."""
    schema = pa.schema([(name, _KIND[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def phrase_batches(min_words: int):
    """mapInArrow function: (doc_id, print, text) to a row per phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            cols = [phrases((t.as_py() or b"").split(), min_words) for t in part.column(2).cast(pa.binary())]
            row = pa.array(np.repeat(np.arange(len(cols)), [len(c[0]) for c in cols]))
            a, c, f, n = (np.concatenate(x) for x in zip(*cols, strict=True))
            yield _batch(PHRASES, [a.view(np.int64), c.view(np.int64), part.column(0).take(row), part.column(1).take(row), f, n])

    return run


def excerpt_batches(min_words: int):
    """(doc_id, text, parts array<struct<anchor, content, first, windows, large>>) to a row per phrase with its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            rows = []
            for doc, t, parts in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), part.column(2).to_pylist(), strict=True):
                words = t.as_py().split()
                for p in parts:
                    at = p["first"]
                    rows.append((p["anchor"], p["content"], doc, at, b" ".join(words[at : at + p["windows"] + min_words - 1]), p["large"]))
            yield _batch(EXCERPTS, list(zip(*rows, strict=True)) or [[]] * 6)

    return run


class ReferenceBlock:
    """Greedy factorisation against the phrases of smaller documents, then indexing.

    Phrases come by document.  A window is indexed at its first place, and again
    where it ends a factor and goes on differently, so its places stand for its
    continuations.
    """

    def __init__(self, min_words: int):
        self.min_words = min_words
        self.texts: list[tuple[int, int, list[bytes]]] = []
        self.index: dict[int, list[tuple[int, int]]] = {}

    def factor(self, doc: int, first: int, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """[begin, end) of factors of at least ``min_words`` words, with the source's document and word position."""
        m, found, novel, i = self.min_words, [], [], 0
        seeds = gram_hashes(word_hashes(words), m).tolist()
        while i < len(seeds):
            size, source = self._longest(doc, words, i, seeds[i])
            if size:
                found.append((i, i + size, *source))
                i += size - m + 1  # the first window that crosses the factor's end
                if i < len(seeds):
                    novel.append(i - 1)
            else:
                novel.append(i)
                i += 1
        if novel:
            self.texts.append((doc, first, words))
            for at in novel:
                places = self.index.setdefault(seeds[at], [])
                if len(places) < PLACES:
                    places.append((len(self.texts) - 1, at))
        return found

    def _longest(self, doc: int, words: list[bytes], i: int, seed: int) -> tuple[int, tuple[int, int]]:
        """Length of the longest agreement with a smaller document from word i on, and its place; 0 without one."""
        m, best, place = self.min_words, 0, (0, 0)
        for number, at in self.index.get(seed, ()):
            other, begin, text = self.texts[number]
            if other >= doc or words[i : i + m] != text[at : at + m]:
                continue
            size, most = m, min(len(words) - i, len(text) - at)
            while size < most and words[i + size] == text[at + size]:
                size += 1
            if size > best:
                best, place = size, (other, begin + at)
        return best, place


def factor_batches(min_words: int):
    """EXCERPTS rows sorted by (anchor, doc_id) to FACTORS rows: what of a class repeats smaller documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, block = None, ReferenceBlock(min_words)
        for part in pieces(batches, 4):
            out: list[tuple[int, ...]] = []
            for a, content, doc, first, words in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if a != anchor:
                    anchor, block = a, ReferenceBlock(min_words)
                out += [(a, content, i, j - i - min_words + 1, s, at) for i, j, s, at in block.factor(doc, first, words.split(b" "))]
            yield _batch(FACTORS, list(zip(*out, strict=True)) or [[]] * 6)

    return run


def window_batches(min_words: int):
    """EXCERPTS rows to a row per window, named by 128 bits of hash of all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 4, most=1 << 20):
            names = []
            for words in part.column(4).to_pylist():
                h = word_hashes(words.split(b" "))
                names.append((gram_hashes(h, min_words), gram_hashes(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), min_words)))
            sizes = [len(x) for x, _ in names]
            row = pa.array(np.repeat(np.arange(len(names)), sizes))
            shift = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
            one, two = (np.concatenate([x[i] for x in names]).view(np.int64) for i in (0, 1))
            at = part.column(3).take(row).to_numpy(zero_copy_only=False) + shift
            yield _batch(WINDOWS, [one, two, *(part.column(i).take(row) for i in range(3)), at.astype(np.int32), shift])

    return run


def _window_factors(excerpts: DataFrame, min_words: int) -> DataFrame:
    """FACTORS of the classes of large blocks, a window at a time."""
    windows = cut(excerpts.mapInArrow(tidy(window_batches(min_words)), WINDOWS), "windows")
    firsts = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "at")).alias("s"), F.max("doc_id").alias("last"))
    firsts = firsts.where("s.doc_id < last").select("one", "two", F.col("s.doc_id").alias("source"), F.col("s.at").alias("source_at"))
    met = windows.join(cut(firsts, "firsts"), ["one", "two"]).where("doc_id > source")
    return met.select("anchor", "content", "shift", F.lit(1).alias("repeated"), "source", F.col("source_at").alias("at"))


def _prints(docs: DataFrame, text: str) -> tuple[Column, bool]:
    """Tells an id's texts apart: a hash of the text, or a constant where no id is repeated; and whether one is."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").take(1)
    return (F.xxhash64(text), True) if repeated else (F.lit(0).cast("long"), False)


def repeated_factors(docs: DataFrame, min_words: int = 50, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, print, first, end, source, source_first): the word ranges that repeat documents with smaller ids.

    ``docs`` has doc_id (long), print and text, a row per text.  A factor goes on
    over phrase borders as long as its source does.
    """
    docs = docs.select("doc_id", "print", "text").where("doc_id is not null and text is not null")
    every = cut(docs.mapInArrow(tidy(phrase_batches(min_words)), PHRASES), "phrases")
    shared = every.groupBy("anchor").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y")
    # merge joins at every size: tables that happen to be small are not broadcast, so plans are those of large ones
    occ = cut(every.join(cut(shared.select("anchor"), "anchors").hint("merge"), "anchor", "left_semi"), "shared")
    drop_scratch(every)
    classes = occ.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "print", "first", "windows")).alias("head"))
    classes = cut(classes.select("anchor", "content", "head.*"), "classes")
    blocks = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.sum("windows").alias("size")).where("n > 1")
    blocks = cut(blocks.select("anchor", (F.col("size") > max_windows).alias("large")), "blocks")
    mixed = classes.join(blocks.hint("merge"), "anchor")

    # the words of one phrase per class of a block with several
    heads = mixed.groupBy("doc_id", "print").agg(F.collect_list(F.struct("anchor", "content", "first", "windows", "large")).alias("parts"))
    texts = cut(docs.join(heads.hint("merge"), ["doc_id", "print"]).select("doc_id", "text", "parts").mapInArrow(tidy(excerpt_batches(min_words)), EXCERPTS), "excerpts")
    small = texts.where("not large").repartition("anchor").sortWithinPartitions("anchor", "doc_id", "first")
    factors = small.mapInArrow(tidy(factor_batches(min_words)), FACTORS)
    if blocks.where("large").take(1):
        factors = factors.unionAll(_window_factors(texts.where("large"), min_words))
    factors = cut(factors, "factors")

    sources = classes.select("anchor", "content", F.col("doc_id").alias("source"), F.col("first").alias("at"))
    met = cut(occ.join(sources.hint("merge"), ["anchor", "content"]), "met")
    whole = met.where("doc_id > source").select("doc_id", "print", "first", "windows", "source", "at")
    own = met.where("doc_id = source").select("anchor", "content", "doc_id", "print", F.col("first").alias("begin"))
    parts = own.join(factors.hint("merge"), ["anchor", "content"]).select(
        "doc_id", "print", (F.col("begin") + F.col("shift")).alias("first"), F.col("repeated").alias("windows"), "source", "at"
    )
    found = whole.unionAll(parts).withColumn("end", F.col("first") + F.col("windows") + min_words - 1)
    # phrases that go on in the same source are one factor
    along = W.partitionBy("doc_id", "print", "source", "diagonal").orderBy("first", "end")
    before = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("diagonal", F.col("at") - F.col("first")).withColumn("new", F.when(F.col("first") <= before, 0).otherwise(1))
    found = found.withColumn("run", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return found.groupBy("doc_id", "print", "source", "diagonal", "run").agg(
        F.min("first").alias("first"), F.max("end").alias("end"), F.min("at").alias("source_first")
    ).select("doc_id", "print", "first", "end", "source", "source_first")


def repeated_spans(docs: DataFrame, min_words: int = 50, **options) -> DataFrame:
    """(doc_id, print, spans array<struct<first, end>>) of the texts that repeat others; ``docs`` as in :func:`repeated_factors`."""
    factors = repeated_factors(docs, min_words, **options)
    return factors.groupBy("doc_id", "print").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))


def _mask(n: int, spans: list[dict]) -> np.ndarray:
    gone = np.zeros(n + 1, np.int32)
    for s in spans:
        gone[s["first"]] += 1
        gone[s["end"]] -= 1
    return np.cumsum(gone[:-1]) > 0


def splice(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, other words and the white space between them as they were."""
    at, out = 0, []
    starts, ends, pos = [], [], 0
    for w in text.split():
        pos = text.index(w, pos)
        starts.append(pos)
        pos += len(w)
        ends.append(pos)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    for i, j in edge.reshape(-1, 2).tolist():
        out.append(text[at : starts[i]])
        at = ends[j - 1]
    return b"".join([*out, text[at:]])


def report_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to (doc_id, n_words, n_removed, kept_sha256)."""
    for part in pieces(batches, 1):
        size, n, sha = [], [], []
        for t, spans in zip(part.column(1).cast(pa.binary()), part.column(2), strict=True):
            words = (t.as_py() or b"").split()
            size.append(len(words))
            cuts = spans.as_py()
            if cuts:
                gone = _mask(len(words), cuts)
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n.append(size[-1] - len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"]
        )


def splice_batches(at: int):
    """Rows with the text in column ``at`` and its spans in the last one: without them, without emptied rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            texts, left = [], []
            for t, spans in zip(batch.column(at).cast(pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                text, cuts = t.as_py(), spans.as_py()
                if cuts:
                    gone = _mask(len(text.split()), cuts)
                    text = splice(text, gone)
                texts.append(text)
                left.append(not cuts or not gone.all())
            cols = batch.columns[:-1]
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1]).filter(pa.array(left, pa.bool_()))

    return run


def _spans_of_rows(docs: DataFrame, min_words: int, doc_id: str, text: str, options: dict) -> tuple[DataFrame, str]:
    """``docs`` with a last column, the spans of each row's own text; the column's name."""
    key, which, spans = fresh(docs, "key", "which", "spans")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tell, repeated = _prints(src, "text")
    src = src.withColumn("print", tell)
    if repeated:  # one row for each text of an id
        src = cut(src.where("doc_id is not null").dropDuplicates(["doc_id", "print"]), "once")
    found = cut(repeated_spans(src, min_words, **options), "spans")
    found = found.select(F.col("doc_id").alias(key), F.col("print").alias(which), F.col("spans").alias(spans))
    tell = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    joined = docs.join(found.hint("merge"), (F.col(doc_id).cast("long") == F.col(key)) & (tell == F.col(which)), "left")
    return joined.drop(key, which), spans


def substring_report(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document.

    A word goes when it lies in a window of ``min_words`` words that also starts
    in a document with a smaller id.  Defined results: a null or empty text has
    no words and the hash of the empty string; texts shorter than a window lose
    nothing; rows of one id are one document, whose texts do not remove each
    other's words, and each row loses what its own text repeats; a null id loses
    nothing; an empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows, spans = _spans_of_rows(src, min_words, "doc_id", "text", options)
    return rows.select("doc_id", "text", spans).mapInArrow(tidy(report_batches), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeated_spans(docs: DataFrame, min_words: int = 50, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``; documents left without a word go.

    Results are those of :func:`substring_report`, row by row: null ids and null
    texts stay as they are, repeated rows are cut alike, an empty table stays
    empty.  Texts move once, joined with their spans; other columns stay.
    """
    rows, spans = _spans_of_rows(docs, min_words, doc_id, text, options)
    return rows.select(*docs.columns, spans).mapInArrow(tidy(splice_batches(docs.columns.index(text))), docs.schema)
