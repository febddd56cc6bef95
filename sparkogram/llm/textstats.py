"""Per-document statistics for the quality rules and the quality classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkogram.llm.textops import pieces, tidy

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOL = b"#*$%&|<>"
_END = b".!?,;:"
_BLANK = b" \t\n\r\x0b\x0c"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct",
    "n_upper", "n_lower", "n_digits", "n_punct", "n_bars", "n_bangs", "n_end_lines", "n_long_words",
)


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words inside k-word windows that occur at least twice in the text."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(k)), strict=False))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered += i + k - max(i, upto)
            upto = i + k
    return covered


def counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    words = text.split()
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    left = lambda chars, of=text: len(of) - len(of.translate(None, chars))
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        left(_SYMBOL),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(text.translate(None, _CONTINUATION)),
        len(lines),
        len(set(words)),
        left(_UPPER),
        left(_LOWER),
        left(_DIGIT),
        left(_END),
        text.count(b"|"),
        text.count(b"!"),
        sum(1 for x in lines if x.rstrip(_BLANK).endswith((b".", b"!", b"?"))),
        sum(1 for w in words if len(w) > 20),
    )


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1):
        rows = [counts(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in COUNTS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *COUNTS])


def text_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COUNTS (all long) of every whole text; a null text counts as empty."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInArrow(tidy(_batches), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def counted_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, COUNTS): every row of ``docs`` as a struct, with the counts of its own text."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pa.RecordBatch.from_arrays([b.column(0), pc.struct_field(b.column(0), [at])], names=["row", "text"]) for b in batches)
        for got in _batches(rows):
            yield got.rename_columns(["row", *COUNTS])

    kind = StructType([StructField("row", docs.schema), *(StructField(c, LongType()) for c in COUNTS)])
    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(tidy(run), kind)


def one_row_each(counts: DataFrame, *more: str) -> DataFrame:
    """One row per doc_id, the one with the least counts; ``more`` depends on doc_id alone."""
    least = counts.groupBy("doc_id", *more).agg(F.min(F.struct(*COUNTS)).alias("least"))
    return least.select("doc_id", *more, "least.*")


def ratios(df: DataFrame) -> dict[str, object]:
    """Named scale-free statistics as column expressions over COUNTS."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.log1p("n_words"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "upper": F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)),
        "digits": per("n_digits", "word_chars"),
        "punct": per("n_punct", "n_words"),
        "bars": per("n_bars", "n_words"),
        "bangs": per("n_bangs", "n_words"),
        "end_lines": per("n_end_lines", "n_lines"),
        "long_words": per("n_long_words", "n_words"),
        "line_words": F.log1p(per("n_words", "n_lines")),
    }


def bounded_sample(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of a table with unique doc_id, the first in a hash order.

    A cut on the hash leaves little more than that before anything is sorted, so
    no task hands on more rows than its share.
    """
    total = rows.count()
    order = F.xxhash64("doc_id")
    if total > max_rows:
        share = min(1.0, 1.05 * max_rows / total + 200 / total)
        rows = rows.where(order <= int(-(2**63) + share * (2**64 - 1)) if share < 1 else F.lit(True))
    return rows.orderBy(order, "doc_id").limit(max_rows)
