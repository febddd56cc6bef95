"""MinHash near-duplicate classes by tensored banding.

Two small collections of minhash groups are drawn per document, u_1..u_m and
v_1..v_m.  A table key is a *pair* (u_i, v_j), so m + m groups give m * m tables
and the minhash work is about the square root of what independent bands need.
Two sets of similarity s collide in at least one table with probability
(1 - (1 - s^r)^m)^2, r minhashes a group; m = 12 and r = 3 give 0.99998 at 0.85.

Stages:

1. one narrow pass: shingle set size, 128-bit set digest, 2m group values;
2. equal sets collapse into a class (representative = smallest id), so copies
   are never paired with each other;
3. group values that nobody shares are dropped before pairs of them are formed;
4. each representative is verified against the smallest document it meets in
   any table; links are exact, on full shingle sets of whole texts.  The hub of
   many pairs has its text sent once per few hundred partners, which stream past
   its set, so no task holds a hub's group and no pair carries two texts;
5. members of tables that still hold several components are compared across
   components by prefix filtering on their full sets, which loses no link, and
   verified: no table is capped and no table's pairs are written out;
6. components by large-star / small-star.

Aggregates are written before they are joined back: then a join has plain
exchanges on both sides and adaptive execution can split a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkogram.llm.textops import fresh, mix, pieces, shingle_set, tidy
from sparkogram.operators.components import connected_components
from sparkogram.operators.observations import dense_ids
from sparkogram.runtime import cut

SIGNATURE = "doc_id long, n_shingles long, set_hi long, set_lo long, groups array<long>"


def _seeds(count: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return base[:count, None], base[count:, None] | np.uint64(1)


def signature_batches(m: int, r: int, k: int):
    """mapInArrow function: (doc_id, text) to SIGNATURE rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, odd = _seeds(2 * m * r)
        for batch in pieces(batches, 1):
            ids, size, hi, lo, groups = batch.column(0), [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = shingle_set(text.as_py(), k)
                size.append(len(s))
                if not len(s):
                    hi.append(0), lo.append(0), groups.append(np.empty(0, np.int64))
                    continue
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & ((1 << 64) - 1)) - (1 << 63))
                low = np.full(len(flip), np.iinfo(np.uint64).max, dtype=np.uint64)
                for at in range(0, len(s), 4096):
                    np.minimum(low, ((s[None, at : at + 4096] ^ flip) * odd).min(axis=1), out=low)
                g = low.reshape(2 * m, r)
                key = g[:, 0]
                for c in range(1, r):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + g[:, c])
                groups.append(key.astype(np.int64))
            offsets = np.cumsum([0, *map(len, groups)]).astype(np.int32)
            flat = np.concatenate(groups) if groups else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(hi, pa.int64()),
                    pa.array(lo, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64), pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_hi", "set_lo", "groups"],
            )

    return run


#: Partners that one copy of a hub's text serves.
SHARE = 512


def verify_batches(k: int, percent: int):
    """mapInArrow function: groups (b, salt) of rows (b, salt, a, text), b's own texts (a null) first, to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[int, int] | None = None
        hub: dict[bytes, np.ndarray] = {}
        for part in pieces(batches, 3):
            links: list[tuple[int, int]] = []
            ids = zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)
            for (b, salt, a), text in zip(ids, part.column(3).cast(pa.binary()), strict=True):
                if group != (b, salt):
                    group, hub = (b, salt), {}
                s = shingle_set(text.as_py(), k)
                if a is None:
                    hub[xxhash.xxh3_128_digest(s.tobytes())] = s
                    continue
                for t in hub.values():
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(t) - both):
                        links.append((a, b))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, label: str) -> DataFrame:
    """Links among candidate pairs (a > b), decided on full sets."""
    hubs = cut(pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).alias("n")), "hubs")
    dealt = cut(pairs.join(hubs, "b").select("b", F.pmod(F.xxhash64("a"), F.col("n")).alias("salt"), "a"), "dealt")
    heads = dealt.select("b", "salt").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b")
    tails = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a")
    rows = heads.select("b", "salt", F.lit(None).cast("long").alias("a"), "text").unionAll(tails.select("b", "salt", "a", "text"))
    rows = rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return cut(rows.mapInArrow(tidy(verify_batches(k, percent)), "a long, b long").distinct(), label)


SHINGLES = "doc_id long, print long, comp long, n_shingles long, shingle long"


def shingle_batches(k: int):
    """mapInArrow function: (doc_id, print, comp, text) to a row per distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 3, rows=256):
            sets = [shingle_set(x.as_py(), k) for x in part.column(3).cast(pa.binary())]
            row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            cols = [part.column(i).take(row) for i in range(3)]
            size = pa.array([len(s) for s in sets], pa.int64()).take(row)
            values = np.concatenate(sets).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*cols, size, pa.array(values)], names=SHINGLES.replace(" long", "").split(", "))

    return run


def _prefix_pairs(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a > b) of different components that can still be similar, by prefix filtering.

    A partner at the threshold shares at least ceil(t |A|) of A's shingles, so in
    any fixed order it shares one of A's first |A| - ceil(t |A|) + 1.  Rarest
    first, those prefixes hold few common shingles; a document whose prefix is
    all its own has no partner.  At the first shared shingle, positions bound
    what can still be shared.  Nothing is dropped that could be a link.
    """
    rows = members.join(texts, "doc_id").select("doc_id", "print", "comp", "text")
    rows = cut(rows.mapInArrow(tidy(shingle_batches(k)), SHINGLES), "shingles")
    common = cut(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "common")
    rows = rows.join(common, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    first = W.partitionBy("doc_id", "print").orderBy("df", "shingle")
    need = F.expr(f"n_shingles - ({percent} * n_shingles + 99) div 100 + 1")
    prefix = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= need)
    prefix = cut(prefix.where("df > 1").select("shingle", "doc_id", "n_shingles", "comp", "at"), "prefix")
    other = prefix.select("shingle", *(F.col(x).alias(f"{x}_b") for x in ("doc_id", "n_shingles", "comp", "at")))
    return (
        prefix.join(other, "shingle")
        .where("doc_id > doc_id_b and comp <> comp_b")
        .where(f"100 * least(n_shingles, n_shingles_b) >= {percent} * greatest(n_shingles, n_shingles_b)")
        .where(
            f"{100 + percent} * (1 + least(n_shingles - at, n_shingles_b - at_b)) >= {percent} * (n_shingles + n_shingles_b)"
        )
        .withColumnRenamed("doc_id_b", "b")
        .select(F.col("doc_id").alias("a"), "b")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 85, m: int = 12, r: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): near-duplicate components of ``docs``.

    Documents are linked when their sets of distinct k-word shingles (lower-cased
    ASCII, whole text) satisfy ``100 * |A & B| >= percent * |A | B|``.
    ``component_id`` is the smallest id reachable; ``kept`` marks that document.

    Defined results: a null, empty or wordless text has no shingles and is linked
    with nothing; fewer than k words form one shingle; a document is its id, so
    repeated ids keep a row each, are linked with each other and share whatever
    any of their texts is linked with; a null id keeps ``component_id`` null and is
    not kept; an empty table gives no rows.  Columns other than the two named are
    ignored.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = cut(src.mapInArrow(tidy(signature_batches(m, r, k)), SIGNATURE), "sets")

    full = sets.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep")), "classes")
    member = full.select("doc_id", "set_hi", "set_lo").join(classes, ["set_hi", "set_lo"]).select("doc_id", "rep")
    member = cut(member.distinct(), "member")
    reps = full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_hi", "set_lo"], "left_semi")
    reps = reps.dropDuplicates(["doc_id", "set_hi", "set_lo"])
    # an id with several texts is one document
    same = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y").select("doc_id")
    same = member.join(same, "doc_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = cut(same, "same")

    # group values that at least two representatives share
    slots = cut(reps.select("doc_id", F.posexplode("groups").alias("slot", "value")), "slots")
    shared = slots.groupBy("slot", "value").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y")
    shared = cut(shared.select("slot", "value"), "shared")
    mine = (
        slots.join(shared, ["slot", "value"], "left_semi")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("slot", "value")).alias("g"))
        .select(
            "doc_id",
            F.expr(f"filter(g, x -> x.slot < {m})").alias("us"),
            F.expr(f"filter(g, x -> x.slot >= {m})").alias("vs"),
        )
        .where("size(us) > 0 and size(vs) > 0")
    )
    tables = mine.select("doc_id", F.explode("us").alias("u"), "vs").select("doc_id", "u", F.explode("vs").alias("v"))
    keys = tables.select(F.xxhash64("u.slot", "u.value", "v.slot", "v.value").alias("key"), "doc_id")
    keys = cut(keys, "keys")
    heads = keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head <> last")
    met = keys.join(cut(heads.select("key", "head"), "heads"), "key")
    # per document: the smallest one it meets; the smallest itself has none but is met
    nearest = cut(met.groupBy("doc_id").agg(F.min(F.when(F.col("head") < F.col("doc_id"), F.col("head"))).alias("b")), "star")
    star = nearest.where("b is not null").select(F.col("doc_id").alias("a"), "b")
    texts = src.join(nearest.select("doc_id"), "doc_id", "left_semi").withColumn("print", F.xxhash64("text"))
    texts = cut(texts.dropDuplicates(["doc_id", "print"]), "texts")

    links = _verified(star, texts, k, percent, "links").unionAll(same)
    comps = cut(connected_components(links), "comps")

    # what the star left open: tables with members of several components
    placed = keys.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "key", "doc_id", F.coalesce("component", "doc_id").alias("comp")
    )
    placed = cut(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    open_keys = cut(open_keys.select("key"), "open")
    rest = cut(placed.join(open_keys, "key", "left_semi").select("doc_id", "comp").distinct(), "rest")
    cross = _prefix_pairs(rest, texts, k, percent)
    cross = cross.join(star, ["a", "b"], "left_anti")
    more = _verified(cut(cross, "cross"), texts, k, percent, "links")
    comps = cut(connected_components(links.unionAll(more)), "comps") if more.take(1) else comps

    placed_docs = member.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component_id")
    )
    placed_docs = cut(placed_docs.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "placed")
    return (
        sets.select("doc_id", "n_shingles")
        .join(placed_docs, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(False)))
    )


def _numbered(docs: DataFrame, doc_id: str, row: str) -> DataFrame:
    """``docs`` with a number per row: its id, or, for null ids and all but the first row of an id, one beyond all ids."""
    key = F.col(doc_id).cast("long")
    repeated = cut(docs.select(key.alias(row)).where(F.col(row).isNotNull()).groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(row), "repeated")
    named = docs.withColumn(row, key)
    if not repeated.take(1) and not docs.where(key.isNull()).take(1):
        return named
    first, odd = fresh(docs, "first", "odd")
    top = docs.agg(F.max(key)).first()[0] or 0
    if top >= 1 << 61:  # ids that leave no room above them are ranked
        ranks = cut(dense_ids(named.where(F.col(row).isNotNull()).select(F.col(row).alias(first)).distinct(), first, odd), "ranks")
        named = named.join(ranks, F.col(row) == F.col(first), "left").withColumn(row, F.col(odd)).drop(first, odd)
        repeated = cut(repeated.join(ranks, F.col(row) == F.col(first)).select(F.col(odd).alias(row)), "repeated")
        top = ranks.count()
    rows = named.where(F.col(row).isNull()).unionAll(named.join(repeated, row, "left_semi").select(named.columns))
    rows = cut(rows.withColumn(odd, F.monotonically_increasing_id() + F.lit(top + 1)), "odd")
    firsts = rows.where(F.col(row).isNotNull()).groupBy(row).agg(F.min(odd).alias(odd)).select(odd, F.col(row).alias(first))
    rows = rows.join(cut(firsts, "firsts"), odd, "left").withColumn(row, F.coalesce(first, odd))
    plain = named.where(F.col(row).isNotNull()).join(repeated, row, "left_anti")
    return plain.select(named.columns).unionAll(rows.select(named.columns))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate component (the smallest id); columns unchanged.

    Every row stands for itself: rows with a null id and all but one of the rows
    of a repeated id come after all others, and stay unless an earlier row is their
    near-duplicate, so repeated rows leave one.  Null and wordless texts are
    nobody's near-duplicates and stay; an empty table stays empty.
    """
    row, kept = fresh(docs, "row", "kept")
    rows = _numbered(docs, doc_id, row)
    found = near_duplicates(rows, doc_id=row, text=text, **options).where("kept").select(F.col("doc_id").alias(kept))
    return rows.join(found, F.col(row) == F.col(kept), "left_semi").drop(row)
