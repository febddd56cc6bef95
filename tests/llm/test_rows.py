"""Null and repeated ids, repeated rows, clashing columns, very long texts, empty tables: every operator's defined results."""

from __future__ import annotations

import json
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus as B  # noqa: E402

from sparkogram.llm import bpe_trie, chat_format, decontam_sam, minhash_tensor, quality_qda, quality_rules, substring_rlz, textstats, toxicity_weak, url_filter, warc  # noqa: E402
from sparkogram.llm.queries import QUERIES, tokenizer_path  # noqa: E402

#: Names that the operators use inside, as extra columns of their inputs.
CLASH = "rep print component key row kept spans first label n source _kept_id _cut_id _row _cut_spans held score"
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH.split())
LONG = " ".join(f"word{i % 9000} x{i}" for i in range(60_000))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, *CLASH.split()) for d, t in rows], SCHEMA).repartition(3)


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


A, C, D = words(1, 90), words(2, 90), words(3, 90)
NEAR = " ".join(["new", *A.split()[1:]])
#: A repeated row, an id with several texts, null ids, odd texts, and one text far over a step's bytes.
ROWS = [(1, A), (1, A), (2, C), (2, NEAR), (3, C), (None, A), (None, D), (None, D), (4, None), (5, ""), (5, None), (6, LONG), (7, LONG + " end"), (8, D)]


def test_all_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names and len(QUERIES) == 10
    assert set(__spark_entry__.oracle_sql()) <= names


def test_near_duplicates_of_odd_rows(spark):
    got = minhash_tensor.near_duplicates(frame(spark, ROWS))
    assert sorted(got.columns) == ["component_id", "doc_id", "kept", "n_shingles"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["component_id"], r["kept"]))
    # 2 has a near copy of 1 and a copy of 3, so the three are one component; D's copies have no id
    assert by == {1: {(1, True)}, 2: {(1, False)}, 3: {(1, False)}, None: {(None, False)}, 4: {(4, True)}, 5: {(5, True)}, 6: {(6, True)}, 7: {(6, False)}, 8: {(8, True)}}


@pytest.mark.parametrize("shift", [0, (1 << 62) + 5])
def test_dropping_near_duplicates_row_by_row(spark, shift):
    rows = [(d if d is None else d + shift, t) for d, t in ROWS]
    docs = frame(spark, rows)
    got = minhash_tensor.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"] or shift) - shift, r["text"] or "") for r in got.collect())
    texts = [t for _, t in left]
    # a row of each group: A (with its near copy), C, D, LONG; wordless rows all stay
    assert sum(t in (A, NEAR) for t in texts) == 1 and texts.count(C) == 1 and texts.count(D) == 1 and texts.count("") == 3
    assert [(d, len(t)) for d, t in left if len(t) > 10_000] == [(6, len(LONG))] and (1, A) in left and (8, D) in left and len(left) == 7


def test_substrings_of_odd_rows(spark):
    docs = frame(spark, ROWS)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_rlz.substring_report(docs).collect())
    n = 120_000
    assert got == sorted([(1, 90, 0), (1, 90, 0), (2, 90, 0), (2, 90, 89), (3, 90, 90), (0, 90, 0), (0, 90, 0), (0, 90, 0), (4, 0, 0), (5, 0, 0), (5, 0, 0), (6, n, 0), (7, n + 1, n), (8, 90, 0)])
    new = substring_rlz.remove_repeated_spans(docs)
    assert new.columns == docs.columns
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in new.collect())
    assert left == sorted([(1, A), (1, A), (2, C), (2, "new "), (0, A), (0, D), (0, D), (4, ""), (5, ""), (5, ""), (6, LONG), (7, " end"), (8, D)])


def test_decontamination_of_odd_rows(spark):
    docs = frame(spark, ROWS)
    items = spark.createDataFrame([(1, " ".join(C.split()[10:40]), "x"), (2, None, "x"), (None, "end", "x")], "item_id long, text string, doc_id string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in decontam_sam.contamination_report(docs, items).collect())
    assert len(got) == len(ROWS) and [x for x in got if x[2]] == [(2, 90, 30, 1), (3, 90, 30, 1), (7, 120_001, 1, 1)]
    new = decontam_sam.decontaminate(docs, items)
    assert new.columns == docs.columns and new.count() == len(ROWS)


def test_statistics_and_rules_of_odd_rows(spark):
    docs = frame(spark, ROWS)
    counts = textstats.text_counts(docs)
    assert counts.count() == len(ROWS)
    labels = spark.createDataFrame([(i, i % 2, 0, "c") for i in (1, 1, 2, 3, 4, 5, 8)] + [(None, 1, 1, "c"), (9, None, None, "c")], "doc_id long, quality int, toxic int, text string")
    report = quality_rules.quality_report(docs, labels)
    assert report.count() == len(ROWS)
    assert {r["doc_id"] for r in report.where("base_failed").collect()} == {4, 5}
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    scores = quality_qda.quality_scores(counts, labels, F.lit(True))
    assert scores.count() == len(ROWS) and scores.where("score is null or score < 0 or score > 1").count() == 0
    toxic = labels.withColumn("toxic", F.when(F.col("doc_id") == 1, 1).otherwise(0))
    scores = toxicity_weak.toxicity_scores(docs, toxic, F.lit(True), support=1, purity=0.3)
    assert scores.count() == len(ROWS) and scores.where("score is null or score < 0 or score > 1").count() == 0


def test_tokens_of_odd_rows(spark):
    docs = frame(spark, ROWS)
    got = bpe_trie.encode_digests(docs, tokenizer_path()).collect()
    assert len(got) == len(ROWS) and all((r["n_tokens"] == 0) == (r["doc_id"] in (4, 5)) for r in got)
    tokens = bpe_trie.encode(docs, tokenizer_path())
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    assert next(r["ids"] for r in tokens.where("doc_id = 7").collect()) == lib.encode(LONG + " end", add_special_tokens=False).ids
    odd = spark.createDataFrame([(None, [320, None, 10**8]), (1, None), (1, []), (2, [320])], "doc_id long, ids array<int>")
    back = sorted((r["doc_id"] or 0, r["text"]) for r in bpe_trie.decode(odd, tokenizer_path()).collect())
    assert back == [(0, lib.decode([320])), (1, ""), (1, ""), (2, lib.decode([320]))]


def test_a_vocabulary_of_another_kind_is_refused(tmp_path):
    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFKC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": {"type": "BPEDecoder", "suffix": "</w>"}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="another kind"):
            bpe_trie.TrieBPE(str(path))


def test_urls_and_warc_of_odd_rows(spark):
    pages = [(1, "http://a.com/x", "<p>same</p>"), (1, "http://a.com/x", "<p>same</p>"), (1, "http://a.com/y", "other"), (None, "http://b.com", "<p>same</p>"),
             (2, None, "<p>same</p>"), (3, "no scheme", None), (4, "http://A.COM/x?q#f", ""), (5, "x" * 100_000, "y" * 300_000)]
    table = spark.createDataFrame([(*p, "k", "s") for p in pages], "page_id long, url string, html string, key string, sha string").repartition(3)
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["verdict"]) for r in url_filter.filter_urls(table, rules).collect())
    assert got == [(0, "b.com", "", "allow"), (1, "a.com", "/x", "block"), (1, "a.com", "/x", "block"), (1, "a.com", "/y", "block"),
                   (2, "", "", "allow"), (3, "", "", "allow"), (4, "a.com", "/x", "block"), (5, "", "", "allow")]
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.round_trip(table).collect())
    assert got == [(0, 11, "response", 0), (1, 5, "response", 0), (1, 11, "response", 0), (1, 11, "response", 0),
                   (2, 11, "revisit", 1), (3, 0, "response", 0), (4, 0, "revisit", 3), (5, 300_000, "response", 0)]
    assert warc.round_trip(table.limit(0)).count() == 0


def test_reading_archives_is_spread_over_tasks(spark, tmp_path):
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.md5(F.col("id").cast("string")).alias("html")).coalesce(1)
    manifest = warc.write_archives(pages, str(tmp_path / "w"), max_bytes=1500)
    assert manifest.count() >= 8
    read = warc.read_archives(manifest.select("archive"))
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("archive").alias("n")).collect()]
    assert len(sizes) >= 0.6 * manifest.count() and max(sizes) <= 3
    assert read.where("kind = 'record'").count() == 60


def test_chat_orders_by_needs_and_writes_canonical_numbers(spark):
    ev = lambda c, t, k, i, body="{}", needs=None: (c, t, k, "r", i, "f" if k == "call" else None, body, needs, "x")
    rows = [
        # b was logged before the result it needs, d and a message hang on b
        ev(1, 0, "call", "b", needs=["a"]), ev(1, 1, "result", "b", "B"), ev(1, 2, "call", "d", needs=["b", "zz"]), ev(1, 3, "message", None, "m", ["d"]),
        ev(1, 4, "call", "a"), ev(1, 5, "result", "a", "A"), ev(1, 6, "result", "d", "D"), ev(1, 9, "message", None, "late"),
        # a circle, and one behind it
        ev(2, 0, "call", "p", needs=["q"]), ev(2, 1, "result", "p"), ev(2, 2, "call", "q", needs=["p"]), ev(2, 3, "result", "q"), ev(2, 4, "call", "s", needs=["q"]), ev(2, 5, "call", "ok", needs=["ok2"]),
        ev(2, 6, "call", "ok2"), ev(2, 7, "result", "ok2"),
        # in order; null identifiers and null rows
        ev(3, 0, "call", "a"), ev(3, 1, "result", "a"), ev(3, 2, "call", "b", needs=["a"]), ev(3, 3, "call", None, needs=["a"]), ev(None, None, "message", None, None),
    ]
    events = spark.createDataFrame(rows, "conv_id long, turn int, kind string, role string, id string, name string, body string, needs array<string>, place string")
    schemas = spark.createDataFrame([("f", "x", "number", False)], "name string, field string, type string, required boolean")
    got = chat_format.link_events(events, schemas).orderBy("conv_id", "place", "depth", "rank", "turn", "id").collect()
    assert len(got) == len(rows)
    at = [(r["turn"], r["kind"], r["id"]) for r in got if r["conv_id"] == 1]
    assert at == [(4, "call", "a"), (5, "result", "a"), (0, "call", "b"), (1, "result", "b"), (2, "call", "d"), (6, "result", "d"), (3, "message", None), (9, "message", None)]
    two = {r["id"]: (r["status"], r["place"]) for r in got if r["conv_id"] == 2 and r["kind"] == "call"}
    assert two == {"p": ("circular", 0), "q": ("circular", 2), "s": ("circular", 4), "ok": ("pending", 7), "ok2": ("linked", 6)}
    three = [(r["turn"], r["status"], r["place"], r["depth"]) for r in got if r["conv_id"] == 3]
    assert three == [(0, "linked", 0, 0), (1, "linked", 1, 0), (2, "pending", 2, 0), (3, "pending", 3, 0)]
    forms = {"1e0": "1", "1.0": "1", "1": "1", "-0.50": "-0.5", "1e7": "10000000", "1E20": "1.0E20", "12345678901234567890": "12345678901234567890", '"1.0 \\" 2e5"': '"1.0 \\" 2e5"', "[1.0,{\"b\":2.50,\"a\":\"3.0\"}]": '[1,{"a":"3.0","b":2.5}]'}
    events = spark.createDataFrame([ev(9, i, "call", str(i), '{"x": %s}' % n) for i, n in enumerate(forms)], events.schema)
    got = chat_format.link_events(events, schemas.limit(0)).orderBy("turn").collect()
    assert [r["json"].split(',"id"')[0] for r in got] == ['{"arguments":{"x":%s}' % f for f in forms.values()]
    long = json.dumps({"x": "y" * (3 << 20)})
    big = chat_format.link_events(spark.createDataFrame([ev(9, 0, "call", "1", long)], events.schema), schemas).first()
    assert big["errors"] == "type of x" and len(big["json"]) > 3 << 20
