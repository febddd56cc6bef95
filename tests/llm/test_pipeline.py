"""The corpus pipeline against brute force, stage by stage."""

from __future__ import annotations

import hashlib
import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import corpus as B  # noqa: E402

import corpus_pipeline  # noqa: E402
from sparkogram.llm import decontam_sam, minhash_tensor, quality_rules  # noqa: E402
from sparkogram.llm.queries import tokenizer_path  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = dict(docs.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF), "test")
        if name != "bpe":
            assert docs.columns == columns
            now = dict(docs.select("doc_id", "text").collect())
        if name == "quality_rules":
            good = {d for d, t in kept.items() if (c := B.base_counts(t))[0] >= 50 and 2 * c[4] <= c[0]}
            assert set(now) <= good and len(now) > 0.7 * len(good)
        elif name == "near_dedup":
            assert now == {d: kept[d] for d, v in B.near_duplicates(kept.items(), percent=80).items() if v[2]}
        elif name == "substring_dedup":
            truth = B.substrings(kept.items())
            assert set(now) == {d for d, (n, gone, _) in truth.items() if gone < n}
            for d, t in now.items():
                assert len(B.words(t)) == truth[d][0] - truth[d][1]
        elif name == "decontamination":
            items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
            hit = B.contamination(kept.items(), [(r["item_id"], r["text"]) for r in items])
            assert all(now[d] == t for d, t in kept.items() if not hit[d][4])
            assert all(now[d] != kept[d] for d in now if hit[d][4])
            assert {d for d in kept if d not in now} == {d for d, v in hit.items() if 2 * v[1] > v[0]}
        if name != "bpe":
            lengths = dict(docs.select("doc_id", "n_chars").collect())
            assert all(lengths[d] == len(t) for d, t in now.items())
            kept = now
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: r["ids"] for r in docs.collect()}
    assert got == {d: lib.encode(t, add_special_tokens=False).ids for d, t in kept.items()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, extra columns with clashing names, and an empty table."""
    rng = random.Random(7)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, item = text(), text(), text(), text()
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (2, None), (3, ""), (4, f"{b} {item}"), (5, f"{a} x y z")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, label int"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "r", "k", 1) for i, t in rows], schema)
    spark.createDataFrame([(1, 1, 0), (9, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        left = table
        for name, stage in corpus_pipeline.STAGES:
            left = corpus_pipeline.cut(stage(spark, left, str(tmp_path)), "odd")
            if name != "bpe":
                assert left.columns == docs.columns
                last = left
        got = sorted((r["doc_id"] or 0, r["text"].strip()) for r in last.collect())
        # 5 is a near copy of 1; of 1's texts b is a part of 4, which has the larger id
        assert got == ([] if table is not docs else sorted([(1, a), (1, b), (0, c)]))
        assert left.count() == len(got) and left.columns == ["doc_id", "n_tokens", "ids"]


def test_stages_judge_rows_whatever_their_ids_are(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c, d, item = text(), text(), text(), text(), text()
    rows = [(1, a), (1, "too short"), (None, "too short as well"), (None, b), (None, c), (None, c), (None, a), (2, d)]
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars int")
    left = lambda df: sorted((r["doc_id"] or 0, r["text"]) for r in df.collect())
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = quality_rules.keep_good(docs, none)
    assert good.columns == docs.columns and left(good) == sorted((i or 0, t) for i, t in rows if len(t) > 50)
    once = minhash_tensor.drop_near_duplicates(good)
    assert once.columns == docs.columns and left(once) == sorted([(1, a), (0, b), (0, c), (2, d)])
    items = spark.createDataFrame([(None, item), (4, d)], "item_id long, text string")
    texts = spark.createDataFrame([(5, f"{a} {item} {b}"), (6, a), (7, f"{d} {item}")], "doc_id long, text string")
    for size in (200_000, 300):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam_sam.contamination_report(texts, items, max_tokens=size).collect()}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert got == {5: (80, 1, sha(b"")), 6: (0, 0, sha(b"")), 7: (160, 2, sha(b"4"))}
    assert left(decontam_sam.decontaminate(texts, items)) == [(5, f"{a}  {b}"), (6, a)]
