"""The training-data operators against brute force, and their defined results on odd inputs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import corpus as B  # noqa: E402

from sparkogram.llm import bpe_trie, chat_format, decontam_sam, minhash_tensor, quality_qda, quality_rules, substring_rlz, textstats, toxicity_weak, url_filter, warc  # noqa: E402
from sparkogram.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, score double, label int, spans string, key string"
ROWS = B.corpus()


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, 0.5, 1, "x", "k") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def found(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# ---- near duplicates, substrings, decontamination --------------------------------------------


def test_near_duplicates_equal_brute_force(docs):
    got = minhash_tensor.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got, "n_shingles", "component_id", "kept") == B.near_duplicates(ROWS)


def test_near_duplicates_of_many_near_copies(spark):
    """A group whose members are close to a base but not to each other, plus outsiders."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert found(minhash_tensor.near_duplicates(frame(spark, rows)), "n_shingles", "component_id", "kept") == B.near_duplicates(rows)


def test_near_duplicates_edge_cases(spark, none):
    assert minhash_tensor.near_duplicates(none).count() == 0
    got = minhash_tensor.near_duplicates(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(1, 1, True), (1, 1, True), (2, 2, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, False)]


def test_tensored_banding_misses_hardly_any_pair():
    """At the threshold itself the chance to miss is about (1 - s^r)^m twice."""
    miss = 1 - (1 - (1 - 0.85**3) ** 12) ** 2
    assert miss < 3e-5


def test_dropping_near_duplicates_keeps_columns(docs):
    kept = minhash_tensor.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {d for d, v in B.near_duplicates(ROWS).items() if v[2]}


@pytest.mark.parametrize("m", [50, 5])
def test_substrings_equal_brute_force(docs, m):
    assert found(substring_rlz.substring_report(docs, m), "n_words", "n_removed", "kept_sha256") == B.substrings(ROWS, m)


def test_substring_splice_leaves_the_rest_as_it_was(docs):
    new = found(substring_rlz.remove_repeated_spans(docs), "text")
    truth, old = B.substrings(ROWS), dict(ROWS)
    for d, (n, gone, sha) in truth.items():
        if n and gone == n:
            assert d not in new
            continue
        text = new[d][0]
        assert text == old[d] if not gone else hashlib.sha256(b" ".join(B.words(text))).hexdigest() == sha


def test_substring_edge_cases(spark, none):
    assert substring_rlz.substring_report(none).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    got = substring_rlz.substring_report(frame(spark, [(1, long), (1, long), (None, long), (2, long)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 60)]


def test_reference_block_checks_windows_across_factor_borders():
    block = substring_rlz.ReferenceBlock(3)
    assert block.factor(0, 10, b"a b c d".split()) == []
    assert block.factor(1, 20, b"c d e f".split()) == []
    assert block.factor(2, 30, b"a b c d e f".split()) == [(0, 4, 0, 10), (2, 6, 1, 20)]


def test_reference_block_takes_the_longest_source():
    block = substring_rlz.ReferenceBlock(3)
    block.factor(0, 0, b"a b c x y".split())
    assert block.factor(1, 0, b"p a b c q r s t".split()) == [(1, 4, 0, 0)]
    assert block.factor(2, 0, b"a b c q r s z".split()) == [(0, 6, 1, 1)]


def test_factors_run_on_over_phrase_borders(spark):
    """Long copies are one factor each, although they are dealt out as phrases, small and large blocks alike."""
    rng = random.Random(8)
    text = [f"w{rng.randrange(50)}" for _ in range(900)]
    rows = [(1, text), (2, ["x"] * 7 + text[100:700] + ["y"] * 5), (3, text[300:360] + ["z"] + text[500:900])]
    docs = spark.createDataFrame([(d, 0, " ".join(w)) for d, w in rows], "doc_id long, print long, text string")
    for most in (1 << 18, 0):
        got = substring_rlz.repeated_factors(docs, max_windows=most).collect()
        assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got) == [(2, 7, 607, 1, 100), (3, 0, 60, 1, 300), (3, 61, 461, 1, 500)]


def test_large_blocks_give_the_rows_of_small_ones(docs):
    for m in (50, 5):
        assert found(substring_rlz.substring_report(docs, m, max_windows=0), "n_words", "n_removed", "kept_sha256") == B.substrings(ROWS, m)


def test_contamination_equals_brute_force(spark, docs):
    rng = random.Random(2)
    long = [t for _, t in ROWS if t and len(t.split()) > 40]
    items = [(i, " ".join(rng.choice(long).split()[3 : 3 + rng.choice([2, 4, 10, 11, 25])]).upper()) for i in range(12)]
    items += [(50, ""), (51, None), (52, "!!"), (3, items[3][1]), (60, items[5][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    cols = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = B.contamination(ROWS, items)
    assert found(decontam_sam.contamination_report(docs, table), *cols) == want
    assert found(decontam_sam.contamination_report(docs, table, max_tokens=60), *cols) == want  # several automata


def test_decontaminate_removes_spans(spark, none):
    item = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(1, f"Before all. {item.upper()}! After it all, more words here to keep it long enough indeed."), (2, item), (3, "clean text"), (4, None)]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = found(decontam_sam.decontaminate(frame(spark, rows), items), "text")
    assert got == {1: ("Before all. ! After it all, more words here to keep it long enough indeed.",), 3: ("clean text",), 4: (None,)}
    more = items.unionByName(spark.createDataFrame([(8, "some other text of no use at all")], "item_id long, text string"))
    assert found(decontam_sam.decontaminate(frame(spark, rows), more, max_tokens=40), "text") == got
    assert decontam_sam.contamination_report(none, items).count() == 0
    assert decontam_sam.contamination_report(frame(spark, rows), items.limit(0)).where("contaminated").count() == 0


def test_several_item_blocks_give_the_rows_of_one(spark):
    """Repeated rows, null ids, and an id with several texts, some of equal length."""
    item, other = "the quick brown fox jumps over the lazy dog again and again", "pack my box with five dozen liquor jugs and then some more"
    free = "nothing to see in here but words of our own making at all"
    rows = [(1, f"{free} {free} {item}"), (1, f"{free} {free} {item}"), (1, f"{item} {free} {free}"), (1, f"{free} {free} {free}"), (1, f"{other} x"), (1, "short"),
            (None, f"{free} {free} {item}"), (None, f"{free} {free} {other}"), (None, f"{free} {free} {free}"), (2, f"{free} {item} {other} {free} {free}"), (3, None)]
    items = spark.createDataFrame([(7, item), (8, other), (9, "yet another line that no text has")], "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    one, many = (sorted(map(repr, decontam_sam.contamination_report(frame(spark, rows), items, max_tokens=n).select(cols).collect())) for n in (200_000, 40))
    assert len(one) == len(rows) and many == one
    one, many = (sorted(map(repr, decontam_sam.decontaminate(frame(spark, rows), items, max_tokens=n).collect())) for n in (200_000, 40))
    assert len(one) == len(rows) - 1 and many == one


# ---- statistics, rules, classifiers ----------------------------------------------------------


def test_base_counts_equal_brute_force(docs):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    extra = [(d, t) for d, t in ROWS]
    assert found(textstats.text_counts(docs), *cols) == {d: B.base_counts(t) for d, t in extra}
    for text in ("a b\na b\n \n \nc", "a a a a a", "x#<>\n\nx#<>\r\nx#<>", "a b c a b c"):
        assert textstats.counts(text.encode())[:5] == B.base_counts(text)


def quality_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 150))]
        bad = i % 4 == 0
        rows.append((i, " ".join(x + rng.choice("#%&") * 3 if bad else x for x in w) + "."))
        labels.append((i, 0 if bad else 1, int(i % 7 == 0)))
    return rows, labels


def test_rules_learn_and_keep(spark, none):
    rows, labels = quality_rows()
    lab = spark.createDataFrame([*labels, (5, None, None), (10**9, 0, 0)], "doc_id long, quality int, toxic int")
    got = found(quality_rules.quality_report(frame(spark, [*rows, (1000, ""), (1001, None)]), lab), "base_failed", "kept")
    assert all(got[i] == (False, q == 1) for i, q, _ in labels)
    assert got[1000] == got[1001] == (True, False)
    assert quality_rules.quality_report(none, lab).count() == 0
    assert quality_rules.quality_report(frame(spark, rows), lab.limit(0)).where("kept").count() == len(rows)
    assert quality_rules.keep_good(frame(spark, rows), lab).count() == 300


def test_a_rule_list_is_an_ordered_conditional():
    x = {"a": np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9] * 20, float), "b": np.tile([0.0, 1.0], 100)}
    rules = quality_rules.learn_list(x, x["a"] >= 7)
    assert [str(t) for r in rules for t in r] == ["a >= 6.5"]
    assert quality_rules.learn_list(x, np.zeros(200, bool)) == []


def test_quality_classifier_on_held_out_rows(spark, none):
    rows, labels = quality_rows()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = textstats.text_counts(frame(spark, [*rows, (1000, None)]))
    train = F.expr("crc32(cast(doc_id as string)) % 5 <> 0")
    got = found(quality_qda.quality_scores(counts, lab, train), "score", "predicted")
    right = [got[i][1] == q for i, q, _ in labels]
    assert np.mean(right) > 0.98 and 0 <= got[1000][0] <= 1
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in got.values())
    assert {s for s, _ in found(quality_qda.quality_scores(counts, lab.limit(0), train), "score", "predicted").values()} == {0.5}
    assert quality_qda.quality_scores(textstats.text_counts(none), lab, train).count() == 0


def test_toxicity_on_held_out_rows(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(80)]
        bad = i % 8 == 0
        if bad:
            w[rng.randrange(80)] = rng.choice(["zonk", "quibble", "vexo" + rng.choice("abcd") + "x"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame([*labels, (3, 1, None)], "doc_id long, quality int, toxic int")
    train = F.expr("crc32(cast(doc_id as string)) % 4 <> 2")
    got = found(toxicity_weak.toxicity_scores(frame(spark, [*rows, (1000, None), (1001, "")]), lab, train, support=4), "score", "predicted")
    assert np.mean([got[i][1] == t for i, _, t in labels]) > 0.98
    assert got[1000][1] == got[1001][1] == 0
    assert {s for s, _ in found(toxicity_weak.toxicity_scores(frame(spark, rows), lab.where("toxic = 0"), train), "score", "predicted").values()} == {0.5}
    assert toxicity_weak.toxicity_scores(none, lab, train, support=4).count() == 0


def test_mining_finds_rare_terms_behind_many_common_ones(spark):
    common = " ".join(hashlib.md5(str(i).encode()).hexdigest()[:9] for i in range(6000))
    rows = [(common + (" zonkers" if i < 4 else ""), 1) for i in range(5)] + [(common, 0)] * 8
    got = toxicity_weak.mine_voters(spark.createDataFrame(rows, "text string, label int"))
    assert (b"zonkers", 4, 4) in got and all(p == n == 4 for _, p, n in got)


def test_label_model_finds_accuracies_and_correlations():
    """Voters of both classes, one of them nearly a copy of another, one that is wrong half of the time."""
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    fire = lambda p, q: np.where(y, rng.random(4000) < p, rng.random(4000) < q)
    a, b, c, clean, poor = fire(0.7, 0.01), fire(0.6, 0.02), fire(0.5, 0.01), fire(0.02, 0.4), fire(0.2, 0.05)
    near = a & (rng.random(4000) < 0.98)
    table = np.column_stack([a, near, b, c, clean, poor])
    votes = toxicity_weak.Votes([np.flatnonzero(r).tolist() for r in table], 6)
    toxic = np.array([0.5, 0.5, 0.5, 0.5, 0.1, 0.3]), np.array([0.05, 0.05, 0.05, 0.05, 0.3, 0.05])
    model = toxicity_weak.fit_label_model(votes, 0.2, toxic, worth=0.02)
    assert {int(model.parent[0]), int(model.parent[1])} & {0, 1} and model.correlation[:2].max() > 0.9
    assert abs(model.correlation[2:]).max() < 0.5
    truth = np.array([y[v].mean() for v in table.T[:4]] + [1 - y[clean].mean(), y[poor].mean()])
    assert np.abs(model.accuracy - truth).max() < 0.08
    assert np.mean((model.posterior(votes) > 0.5) == y) > 0.93
    # two voters that are one weigh like one
    alone = toxicity_weak.Votes([[0, 1], [2], [0], []], 6)
    both, other, single, none = model.posterior(alone)
    assert abs(np.log(both / (1 - both)) - np.log(single / (1 - single))) < 4.5 and both > 0.5 > none


def test_voters_that_fire_together_are_one():
    votes = toxicity_weak.Votes([[0, 2, 3], [1], [0, 2], []], 4)
    once, twin = votes.merged()
    assert twin.tolist() == [0, 1, 0, 3] and once.m == 3
    assert [once.voter[once.row == i].tolist() for i in range(4)] == [[0, 2], [1], [0], []]
    x = np.array([[1, 0, 0.5], [0, 1, 0.2], [1, 1, 0.1], [0, 0, 0.9]])
    pairs = toxicity_weak.Votes([np.flatnonzero(r[:2]).tolist() for r in x], 2)
    y = np.array([0.9, 0.2, 0.6, 0.1])
    extra = np.column_stack([x[:, 2], np.ones(4)])
    w, full, penalty = toxicity_weak.fit_linear(pairs, extra, y), np.column_stack([x[:, :2], extra]), np.array([1, 1, 1, 1e-3])
    slope = full.T @ (1 / (1 + np.exp(-full @ w)) - y) + penalty * w
    assert np.abs(slope).max() < 1e-4


# ---- urls ------------------------------------------------------------------------------------


def test_urls(spark):
    rules = spark.createDataFrame(
        [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("Example.NET", "/", "block"), ("example.net", "/", "allow"), (None, "/", "block"), ("a.b", "/", "block"), ("b", "/xyz", "allow")],
        "host string, path string, verdict string",
    )
    urls = [
        "http://EXAMPLE.com/en/7?x", "http://www.example.com/en/8", "ftp://notexample.com/en/7", "https://com/en/", "http://example.net", "http://x.example.net/q",
        None, "", "no scheme", "://", "http://?q", "http://a.b/xyz", "http://b/xy", "http://acom/en/", "http://a\nb.com/en/\n#f",
    ]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(2)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == ("com/en/", "block")
    assert got[4] == ("example.net", "", None, "allow") and got[5][2:] == ("example.net/", "block")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow") and got[9] == got[10] == ("", "", None, "allow")
    assert got[11][2:] == ("b/xyz", "allow") and got[12][2:] == (None, "allow") and got[13][2:] == (None, "allow")
    assert got[14] == ("a\nb.com", "/en/\n", "com/en/", "block")
    split = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules, max_rules=2).collect()}
    assert split == got
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert url_filter.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(urls)


def test_several_rule_blocks_give_the_rows_of_one(spark):
    """Rules of equal length with hosts of unequal length, and repeated pages."""
    rows = [("com", "/bcdef", "block"), ("a.com", "/bcd", "allow"), ("b.a.com", "/b", "block"), ("", "/bcdefghi", "allow"), ("com", "/", "block"), ("x/y", "/", "allow")]
    rules = spark.createDataFrame(rows, "host string, path string, verdict string")
    urls = ["http://a.com/bcdef", "http://a.com/bcdef", "http://b.a.com/bcdefghi", "http://c.com/bcdef", "http://c.com/q", "http://org/q"]
    pages = spark.createDataFrame([(1, urls[0]), *enumerate(urls), (None, urls[0]), (None, urls[0])], "page_id long, url string").repartition(2)
    one, *many = (sorted(map(repr, url_filter.filter_urls(pages, rules, max_rules=n).collect())) for n in (100, 1, 2, 3))
    assert len(one) == 9 and sum("'a.com/bcd'" in x for x in one) == 5 and all(x == one for x in many)


# ---- archives --------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é b", "same"), (2, None, "same"), (3, "u\r\nX: y", ""), (4, "u", None), (5, "u", "x" * 300_000), (5, "u", "x" * 300_000), (None, "u", "same"), (7, "u", "ü")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, source string").repartition(3)
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, str(tmp_path / "w"), max_bytes=200).collect()))
    data = {h: (h or "").encode() for _, _, h in rows}
    digest = lambda h: base64.b32encode(hashlib.sha1(data[h]).digest()).decode()
    first = {"same": 1, "": 3, None: 3, "x" * 300_000: 5, "ü": 7}
    want = []
    for p, _, h in rows:
        revisit = p is not None and first[h] != p
        want.append((p or -1, len(data[h]), digest(h), "revisit" if revisit else "response", first[h] if revisit else None))
    assert got == sorted(want)
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


def _salvaged(data: bytes):
    s = warc.Salvage(lambda at, n: data[at : at + n], len(data))
    return [h["warc-record-id"].strip("<>") for _, _, h, _ in s], s.gaps


def test_salvage_of_damaged_archives():
    rng = random.Random(1)
    plain = [warc.page_record(i, f"http://h/{i}", bytes(rng.randrange(256) for _ in range(400)), None, "2024-01-01T00:00:00Z") for i in range(6)]
    names = [f"urn:x-page:{i}" for i in range(6)]
    for pack in (lambda x: gzip.compress(x, mtime=0), lambda x: x):
        parts = [pack(p) for p in plain]
        at = np.cumsum([0, *map(len, parts)])
        whole = b"".join(parts)
        assert _salvaged(whole) == (names, [])
        for hurt in range(6):
            bad = bytearray(whole)
            for i in range(at[hurt] + 60, at[hurt] + 64):
                bad[i] ^= 0xFF
            ids, gaps = _salvaged(bytes(bad))
            assert ids == names[:hurt] + names[hurt + 1 :]
            assert [g[:2] for g in gaps] == [(at[hurt], at[hurt + 1])]
        ids, gaps = _salvaged(whole[: at[3] + 30])
        assert ids == names[:3] and [g[:2] for g in gaps] == [(at[3], at[3] + 30)]
        ids, gaps = _salvaged(b"junk" + parts[0] + b"\0" * 50 + parts[1])
        assert ids == names[:2] and [g[:2] for g in gaps] == [(0, 4), (4 + len(parts[0]), 54 + len(parts[0]))]
    assert _salvaged(b"") == ([], [])
    assert _salvaged(b"no archive at all") == ([], [(0, 17, "no member or version line", None)])


def test_salvage_inside_damaged_members():
    """Several records a member: those before and behind a damaged record, a cut-off or failed gzip data come back."""
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abcdefgh") for _ in range(3000)) for _ in range(8)]
    plain = [warc.page_record(i, f"http://h/{i}", t, None, "2024-01-01T00:00:00Z") for i, t in enumerate(texts)]
    names = [f"urn:x-page:{i}" for i in range(8)]
    tail = gzip.compress(warc.page_record(99, "u", b"last", None, "d"))
    for hurt in (plain[3].replace(texts[3][:9], b"#" * 9), plain[3].replace(b"Content-Length: 3", b"Content-Length: 9"), plain[3][:500], b"?" + plain[3][1:]):
        pack = gzip.compress(b"".join([*plain[:3], hurt, *plain[4:]]))
        ids, gaps = _salvaged(pack + tail)
        assert ids == [*names[:3], *names[4:], "urn:x-page:99"]
        assert [g[:2] for g in gaps] == [(0, len(pack))]
        start = sum(map(len, plain[:3]))
        assert [g.inner for g in gaps] == [(start, start + len(hurt))]  # only the damaged record's bytes
    for level in (0, 6):  # stored blocks hold version lines that must not be read twice
        pack = gzip.compress(b"".join(plain), level)
        ids, gaps = _salvaged(pack[: len(pack) * 6 // 10])
        assert ids == names[:4] and gaps[0].start == 0 and gaps[-1].end == len(pack) * 6 // 10 and all(a.end == b.start for a, b in zip(gaps, gaps[1:]))
        assert gaps[0].inner[0] == sum(map(len, plain[:4]))
        bad = bytearray(pack)
        bad[-6] ^= 1  # the checksum only: digests vouch for every record
        ids, gaps = _salvaged(bytes(bad) + tail)
        assert ids == [*names, "urn:x-page:99"] and [g[:2] for g in gaps] == [(0, len(pack))]
        assert gaps[0].inner == (len(b"".join(plain)),) * 2  # no byte of a record
    for at in range(2000, len(pack) - 8, 997):
        bad = bytearray(pack)
        bad[at] ^= 0x55
        ids, gaps = _salvaged(bytes(bad) + tail)
        before = at * 8 // len(pack) - 1
        assert ids[: max(before, 0)] == names[: max(before, 0)] and ids[-1] == "urn:x-page:99" and len(set(ids)) == len(ids)
        spans = sorted({g[:2] for g in gaps})
        assert spans[0][0] == 0 and spans[-1][1] == len(pack) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_salvage_of_a_record_over_256_mib(tmp_path):
    size, piece = 257 << 20, bytes(1 << 20)
    sha = hashlib.sha1()
    for _ in range(257):
        sha.update(piece)
    digest = base64.b32encode(sha.digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {size + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"
    after = gzip.compress(warc.page_record(2, "u", b"after", None, "d"))
    for opener in (lambda p: gzip.open(p, "wb", 1), lambda p: open(p, "wb")):
        path = tmp_path / "a.warc.gz"
        with opener(path) as f:
            for data in (head.encode(), *[piece] * 257, b"\r\n\r\n"):
                f.write(data)
        with open(path, "ab") as f:
            f.write(after)
        with open(path, "rb") as f:
            salvage = warc.Salvage(lambda at, n, f=f: (f.seek(at), f.read(n))[1], path.stat().st_size)
            got = [(h["warc-record-id"], h.get("warc-payload-digest", "")[5:]) for _, _, h, _ in salvage]
        assert [i for i, _ in got] == ["<urn:x-page:1>", "<urn:x-page:2>"] and got[0][1] == digest and salvage.gaps == []


def test_reading_reports_gaps(spark, tmp_path):
    good = gzip.compress(warc.page_record(1, "u", b"abc", None, "d"))
    (tmp_path / "a.warc.gz").write_bytes(good + b"???" + good)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    names = spark.createDataFrame([(str(tmp_path / "a.warc.gz"),), (str(tmp_path / "b.warc.gz"),)], "archive string")
    rows = warc.read_archives(names, payloads=True).orderBy("offset").collect()
    assert [(r["kind"], r["offset"], r["end"]) for r in rows] == [("record", 0, len(good)), ("gap", len(good), len(good) + 3), ("record", len(good) + 3, 2 * len(good) + 3)]
    assert bytes(rows[0]["payload"]) == b"abc"


# ---- tokens ----------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path())
    lib.no_truncation(), lib.no_padding()
    texts = [t for _, t in ROWS] + ["It's we'll I'VE 12345 !!! internationalization", "<|endoftext|> a<|startoftext|>b <|x|>", "ΣΑΣ İstanbul É é ﬁ ½ 日本語 한국어 नमस्ते 👩‍👩‍👧", "a\x1cb\x85c\xa0d　e​f", "\x00\x01 \x7f", "﷐ ￾￿ x"]
    got = found(bpe_trie.encode_digests(frame(spark, list(enumerate(texts))), tokenizer_path()), "n_tokens", "ids_sha256", "decoded_sha256")
    ids = found(bpe_trie.encode(frame(spark, list(enumerate(texts))), tokenizer_path()), "ids")
    back = found(bpe_trie.decode(bpe_trie.encode(frame(spark, list(enumerate(texts))), tokenizer_path()), tokenizer_path()), "text")
    for i, t in enumerate(texts):
        want = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(want, skip_special_tokens=False)
        assert ids[i][0] == want and back[i][0] == text
        assert got[i] == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_trie.encode(none, tokenizer_path()).count() == 0


def test_bpe_forgets_words_without_changing_results(monkeypatch):
    monkeypatch.setattr(bpe_trie, "CACHE_WORDS", 50)
    monkeypatch.setattr(bpe_trie, "CACHE_PAIRS", 20)
    monkeypatch.setattr(bpe_trie, "GROUP", 3)
    monkeypatch.setattr(bpe_trie, "GROUP_BYTES", 500)
    texts = [t for _, t in ROWS]
    small = list(bpe_trie.TrieBPE(tokenizer_path()).encode_batch(texts))
    monkeypatch.undo()
    assert small == list(bpe_trie.TrieBPE(tokenizer_path()).encode_batch(texts))
    packed = bpe_trie.TrieBPE(tokenizer_path(), packed=True)
    ids = [np.frombuffer(b"".join(row), np.int32).tolist() for row in packed.encode_batch(texts)]
    assert ids == [[int(i) for _, one, _ in row for i in one.split()] for row in small]


def test_bpe_keeps_no_long_words():
    texts = ["a" + "bc" * 400 + " short", "<|endoftext|> a" + "bc" * 400, "short"]
    bpe = bpe_trie.TrieBPE(tokenizer_path())
    first = list(bpe.encode_batch(texts))
    assert max(map(len, bpe.known)) <= bpe_trie.LONG_WORD
    assert first == list(bpe.encode_batch(texts))


# ---- chats -----------------------------------------------------------------------------------


def test_chat_linking(spark):
    call = lambda i, name, args: json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": args}]})
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "system", "be \"kind\"\n"), (1, 1, "tool", result("a", "early")), (1, 2, "assistant", call("a", "add", {"y": 2, "x": 1.5})),
        (1, 3, "assistant", call("a", "add", {"x": 9, "y": 9})), (1, 4, "tool", result("zz", "lost")), (1, 5, "assistant", call("b", "add", {"x": "1", "q": None})),
        (1, 6, "assistant", call("c", "nope", {})), (2, 0, "tool", result("a", "other conversation")), (2, 1, "user", None), (2, 1, "user", None), (3, 0, "assistant", '{"tool_calls": 5}'),
    ]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn int, role string, text string, call string")
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True)], "name string, field string, type string, required boolean")
    got = chat_format.link_events(chat_format.tool_events(turns), schemas).orderBy("conv_id", "place", "depth", "rank", "turn", "id").collect()
    one = [(r["turn"], r["kind"], r["status"], r["errors"]) for r in got if r["conv_id"] == 1]
    assert one == [
        (0, "message", "message", ""), (2, "call", "linked", ""), (1, "result", "linked", ""), (3, "call", "duplicate", ""),
        (4, "result", "orphan", ""), (5, "call", "invalid", "missing y; type of x; unknown q"), (6, "call", "invalid", "unknown tool"),
    ]
    assert [r["json"] for r in got if r["conv_id"] == 1][:2] == [
        '{"content":"be \\"kind\\"\\n","role":"system","type":"message"}',
        '{"arguments":{"x":1.5,"y":2},"id":"a","name":"add","status":"linked","type":"call"}',
    ]
    two = [(r["kind"], r["status"]) for r in got if r["conv_id"] == 2]
    assert two == [("result", "orphan"), ("message", "message"), ("message", "message")]
    for r in got:
        keys = list(json.loads(r["json"]))
        assert keys == sorted(keys)
    assert chat_format.link_events(chat_format.tool_events(turns.limit(0)), schemas).count() == 0
    plain = chat_format.link_events(chat_format.turn_events(turns), schemas.limit(0))
    assert plain.count() == len(rows)
