"""BPE encoding and decoding by prefix-sharing trie traversal.

The byte-pair encoding of a string is determined from its prefixes: exactly one
vocabulary token t can end a prefix such that the last token of what precedes it
and t are a compatible pair, i.e. no merge across their border would have come
first.  So every prefix needs just one number, its last token.  The distinct
words of a batch are inserted into a trie (kept implicit: words in sorted order
with their longest common prefixes visit it depth first) and the last-token
states of the current path are a stack; a prefix that many words share is
encoded once.  Following last tokens backwards from a word's end gives its ids.

The vocabulary file is a parameter and is read on the executors; one of another
kind (normaliser, splitter, model) is refused.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkogram.llm.textops import pieces, tidy, worker_table

#: Beyond this many entries a worker forgets the words that the last group of texts did not have.
CACHE_WORDS = 300_000
CACHE_PAIRS = 200_000
#: Longer words are forgotten after their group, so that the entries bound the bytes.
LONG_WORD = 64
#: Texts, and bytes of text, whose new words share one trie.
GROUP = 2048
GROUP_BYTES = 4 << 20
#: Stands for a word's end in the suffix index; no byte maps to it.
_END = "\uffff"

#: Characters beyond Latin letters, general punctuation aside.
_FOREIGN = regex.compile("[^\\u0000-\\u024f\\u2010-\\u2027\\u20ac]")
#: First characters of words from the library and of special tokens (never in a normalised word: control characters of their own).
_MARK, _ADDED = "\ufffe", "\ufdd0"


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 as is, others from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(keep) else chr(next(rest)) for b in range(256)]


#: Settings of a vocabulary file that :class:`TrieBPE` implements.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def _check(spec: dict) -> None:
    """Refuse vocabulary files whose normaliser, splitter or model work in another way."""
    splitter = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    fits = (
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
        and [x.get("type") for x in splitter] == ["Split", "ByteLevel"]
        and (splitter[0].get("behavior"), splitter[0].get("invert")) == ("Removed", True)
        and not (splitter[1].get("add_prefix_space") or splitter[1].get("use_regex"))
        and spec.get("decoder") is None
        and all(spec["model"].get(k, v) == v for k, v in _MODEL.items())
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )
    if not fits:
        raise ValueError("a vocabulary file of another kind: normaliser, splitter, model or decoder differ")


class TrieBPE:
    """Vocabulary tables and the traversal; a known word has its ids packed, or written out with their texts."""

    def __init__(self, path: str, packed: bool = False):
        self.path, self.packed = path, packed
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        _check(spec)
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.text = {i: t for t, i in self.vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.alphabet = _byte_alphabet()
        # order: base symbols first, then merged tokens by the rank of their merge
        merged, self.order, self.parts = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = self.vocab[a + b]
            if token in merged:
                raise ValueError(f"two merges make {a + b!r}")
            merged[token] = (rank, self.vocab[a], self.vocab[b])
        base = [i for i in self.vocab.values() if i not in merged]
        self.order = {i: n for n, i in enumerate(base)} | {i: len(base) + m[0] for i, m in merged.items()}
        back = {n: i for i, n in self.order.items()}
        self.token_of = back
        self.parts = {n: (n, n) for n in range(len(base))}
        self.parts |= {self.order[i]: (self.order[a], self.order[b]) for i, (_, a, b) in merged.items()}
        self.joined = {parts: n for n, parts in self.parts.items() if n >= len(base)}
        self.tokens = {s: self.order[i] for s, i in self.vocab.items() if self._reachable(self.order[i])}
        self._index_suffixes()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] | dict[str, tuple[int, str, str]] = {}
        self.library = None

    def _index_suffixes(self) -> None:
        """Aho-Corasick tables: per state the tokens that end there, longest first.

        A word's end is a character of its own, so tokens with the end suffix
        are found by one more step.
        """
        self.go: list[dict[str, int]] = [{}]
        own: dict[int, tuple[int, int]] = {}
        for text, n in self.tokens.items():
            ends = bool(self.end) and text.endswith(self.end)
            raw, at = text[: len(text) - len(self.end) * ends], 0
            for c in raw + _END * ends:
                if c not in self.go[at]:
                    self.go[at][c] = len(self.go)
                    self.go.append({})
                at = self.go[at][c]
            own[at] = (len(raw), n)
        self.fall = [0] * len(self.go)
        self.outs: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)
        queue = deque(self.go[0].values())
        for at in queue:
            self.outs[at] = (own[at],) if at in own else ()
        while queue:
            at = queue.popleft()
            for c, to in self.go[at].items():
                back = self._step(self.fall[at], c)
                self.fall[to] = back
                self.outs[to] = ((own[to],) if to in own else ()) + self.outs[back]
                queue.append(to)

    def _step(self, at: int, c: str) -> int:
        go = self.go
        while at and c not in go[at]:
            at = self.fall[at]
        return go[at].get(c, 0)

    def _compatible(self, a: int, b: int, limit: int) -> bool:
        """Would BPE leave the border between tokens a and b alone, merges from ``limit`` on aside?

        Both tokens are taken apart again, the later merge first; a merge across
        the border that ranks before the one just undone would have come first.
        """
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                undone, a = a, self.parts[a][1]
                if a != undone:
                    limit = undone
                    continue
                limit, b2 = b + 1, self.parts[b][0]
                if b2 == b:
                    return True
                b = b2
            else:
                undone, b = b, self.parts[b][0]
                if b != undone:
                    limit = undone + 1
                    continue
                limit, a2 = a, self.parts[a][1]
                if a2 == a:
                    return True
                a = a2

    @lru_cache(maxsize=None)  # noqa: B019  one object per worker
    def _reachable(self, n: int) -> bool:
        """Does BPE encode the token's own text as the token?"""
        a, b = self.parts[n]
        return a == n or (self._reachable(a) and self._reachable(b) and self._compatible(a, b, n))

    def _fits(self, a: int, b: int) -> bool:
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        good = self.pairs[a << 20 | b] = self._compatible(a, b, 1 << 60)
        return good

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words (already in the byte alphabet)."""
        out: dict[str, list[int]] = {}
        go, fall, outs, pairs, token_of = self.go, self.fall, self.outs, self.pairs, self.token_of
        # per depth of the current path: automaton state, last token, where it begins
        states, last, begins, before = [0], [-1], [0], ""
        for word in sorted(words):
            shared, n = 0, len(word)
            most = min(len(states), n) - 1
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], last[shared + 1 :], begins[shared + 1 :]
            state, i = states[shared], shared
            while i < n:
                c = word[i]
                while state and c not in go[state]:
                    state = fall[state]
                state = go[state].get(c, 0)
                i += 1
                at = state
                if i == n and self.end:
                    while at and _END not in go[at]:
                        at = fall[at]
                    at = go[at].get(_END, 0)
                for size, t in outs[at]:
                    if size == i:
                        break
                    good = pairs.get(last[i - size] << 20 | t)
                    if good or (good is None and self._fits(last[i - size], t)):
                        break
                else:
                    raise ValueError(f"no encoding of {word!r}")
                if i < n:
                    states.append(state), last.append(t), begins.append(i - size)
            ids, j = [token_of[t]], n - size
            while j:
                ids.append(token_of[last[j]])
                j = begins[j]
            out[word] = ids[::-1]
            before = word
        return out

    def words(self, text: str) -> list[str]:
        """Normalised words of a text.

        Beyond Latin letters the classes depend on the Unicode version, so the
        library's own normaliser and splitter are asked, which give words in the
        byte alphabet; those are marked.
        """
        if not _FOREIGN.search(text):
            return self.pieces.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        low = self.library.normalizer.normalize_str(text)
        return [_MARK + p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def _learn(self, words: set[str]) -> None:
        """Encode words that are not known yet."""
        form = {}
        for w in words:
            if w[0] == _MARK:
                form[w] = w[1:]
            elif w.isascii() and w.isprintable():
                form[w] = w
            else:
                form[w] = w.encode().decode("latin-1").translate(self.alphabet)
        ids = self.encode_words(set(form.values()))
        self.known.update((w, self._entry(ids[f])) for w, f in form.items())

    def _entry(self, ids: list[int]) -> bytes | tuple[int, str, str]:
        if self.packed:
            return array("i", ids).tobytes()
        return len(ids), " ".join(map(str, ids)), " ".join([self.text[t] for t in ids])

    def encode_batch(self, texts: list[str | None]) -> Iterator[list]:
        """Per text its words' entries: the ids as 32-bit bytes, or (number of ids, ids as text, tokens as text)."""
        known = self.known
        for at in range(0, len(texts), GROUP):
            split, seen = [], set()
            for text in texts[at : at + GROUP]:
                if text and "<|" in text:
                    row = []
                    for s in self.split_added.split(text):
                        row += [_ADDED + s] if s in self.added else self.words(s)
                else:
                    row = self.words(text) if text else []
                split.append(row)
                seen.update(row)
            fresh = seen.difference(known)
            special = {w for w in fresh if w[0] == _ADDED}
            known.update((w, self._entry([self.added[w[1:]]])) for w in special)
            self._learn(fresh - special)
            for row in split:
                yield [known[w] for w in row]
            for w in [w for w in fresh if len(w) > LONG_WORD]:
                del known[w]
            if len(known) > CACHE_WORDS:
                kept = {w: known[w] for w in seen if w in known} if 2 * len(seen) < CACHE_WORDS else {}
                known.clear()
                known.update(kept)

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, special tokens included; nulls and ids beyond the vocabulary are left out."""
        return " ".join([self.text[i] for i in ids if i in self.text])


#: What a worker keeps its tables under.
_KEEPS = "bpe"


def coder(path: str, packed: bool = False) -> TrieBPE:
    """The worker's coder, made anew for another file; its words are forgotten for another form of entries."""
    got = worker_table(_KEEPS, lambda: TrieBPE(path, packed))
    if got.path != path:
        got.__init__(path, packed)
    elif got.packed != packed:
        got.packed = packed
        got.known.clear()
    return got


def encode_batches(path: str):
    """mapInArrow function: (doc_id, text) to (doc_id, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, packed=True)
        for part in pieces(batches, 1, most=GROUP_BYTES, rows=GROUP):
            ids = [b"".join(row) for row in bpe.encode_batch(part.column(1).to_pylist())]
            size = [len(x) // 4 for x in ids]
            offsets = pa.array(np.cumsum([0, *size]).astype(np.int32))
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "n_tokens", "ids"],
            )

    return run


def digest_batches(path: str):
    """mapInArrow function: (doc_id, text) to (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in pieces(batches, 1, most=GROUP_BYTES, rows=GROUP):
            n, ids, back = [], [], []
            for row in bpe.encode_batch(batch.column(1).to_pylist()):
                n.append(sum([k[0] for k in row]))
                ids.append(hashlib.sha256(" ".join([k[1] for k in row]).encode()).hexdigest())
                back.append(hashlib.sha256(" ".join([k[2] for k in row]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def decode_batches(path: str):
    """mapInArrow function: (doc_id, ids) to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                texts = [bpe.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of every row; no shuffle.

    Defined results: a null, empty or blank text has no ids; special tokens
    written out in a text become their ids; repeated and null ids keep one row
    each; an empty table gives no rows; other columns are ignored.
    """
    return _source(docs, doc_id, text).mapInArrow(tidy(encode_batches(path), _KEEPS), "doc_id long, n_tokens long, ids array<int>")


def encode_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Like :func:`encode`, with SHA-256 of the ids and of the decoded text instead of the ids."""
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _source(docs, doc_id, text).mapInArrow(tidy(digest_batches(path), _KEEPS), fields)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids).

    Defined results: null or empty ids give an empty text; nulls among the ids and
    ids beyond the vocabulary are left out, as the library does; null and repeated
    doc_ids keep a row each; an empty table gives no rows; other columns are ignored.
    """
    return tokens.select("doc_id", "ids").mapInArrow(tidy(decode_batches(path), _KEEPS), "doc_id long, text string")
