"""Small corpora with planted cases, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

ODD = ["", None, " \t\n", "one", "two words", "a b c d", "x " * 3000, "é" * 50, "tie tie tie tie tie tie tie tie"]
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def corpus(seed: int = 3, n: int = 120) -> list[tuple[int, str | None]]:
    """Random documents, exact and near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = make(70)
    docs: list[str | None] = list(ODD)
    for i in range(n):
        kind = i % 6
        if kind == 0 or len(docs) < 12:
            docs.append(" ".join(make(rng.randrange(20, 200))))
        elif kind == 1:
            docs.append(rng.choice([d for d in docs if d]))
        elif kind in (2, 3):
            w = rng.choice([d for d in docs if d and len(d.split()) > 60]).split()
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append(" ".join(w).title() if kind == 2 else "\n".join(w))
        elif kind == 4:
            docs.append(" ".join(make(30) + passage[rng.randrange(15) :] + make(25)))
        else:
            docs.append("  ".join(make(rng.randrange(1, 60))) + ".")
    ids = list(range(len(docs)))
    rng.shuffle(ids)
    return list(zip(ids, docs, strict=True))


def near_duplicates(rows, k=5, percent=85):
    sets = {}
    for d, t in rows:
        w = [x.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for x in words(t)]
        n = min(k, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def substrings(rows, m=50):
    toks, first = {d: words(t) for d, t in rows}, {}
    for d in sorted(toks):
        for i in range(len(toks[d]) - m + 1):
            first.setdefault(tuple(toks[d][i : i + m]), d)
    out = {}
    for d, w in toks.items():
        gone = [False] * len(w)
        for i in range(len(w) - m + 1):
            if first[tuple(w[i : i + m])] < d:
                gone[i : i + m] = [True] * m
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def contamination(rows, items, window=10):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    cut = lambda t: ALNUM.findall((t or "").encode().translate(low))
    wins = {}
    for name, t in items:
        w = cut(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in rows:
        w, hit, who = cut(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                got = wins.get(tuple(w[i : i + n]))
                if got:
                    hit |= set(range(i, i + n))
                    who |= got
        out[d] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit))
    return out


def base_counts(text):
    w, t = words(text), text or ""
    cov = set()
    seen: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cov |= {i + k for i in at for k in range(3)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(cov))
