"""Plain single-machine versions of the contracts, slow and direct."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import xxhash

_ASCII_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def lower(text: str) -> str:
    return text.translate(_ASCII_UPPER)


def alnum_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def simhash(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    prints = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fp = np.array([prints[d] for d in docs], np.uint64)
    for i, d in enumerate(docs):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= 2):
            a, b = find(d), find(docs[i + 1 + j])
            root[max(a, b)] = min(a, b)
    return {d: (f"{prints[d]:016x}", find(d)) for d in docs}


def contamination(rows, bench, size: int = 10) -> dict[int, tuple]:
    windows = defaultdict(set)
    for item, text in bench:
        w = alnum_words(text)
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i:i + size])].add(item)
    sizes = {len(x) for x in windows}
    out = {}
    for doc, text in rows:
        w = alnum_words(text)
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        ids = ",".join(sorted(str(i) for i in items))
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def substrings(rows, size: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            s = hashlib.blake2b(b[i:i + size], digest_size=12).digest()
            if s in seen:
                gone[i:i + size] = b"\1" * size
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def warc(rows) -> dict[int, tuple]:
    first = {}
    for page, html in sorted(rows):
        first.setdefault((html or "").encode(), page)
    out = {}
    for page, html in rows:
        b = (html or "").encode()
        again = len(b) >= 100 and first[b] != page
        out[page] = (
            len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None
        )
    return out


def ids(tokenizer, text: str | None, end: int) -> np.ndarray:
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def token_file(rows, tokenizer, end: int = 2) -> dict[int, tuple]:
    out, at = {}, 0
    for doc, text in sorted(rows):
        x = ids(tokenizer, text, end)
        out[doc] = (at, len(x), crc32(x.tobytes()))
        at += len(x)
    return out


def pieces(rows, tokenizer, end: int = 0, size: int = 2048) -> dict[tuple[int, int], tuple]:
    out = {}
    for doc, text in rows:
        x = ids(tokenizer, text, end)
        for p in range(0, len(x), size):
            out[doc, p // size] = (p, len(x[p:p + size]), crc32(x[p:p + size].tobytes()))
    return out


def base_phrases(rows) -> dict[int, tuple]:
    out = {}
    for doc, text in rows:
        w = alnum_words(text)
        at, labels = [], set()
        for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"),
                              ("all rights reserved", "reserved")):
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        out[doc] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out


def edited(rows) -> dict[int, tuple]:
    order = sorted(rows, reverse=True)
    out = {}
    for i, (doc, text) in enumerate(order):
        t, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[:len(t) - cut] + nxt[:cut]
        out[doc] = (len(t), hashlib.sha256(e.encode()).hexdigest(), e, nxt)
    return out


def merkle_root(text: str) -> str:
    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    def blocks(p):
        return [sha(p[i:i + 32]) for i in range(0, max(len(p), 1), 32)]

    return sha("d" + "".join(
        sha("s" + "".join(sha("p" + "".join(blocks(p))) for p in s.split("\n"))) for s in text.split("\n\n")
    ))


def merkle_likeness(a: str, b: str) -> float:
    def leaves(text):
        return {p[i:i + 32] for s in text.split("\n\n") for p in s.split("\n") for i in range(0, max(len(p), 1), 32)}

    x, y = leaves(a), leaves(b)
    return 2 * len(x & y) / (len(x) + len(y))


def lines(rows, max_ratio: float = 0.1, min_pages: int = 5) -> dict[int, tuple]:
    """rows of (doc_id, text, source)."""
    pages = defaultdict(set)
    for _, text, source in rows:
        if text is not None:
            pages[source].add(text)
    often = {}
    for source, texts in pages.items():
        n = Counter(x for t in texts for x in {y.strip(" \t\r") for y in t.split("\n")} if x)
        often[source] = {x for x, c in n.items() if c >= min_pages and c > max_ratio * len(texts)}
    out = {}
    for doc, text, source in rows:
        if text is None:
            out[doc] = (0, 0, None)
            continue
        every = text.split("\n")
        kept = [x for x in every if x.strip(" \t\r") not in often[source]]
        out[doc] = (sum(1 for x in every if x.strip(" \t\r")), len(every) - len(kept), "\n".join(kept))
    return out


def collocations(rows, order=3, least=10, cover=50, top=2000) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    count: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, order + 1):
                count["und" if lang is None else lang].update(tuple(w[i:i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = [(g, a) for g, a in f.items() if len(g) >= 2 and a >= least]
        covered = set()
        for g, a in often:
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    if 100 * a >= cover * f[g[i:i + size]]:
                        covered.add(g[i:i + size])
        found = []
        for g, a in often:
            if g not in covered:
                score, _, l, r = min(
                    (1000000 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g))
                )
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def hard_negatives(rows, asks, low=80, high=100, positives=5, negatives=5) -> list[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) of (vec_id, label, vector) rows."""
    rows = [
        (i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    first = {}
    for i, label, v in sorted(rows):
        if asks(i):
            first.setdefault(i, (label, v))
    for i, (label, v) in first.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in rows if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(k, -n) for n, k, other in scored if other != label and low * -p <= 100 * -n <= high * -p]
            out += [(i, j, rank, k, -p, n) for rank, (k, n) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def shingle_set(text: str | None, size: int = 2) -> set[str]:
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def minhash(rows, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id to (set size, smallest doc_id linked) by all pairs."""
    sets = {doc: shingle_set(text) for doc, text in rows}
    docs = sorted(sets)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(docs):
        for b in docs[i + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}
