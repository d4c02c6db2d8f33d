"""Hashed features of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

from .common import GOLDEN, SPACE, fmix, hash_spans, words_of

#: Bytes of letters (all bytes of non-ASCII characters too) and digits make words; others part them.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: The kind of each byte: A upper, a lower or non-ASCII, 0 digit; the rest stand for themselves.
KIND = np.arange(256, dtype=np.uint8)
KIND[65:91], KIND[97:123], KIND[128:], KIND[48:58] = ord("A"), ord("a"), ord("a"), ord("0")
STAT_BINS = 16
STEM = 6


def chain(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of pairs, in order."""
    return fmix(a * GOLDEN + b + np.uint64(salt))


def neighbours(h: np.ndarray, doc: np.ndarray, step: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words ``step`` apart in one document: (document, hash)."""
    same = doc[step:] == doc[:-step]
    return doc[step:][same], chain(h[:-step][same], h[step:][same], salt)


def gram_features(found: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word, stem, word pair and pair with one word between, repeats included.

    The stem is a longer word's first ``STEM`` bytes, so inflected and compound forms share a feature.
    """
    data, starts, ends, counts = words_of(found, space=NOT_WORD)
    h = hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(len(found)), counts)
    long = ends - starts > STEM
    stems = (doc[long], fmix(hash_spans(data, starts[long], starts[long] + STEM)))
    parts = [(doc, h), stems, neighbours(h, doc, 1, 1), neighbours(h, doc, 2, 2)]
    return np.concatenate([d for d, _ in parts]), (np.concatenate([x for _, x in parts]) >> np.uint64(64 - bits)).astype(np.int64)


def distinct(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (document, feature) once, sorted, with its count."""
    key = np.sort(doc.astype(np.int64) << bits | feature)
    if not len(key):
        return key, key, key
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at] >> bits, key[at] & ((1 << bits) - 1), np.diff(at, append=len(key))


def _statistics(found: list[bytes], data: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Shares and means of each text, scaled to 0..1: one column for each."""
    n = len(found)
    doc = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    size = np.fromiter(map(len, found), np.int64, n)
    a = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    base = np.cumsum(size + 1) - size - 1
    total = np.maximum(size, 1)
    share = lambda mask: np.add.reduceat(mask.astype(np.int64), base) / total
    kind = KIND[a]
    letters = (kind == 65) | (kind == 97)
    unique = np.bincount(distinct(doc, (h >> np.uint64(24)).astype(np.int64), 40)[0], minlength=n) / words
    lines = [x.split(b"\n") for x in found]
    repeated = np.array([1 - len(set(x)) / len(x) for x in lines])
    mean_line = np.array([s / len(x) for s, x in zip(size, lines, strict=True)])
    mean_word = np.bincount(doc, weights=ends - starts, minlength=n) / words
    return np.stack([np.minimum(mean_word / 20, 1), unique, share(kind == 65), share(kind == 48), share(~letters & ~SPACE[a] & (kind != 48)), repeated, np.minimum(np.log2(1 + mean_line) / 14, 1), np.minimum(np.log2(1 + counts) / 14, 1)], axis=1)


def quality_features(found: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) of texts: words, shapes of words, pairs of shapes, binned statistics.

    Each kind's values are root frequencies of unit length, so a text's length doesn't count.
    """
    n = len(found)
    data, starts, ends, counts = words_of(found, space=NOT_WORD)
    h = hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(n), counts)
    kinds = KIND[np.frombuffer(b" ".join(found) + b" ", np.uint8)]
    # Runs of one kind fall together: "Word,!!" is "Aa,!".
    keep = np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (kinds[1:] == 32)))
    size = np.fromiter(map(len, found), np.int64, n)
    kept = np.concatenate(([0], np.cumsum(keep)))
    bounds = np.cumsum(size + 1)
    short = kinds[keep].tobytes()
    cuts = np.concatenate(([0], kept[bounds]))
    shapes = [short[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    sdata, s, e, c = words_of(shapes)
    sh = hash_spans(sdata, s, e)
    sdoc = np.repeat(np.arange(n), c)
    pairs = neighbours(sh, sdoc, 1, 3)
    out = []
    for salt, (d, x) in enumerate(((doc, h), (sdoc, sh), pairs)):
        d, f, count = distinct(d, (fmix(x + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64), bits)
        total = np.maximum(np.bincount(d, weights=count, minlength=n), 1)
        out.append((d, f, np.sqrt(count / total[d])))
    stats = _statistics(found, data, starts, ends, counts, h)
    cell = np.minimum((stats * STAT_BINS).astype(np.int64), STAT_BINS - 1) + STAT_BINS * np.arange(stats.shape[1])
    out.append((np.repeat(np.arange(n), stats.shape[1]), cell.ravel(), np.full(cell.size, 0.5)))
    doc, feature, value = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(doc, kind="stable")
    return doc[order], feature[order], value[order]
