"""Token ids of whole texts by the tokenizers library, with a cache of what lies between sure token boundaries."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from . import common


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Kinds of bytes. Up to PUNCT two neighbours of different known kinds are two tokens; from SPACE on they are, or may be, white space.
OTHER, LETTER, DIGIT, PUNCT, SPACE, LINE, WHITE, LEAD, DOUBT = range(9)


def _kinds() -> bytes:
    kinds = bytearray([WHITE] * 33 + [PUNCT] * 94 + [WHITE] + [OTHER] * 128)
    for x in b"0123456789":
        kinds[x] = DIGIT
    for x in range(26):
        kinds[65 + x] = kinds[97 + x] = LETTER
    kinds[32], kinds[10] = SPACE, LINE
    for x in (0xC3, 0xC4, 0xC5, 0xD0, 0xD1):  # first bytes of characters that are letters but for two
        kinds[x] = LEAD
    for x in (0xC2, 0xE1, 0xE2, 0xE3, 0xEF):  # first bytes of white space, among others
        kinds[x] = DOUBT
    return bytes(kinds)


KINDS = _kinds()
#: Masks of the first bytes of a little-endian 64-bit word.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Bytes of text that numpy works on at once.
SLICE = 1 << 20
#: A boundary at any place of any text.
SURE = re.compile(rb"[A-Za-z](?= [A-Za-z])")


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(which bytes surely begin a word of the byte-level pattern, which are white space or may be), by their near neighbours alone.

    Sure are: a single space or line end between two characters that are no white space (a space goes with what follows,
    a line end stands alone); a change among letters, digits and punctuation, except from an apostrophe to a letter.
    """
    a = np.frombuffer(data + bytes(2), np.uint8)
    kind = np.frombuffer(bytearray(data.translate(KINDS)), np.uint8)
    lead = np.flatnonzero(kind == LEAD)
    if lead.size:
        letter = np.where((a[lead] == 0xC3) & ((a[lead + 1] == 0x97) | (a[lead + 1] == 0xB7)), OTHER, LETTER)
        kind[lead] = kind[lead + 1] = letter
    doubt = np.flatnonzero(kind == DOUBT)
    if doubt.size:
        x, y, z = a[doubt], a[doubt + 1], a[doubt + 2]
        two = (x == 0xC2) & (y <= 0xA0)
        three = ((x == 0xE1) & ((y == 0x9A) & (z == 0x80) | (y == 0xA0) & (z == 0x8E))) | ((x == 0xE3) & (y == 0x80) & (z == 0x80)) | ((x == 0xEF) & (y == 0xBB) & (z == 0xBF))
        three |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8F) | (z >= 0xA8) & (z <= 0xAF)) | (y == 0x81) & (z >= 0x9F) & (z <= 0xAF))
        kind[doubt] = np.where(two | three, WHITE, OTHER)
        kind[doubt[two | three] + 1] = WHITE
        kind[doubt[three] + 2] = WHITE
    white = kind >= SPACE
    cut = np.zeros(len(kind), bool)
    if len(kind) > 1:
        before, here = kind[:-1], kind[1:]
        one = np.uint8(1)
        cut[1:] = (before != here) & (before - one < PUNCT) & (here - one < PUNCT) & ((a[: len(kind) - 1] != 39) | (here != LETTER))
        alone = ~(white[:-2] | white[2:])
        line = alone & (kind[1:-1] == LINE)
        cut[1:-1] |= line | alone & (kind[1:-1] == SPACE)
        cut[2:] |= line
    return cut, white


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    A byte-level BPE with the usual word pattern encodes each word of the pattern by itself, so a text
    falls into pieces at ``boundaries``, most of which were seen before. Pieces of up to 16 bytes are found in a
    hash table by these bytes themselves, all pieces of a slice of text at once; longer ones in a dict. Texts that hold special
    tokens or zero bytes, and all texts of a tokenizer of another build, go to the library whole.
    The cache is emptied when it holds ``most`` pieces, which bounds its memory.
    """

    def __init__(self, path: str | None = None, most: int = 1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.most = most
        made = json.loads(self.tokenizer.to_str())
        first = made["pre_tokenizer"] or {}
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.usual = (
            first.get("type") == "ByteLevel" and first.get("use_regex") is True and first.get("add_prefix_space") is False
            and not any(made.get(x) for x in ("normalizer", "truncation", "padding")) and not made["model"].get("dropout") and len(self.line) == 1
        )
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._empty()

    def _empty(self) -> None:
        self.size = self.held = self.used = 0
        self.long: dict[bytes, int] = {}
        self.at, self.n, self.pool = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)
        self._table(1 << 12)

    def _table(self, slots: int) -> None:
        self.filled, self.slots = 0, np.full(slots, -1, np.int32)
        self.key1, self.key2 = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)

    def _slot(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        h = (key1 ^ (key2 * common.GOLDEN)) * common.MIX1
        h ^= h >> np.uint64(32)
        h *= common.MIX2
        return (h >> np.uint64(65 - len(self.slots).bit_length())).view(np.int64)

    def _find(self, key1: np.ndarray, key2: np.ndarray) -> np.ndarray:
        """The piece of each key, -1 where it is not held."""
        slot, last = self._slot(key1, key2), len(self.slots) - 1
        found = self.slots[slot]
        left = np.flatnonzero((found >= 0) & ((self.key1[slot] != key1) | (self.key2[slot] != key2)))
        while left.size:
            slot[left] = here = (slot[left] + 1) & last
            found[left] = now = self.slots[here]
            left = left[(now >= 0) & ((self.key1[here] != key1[left]) | (self.key2[here] != key2[left]))]
        return found

    def _insert(self, key1: np.ndarray, key2: np.ndarray, piece: np.ndarray) -> None:
        """Add keys that are distinct and not held."""
        if 2 * (self.filled + len(piece)) > len(self.slots):
            taken = np.flatnonzero(self.slots >= 0)
            old = self.key1[taken], self.key2[taken], self.slots[taken]
            self._table(1 << (4 * (self.filled + len(piece))).bit_length())
            self._insert(*old)
        self.filled += len(piece)
        slot, last, left = self._slot(key1, key2), len(self.slots) - 1, np.arange(len(piece))
        while left.size:
            free = left[self.slots[slot[left]] < 0]
            self.slots[slot[free]] = piece[free]
            mine = self.slots[slot[left]] == piece[left]
            won, left = left[mine], left[~mine]
            self.key1[slot[won]], self.key2[slot[won]] = key1[won], key2[won]
            slot[left] = (slot[left] + 1) & last

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _put(self, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """New pieces, whose ids are runs of ``ids``."""
        size, used = self.size + len(starts), self.used + len(ids)
        if size > len(self.at):
            self.at, self.n = (np.concatenate([x[: self.size], np.zeros(2 * size - self.size, np.int64)]) for x in (self.at, self.n))
        if used > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(2 * used - self.used, np.uint32)])
        self.at[self.size : size], self.n[self.size : size], self.pool[self.used : used] = starts + self.used, counts, ids
        self.size, self.used = size, used

    def _add(self, plain: list[bytes], odd: list[bytes]) -> None:
        """Encode new pieces. Plain ones hold no white space but a space before others, so they go 200 at a time as lines of one text: a line end before any of them is a token by itself."""
        base = self.size
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        for at in range(0, len(groups), 50):
            some = groups[at : at + 50]
            for words, ids in zip(some, self._plain([b"\n".join(g).decode() for g in some]), strict=True):
                cuts = np.flatnonzero(ids == self.line[0])
                if len(cuts) != len(words) - 1:
                    for one in self._plain([x.decode() for x in words]):
                        self._put(one, np.zeros(1, np.int64), np.array([len(one)]))
                    continue
                starts = np.concatenate([[0], cuts + 1])
                self._put(ids, starts, np.concatenate([cuts, [len(ids)]]) - starts)
        for ids in self._plain([x.decode() for x in odd]):
            self._put(ids, np.zeros(1, np.int64), np.array([len(ids)]))
        pieces = plain + odd
        short = [i for i, x in enumerate(pieces) if len(x) <= 16]
        keys = np.frombuffer(b"".join([pieces[i].ljust(16, b"\0") for i in short]), "<u8").reshape(-1, 2)
        self._insert(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]), (np.array(short, np.int64) + base).astype(np.int32))
        for i, x in enumerate(pieces):
            if len(x) > 16:
                self.long[x] = base + i
                self.held += len(x)

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        whole = [i for i, x in enumerate(texts) if not self.usual or b"\0" in x or any(s in x for s in self.special)]
        if whole:
            ids = self._plain([texts[i].decode() for i in whole])
            out = dict(zip(whole, (x.tobytes() for x in ids), strict=True))
            rest = iter(self._slice([x for i, x in enumerate(texts) if i not in out]) if len(out) < len(texts) else [])
            return [out[i] if i in out else next(rest) for i in range(len(texts))]
        if self.size > self.most or self.held > 32 << 20:
            self._empty()
        data = b"\n".join(texts) + b"\n"
        gaps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cut, white = boundaries(data)
        cut[0] = cut[gaps] = cut[gaps[:-1] + 1] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(data))
        words = np.ndarray((len(data),), "<u8", data + bytes(16), strides=(1,))
        key1 = words[starts] & FIRST[np.minimum(lengths, 8)]
        key2 = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(lengths > 8)
        key2[more] = words[np.minimum(starts[more] + 8, len(data) - 1)] & FIRST[np.minimum(lengths[more] - 8, 8)]
        piece = self._find(key1, key2).astype(np.int64)
        far = more[lengths[more] > 16]
        spans = [data[s : s + n] for s, n in zip(starts[far].tolist(), lengths[far].tolist(), strict=True)]
        piece[far] = [self.long.get(x, -1) for x in spans]
        new = np.flatnonzero(piece < 0)
        if new.size:
            blank = np.concatenate([[0], np.cumsum(white)])
            ends = starts[new] + lengths[new]
            odd = blank[ends] - blank[starts[new]] > ((key1[new] & np.uint64(255)) == 32) & (lengths[new] > 1)
            wanted = {data[s:e]: o for s, e, o in zip(starts[new].tolist(), ends.tolist(), odd.tolist(), strict=True)}
            self._add([x for x, o in wanted.items() if not o], [x for x, o in wanted.items() if o])
            piece[new] = self._find(key1[new], key2[new])
            piece[far] = [self.long[x] for x in spans]
        gap = np.searchsorted(starts, gaps)
        counts = self.n[piece]
        counts[gap] = 0
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.at[piece] - ends + counts, counts) + np.arange(ends[-1])].astype("<u4").tobytes()
        stops = (4 * ends[gap]).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _long(self, text: bytes) -> bytes:
        """Ids of a long text, part by part between sure boundaries."""
        if not self.usual or b"\0" in text or any(s in text for s in self.special):
            return self._slice([text])[0]
        out, at = [], 0
        while at < len(text):
            found = SURE.search(text, at + SLICE)
            end = found.end() if found else len(text)
            out += self._slice([text[at:end]])
            at = end
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for x in [*texts, None]:
            data = None if x is None else x.encode()
            if held and (data is None or size + len(data) > SLICE):
                out += self._slice(held)
                held, size = [], 0
            if data is None:
                break
            if len(data) > SLICE:
                out.append(self._long(data))
            else:
                held.append(data)
                size += len(data) + 1
        return out


_ENCODERS: dict[tuple, Encoder] = {}
common.HELD.append(_ENCODERS.clear)


def encoder(path: str | None = None, most: int = 1_200_000) -> Encoder:
    """One encoder for each Python worker, whose cache serves all its tasks until one of another kind comes."""
    if (path, most) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]
