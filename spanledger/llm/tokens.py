"""Token ids of whole Arrow batches by the ``tokenizers`` library, each distinct piece encoded once.

A text is cut where its tokenizer cuts anyway: before white space that follows other characters,
and between a Latin letter and a following mark of punctuation. The library encodes each distinct
piece of a batch that the worker does not know yet, many as one text; texts are put together from the known ids.
Texts with unusual white space, zero bytes or the string ``<|`` are encoded whole.
"""

from __future__ import annotations

import os
from functools import cache
from itertools import chain

import numpy as np

from spanledger.llm import words as W

DEFAULT_FOLDER = "/opt/tokenizers"
KNOWN_PIECES = 1_500_000  # an encoder forgets its pieces beyond this number,
KNOWN_IDS = 8_000_000  # and beyond so many ids; with the table of pieces that is 76 MB
SLOTS = 1 << 22
AT_ONCE = 10_000  # pieces that the library encodes in one call
LONG_PIECE = 2000

_GAP, _LETTER, _MARK, _ODD = 1, 2, 4, 8
_kinds = np.zeros(256, np.uint8)
_kinds[[9, 10, 13, 32]] |= _GAP
_kinds[[*range(65, 91), *range(97, 123)]] |= _LETTER
_kinds[[33, 44, 46, 58, 59, 63]] |= _MARK  # ! , . : ; ?
_kinds[[0, 11, 12, 28, 29, 30, 31]] |= _ODD
_KINDS, _LOWER = _kinds.tobytes(), W._LOWER.tobytes()
_LATIN = 0xC3  # the largest byte of letters up to U+00FF, which keep their number of bytes when lower-cased and composed


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, by the package that brings it or the usual folder."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ModuleNotFoundError:
        return os.path.join(DEFAULT_FOLDER, name)


class Encoder:
    """Ids of texts by a tokenizer file; equal to encoding every whole text by the library.

    ``folds`` says that the tokenizer lower-cases and drops white space, so that pieces that differ
    only in these are one.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("A  b", "a b")]
        self.folds = probe[0] == probe[1]
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        self.width = np.array([len(t.removesuffix("</w>") if self.folds else t) for t in names], np.int64)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)  # an open hash table of piece hashes; 0 is free
        self.place = np.zeros(SLOTS, np.int32)  # of each key, its row in at
        self.known = 0
        self.at = np.zeros(1, np.int64)  # ids of piece i: ids[at[i]:at[i + 1]]
        self.ids = np.zeros(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it isn't known."""
        out = np.full(len(keys), -1, np.int64)
        open_, slot = np.arange(len(keys)), keys & np.uint64(SLOTS - 1)
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.place[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], (slot[on] + np.uint64(1)) & np.uint64(SLOTS - 1)
        return out

    def _flat(self, given: str | list[str], need: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces in turn, and how many each has, by one call that takes all as words of one text; as a byte-level id
        stands for so many bytes, ``need``, the bytes up to the end of each piece, tells where it ends. None if that doesn't fit."""
        got = self.tokenizer.encode_batch_fast([given], is_pretokenized=isinstance(given, list), add_special_tokens=False)[0]
        flat = np.array(got.ids, np.uint16)
        have = np.cumsum(self.width[flat])
        last = np.searchsorted(have, need)
        if len(have) and have[-1] == need[-1] and (have[last] == need).all():
            return flat, np.diff(last, prepend=-1)
        return None

    def _ids(self, form: np.ndarray, starts: np.ndarray, ends: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in turn, and how many each has. ``narrow`` says that the tokenizer keeps the pieces' numbers of bytes."""
        need, got = np.cumsum(ends - starts), None
        if narrow and self.folds:  # blanks part words and leave no id
            text = _gather(form, starts, ends - starts + 1).copy()
            text[need + np.arange(len(need))] = 32
            got = self._flat(text.tobytes().decode("utf-8"), need)
        if got is None:
            data = form.tobytes()
            pieces = [data[a:b].decode("utf-8") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            got = self._flat(pieces, need) if narrow else None
        if got is None:
            each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            got = np.fromiter(chain.from_iterable(each), np.uint16, int(sizes.sum())), sizes
        return got

    def _learn(self, keys: np.ndarray, form: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Takes up new pieces of ``form``, which has a byte after its last piece."""
        wide = np.zeros(len(keys), bool)
        if self.folds and form.max() > _LATIN:  # letters beyond U+00FF may change their number of bytes when lower-cased or composed
            seen = np.cumsum(form > _LATIN)
            wide = seen[ends - 1] > seen[starts] - (form[starts] > _LATIN)
        flat, sizes, order = [], [], []
        for chosen in (np.flatnonzero(~wide), np.flatnonzero(wide)):
            for at in range(0, len(chosen), AT_ONCE):
                order.append(chosen[at : at + AT_ONCE])
                for made, part in zip((flat, sizes), self._ids(form, starts[order[-1]], ends[order[-1]], not wide[order[-1][0]]), strict=True):
                    made.append(part)
        keys = keys[np.concatenate(order)]
        row = (self.known + np.arange(len(keys))).astype(np.int32)
        self.known += len(keys)
        self.at = _longer(self.at, self.at[-1] + np.cumsum(np.concatenate(sizes)))
        self.ids = _longer(self.ids, np.concatenate(flat))
        slot = keys & np.uint64(SLOTS - 1)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.place[slot[mine]] = row[mine]
            keys, row, slot = keys[~mine], row[~mine], (slot[~mine] + np.uint64(1)) & np.uint64(SLOTS - 1)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a piece of a batch, row after row, and each row's first place."""
        n = len(offs) - 1
        if self.known > KNOWN_PIECES or len(self.ids) > KNOWN_IDS:
            self.clear()
        data = buf.tobytes()
        form = np.frombuffer(data.translate(_LOWER), np.uint8) if self.folds else buf
        kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
        starts, ends = _cuts(kinds, offs, self.folds)
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, offs)))
        strange = np.zeros(n, bool)
        strange[np.searchsorted(offs, _odd(buf, kinds), "right") - 1] = True
        strange[row[ends - starts > LONG_PIECE]] = True
        plain = ~strange[row]
        starts, ends, row = starts[plain], ends[plain], row[plain]
        hashes = W.span_hashes(form, starts, ends) | np.uint64(1 << 63)
        piece = self._find(hashes)
        new = np.flatnonzero(piece < 0)
        if len(new):
            keys, first = np.unique(hashes[new], return_index=True)
            self._learn(keys, np.append(form, np.uint8(32)), starts[new[first]], ends[new[first]])
            piece[new] = self._find(hashes[new])
        size = self.at[piece + 1] - self.at[piece]
        ids = _gather(self.ids, self.at[piece], size)
        counts = np.bincount(row, weights=size, minlength=n).astype(np.int64)
        if strange.any():
            parts, at = [], 0
            for i in range(n):
                if strange[i]:
                    parts.append(self.whole(data[offs[i] : offs[i + 1]].decode("utf-8")))
                    counts[i] = len(parts[-1])
                else:
                    parts.append(ids[at : at + counts[i]])
                    at += counts[i]
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)])


def _cuts(kinds: np.ndarray, offs: np.ndarray, folds: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces: they cover every byte of every row, or all but white space."""
    if not len(kinds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    here, before = kinds[1:], kinds[:-1]
    cut = np.zeros(len(kinds) + 1, bool)
    cut[1:-1] = ((here ^ before if folds else here & ~before) & _GAP) | (here >> 1 & before & _LETTER)  # a mark lies a bit above a letter
    cut[offs] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    if folds:
        keep = kinds[starts] & _GAP == 0
        starts, ends = starts[keep], ends[keep]
    return starts, ends


def _odd(buf: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places of zero bytes, of white space other than blank, tab and line ends, and of ``<|``."""
    if not len(buf):
        return np.zeros(0, np.int64)
    found = [np.flatnonzero(kinds & _ODD)]
    one, two = np.zeros(len(buf), np.uint8), np.zeros(len(buf), np.uint8)
    one[:-1], two[:-2] = buf[1:], buf[2:]
    for lead, first, least, most in (
        (0xC2, 0x85, 0, 255), (0xC2, 0xA0, 0, 255), (0xE1, 0x9A, 0x80, 0x80), (0xE2, 0x80, 0x80, 0x8F), (0xE2, 0x80, 0xA8, 0xAF),
        (0xE2, 0x81, 0x9F, 0xA0), (0xE3, 0x80, 0x80, 0x80), (0xEF, 0xBB, 0xBF, 0xBF), (0x3C, 0x7C, 0, 255),
    ):
        at = np.flatnonzero(buf == lead)
        found.append(at[(one[at] == first) & (two[at] >= least) & (two[at] <= most)])
    return np.concatenate(found)


def _longer(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """``values`` and ``more`` in one array, a view of one with room to grow."""
    size, room = len(values) + len(more), values.base
    if room is None or room.ndim != 1 or room.dtype != values.dtype or len(room) < size:
        room = np.empty(size * 5 // 4 + 1, values.dtype)
        room[: len(values)] = values
    room[len(values) : size] = more
    return room[:size]


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(sizes)
    step = np.repeat(starts - (ends - sizes), sizes)
    return values[step + np.arange(total)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each file in a Python worker; what it keeps between tasks is bounded by KNOWN_PIECES and KNOWN_IDS."""
    return Encoder(path)


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each followed by the id ``end``."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[first[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, first + np.arange(n + 1)
