"""A compressed file format for token ids: adaptive context mixing before an entropy coder.

A stream of ids begins with a table of how often each id occurs in it, its order-0 distribution. The ids follow in
blocks. A block starts from an empty model and that table, so it is read without any other, and it carries a checksum of
its ids. Two tables of the block name the next id after the last two ids (order 2) and after the last one (order 1), each with a
confidence that grows with every hit. The three orders are one distribution: the weights of order 2 and order 1
are added to the ids they name, all other weight is spread by order 0. The weights are the rates at which either
was right so far in this block, learnt apart for each pair of confidences. A coder with a 64-bit state (range variant of asymmetric
numeral systems) codes each id in one step of that mixture into 32-bit words. An id's slots are those of order 0 and, where
an order names it, that order's; they need not lie side by side. Probabilities and states are integers; quotients are taken in
doubles that hold them exactly or are put right, so blocks read the same on any machine.

Many blocks are coded side by side: every step takes one id of each, so the cost of numpy's calls is shared by
thousands of ids. The writer knows all ids, so it works out all but the tables' and rates' changes for many steps at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096  # ids
LANES = 2048  # blocks coded side by side
HASH_BITS = 10
STEPS = 32  # steps whose parts that don't hang on each other are worked out at once
IDS = 1 << 16
HEAD = np.dtype([("ids", "<u4"), ("words", "<u4"), ("crc", "<u4")])

_U = np.uint64
_FLOOR = _U(1 << 32)  # a coder's state stays at or above it; a word of 32 bits leaves or comes
_ZERO_BITS = 18  # an order-0 table's shares add up to 1 << _ZERO_BITS
_ZERO = 1 << _ZERO_BITS
_SHARE_BITS = _ZERO_BITS + 1  # a row of an order-0 table: the shares below an id << _SHARE_BITS | its share
_SHARE = (1 << _SHARE_BITS) - 1
_MIX_BITS = 10  # weights of the three orders add up to 1 << _MIX_BITS
_LEAST = 1 << 3  # of order 0's weight
_WHOLE = _MIX_BITS + _ZERO_BITS
_STATES = 32  # confidences of both orders, and whether they name the same id
_MASK = (1 << HASH_BITS) - 1
# first guesses: 16-bit rates at which order 2 and, beside it, order 1 are right, by confidences (0 is unknown)
_TWO, _ONE = [0, 22000, 36000, 50000], [0, 9000, 16000, 26000]
_RATES = np.array([[_TWO[s >> 3], 0 if s & 1 else _ONE[s >> 1 & 3] * (65536 - _TWO[s >> 3]) >> 16] for s in range(_STATES)], np.int32)


def shares(counts: np.ndarray) -> np.ndarray:
    """Shares of ``_ZERO`` in proportion to the counts, 1 at least for every id that occurs."""
    total, held = int(counts.sum()), counts > 0
    spare = _ZERO - int(held.sum())
    out = np.where(held, 1 + counts * spare // max(total, 1), 0)
    out[int(np.argmax(counts))] += _ZERO - int(out.sum())
    return out


def _table_bytes(share: np.ndarray) -> bytes:
    """The ids of a table and their shares as byte planes, deflated."""
    ids = np.flatnonzero(share)
    planes = [np.diff(ids, prepend=0).astype("<u2").view(np.uint8).reshape(-1, 2), share[ids].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]]
    data = zlib.compress(b"".join(np.ascontiguousarray(p.T).tobytes() for p in planes), 9)
    return np.array([len(data), len(ids)], "<u4").tobytes() + data


def _table_from(data: bytes) -> tuple[np.ndarray, int]:
    """A table of shares and where it ends."""
    if len(data) < 8:
        raise ValueError("a stream is cut short")
    size, n = (int(v) for v in np.frombuffer(data, "<u4", 2))
    try:
        raw = np.frombuffer(zlib.decompress(data[8 : 8 + size]), np.uint8)
    except zlib.error as e:
        raise ValueError("a stream's table is damaged") from e
    if len(raw) != 5 * n:
        raise ValueError("a stream's table is damaged")
    planes = raw.reshape(5, n).astype(np.int64)
    ids, share = np.cumsum(planes[0] | planes[1] << 8), planes[2] | planes[3] << 8 | planes[4] << 16
    out = np.zeros(IDS, np.int64)
    if n and ids[-1] < IDS:
        out[ids] = share
    if out.sum() != _ZERO:
        raise ValueError("a stream's table is damaged")
    return out, 8 + size


class Model:
    """Predictions and weights of many blocks, a column for each; what both orders have stands in two rows, order 1 first.

    Arrays may have a leading axis of steps: whatever does not hang on the step before is worked out for many steps at once.
    """

    def __init__(self, lanes: int) -> None:
        columns = np.arange(lanes)
        self.base = np.stack([columns << HASH_BITS, (columns + lanes) << HASH_BITS])
        self.table = np.zeros(2 * lanes << HASH_BITS, np.int32)  # named id | confidence << 16
        self.right = np.concatenate([np.tile(_RATES[:, k], lanes) for k in (0, 1)])  # by lane and state: order 1 right beside order 2, order 2 right
        self.state = np.stack([columns * _STATES, (columns + lanes) * _STATES])

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the tables hold what came after the last id, and after the last two."""
        m = last.shape[-1]
        at = np.empty((*last.shape[:-1], 2, m), np.int64)
        one, two = at[..., 0, :], at[..., 1, :]
        np.multiply(last, 0x9E3779B1, out=one)
        np.multiply(before, 0x85EBCA6B, out=two)
        two ^= one
        two *= 0x27D4EB2F
        at >>= 16
        at &= _MASK
        at += self.base[:, :m]
        return at

    def states(self, entry: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Where the rates stand for these confidences."""
        trust = entry >> 16
        i = trust[..., 1, :] << 2
        i += trust[..., 0, :]
        i <<= 1
        i += named[..., 0, :] == named[..., 1, :]
        return self.state[:, : entry.shape[-1]] + i[..., None, :]


def _weights(rate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both orders, and what they leave to order 0."""
    w = rate >> (16 - _MIX_BITS)
    np.minimum(w[..., 1, :], (1 << _MIX_BITS) - 2 * _LEAST, out=w[..., 1, :])
    room = (1 << _MIX_BITS) - w[..., 1, :]
    np.minimum(w[..., 0, :], room - _LEAST, out=w[..., 0, :])
    room -= w[..., 0, :]
    return w, room


def _renewed(entry: np.ndarray, hit: np.ndarray, once: np.ndarray, thrice: np.ndarray) -> np.ndarray:
    """Entries after an id came: a hit adds to the confidence, a miss takes from it; an id without confidence gives way.
    ``once`` and ``thrice`` are the id with confidences 1 and 3."""
    return np.where(hit, np.minimum(entry + (1 << 16), thrice), np.where(entry >= 2 << 16, entry - (1 << 16), once))


def _learnt(rate: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The rates after hits and misses; order 1 counts where order 2 was wrong."""
    gain = hit * np.int32(4095)
    gain[..., 0, :] *= ~hit[..., 1, :]
    gain += rate
    gain -= rate >> 4
    return gain


def _lengths(n: np.ndarray, t: int) -> int:
    return int(np.searchsorted(-n, -t, "left"))  # rows (longest first) that still have an id at t


def _predictions(ids: np.ndarray, n: np.ndarray, order0: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each id, a row for each step, what the coder needs: its row of the order-0 table, the weights of order 1 and order 2,
    and whether they named it."""
    lanes, steps = ids.shape
    model, by_id = Model(lanes), table * IDS
    out = np.zeros((steps, lanes), np.int64)
    last = np.zeros((2, lanes), np.int64)  # the id before the last one, and the last
    for t in range(0, steps, STEPS):
        m = _lengths(n, t)  # a row that ends among these steps goes on with zeros that nobody reads
        x = ids[:m, t : t + STEPS].T.astype(np.int32, order="C")
        k = len(x)
        past = np.concatenate([last[:, :m], x])
        last = past[-2:]
        at = model.places(past[1:-1], past[:-2])
        once, thrice = x | 1 << 16, x | 3 << 16
        entry, hit = np.empty((k, 2, m), np.int32), np.empty((k, 2, m), bool)
        for j in range(k):
            e, h = entry[j], hit[j]
            model.table.take(at[j], out=e, mode="clip")
            np.equal(e & 0xFFFF, x[j], out=h)
            model.table[at[j].ravel()] = _renewed(e, h, once[j], thrice[j]).ravel()
        where, rate = model.states(entry, entry & 0xFFFF), np.empty((k, 2, m), np.int32)
        for j in range(k):
            model.right.take(where[j], out=rate[j], mode="clip")
            model.right[where[j].ravel()] = _learnt(rate[j], hit[j]).ravel()
        w, _ = _weights(rate)
        w <<= 1
        w |= hit
        held = order0.take(by_id[:m] + x)
        held <<= 2 * (_MIX_BITS + 1)
        held |= w[:, 0] << (_MIX_BITS + 1) | w[:, 1]
        out[t : t + k, :m] = held
    return out


def _encode(ids: np.ndarray, n: np.ndarray, order0: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and where each row's begin and end, for rows of ids, longest row first. ``table`` says which of the tables one after
    the other in ``order0`` is a row's. The coder runs from the last id to the first, so that the words are read forwards."""
    lanes, steps = ids.shape
    told = _predictions(ids, n, order0, table)
    out, pos = np.zeros(lanes * (steps + 2), np.uint32), np.arange(1, lanes + 1) * (steps + 2)
    end, state = pos.copy(), np.full(lanes, _FLOOR, _U)
    for t in range((steps - 1) // STEPS * STEPS, -1, -STEPS):
        part = told[t : t + STEPS]
        w2, w1 = part & (2 << _MIX_BITS) - 1, part >> (_MIX_BITS + 1) & (2 << _MIX_BITS) - 1
        held = part >> 2 * (_MIX_BITS + 1)
        mass2, mass1 = w2 >> 1 << _ZERO_BITS, w1 >> 1 << _ZERO_BITS
        w0 = (1 << _MIX_BITS) - (w1 >> 1) - (w2 >> 1)
        zero = w0 * (held & _SHARE)
        both = zero + mass1 * (w1 & 1)
        whole = both + mass2 * (w2 & 1)
        # an id's slots: those of order 0, then those by order 1, then those by order 2
        to_zero, to_one, to_two = mass2 + mass1 + w0 * (held >> _SHARE_BITS), mass2 - zero, -both
        f, inverse = whole.view(_U), (1 - 2.0**-50) / np.maximum(whole, 1)
        for j in range(len(part) - 1, -1, -1):
            m = lanes if n[-1] > t + j else _lengths(n, t + j)
            s, size = state[:m], f[j, :m]
            go = np.flatnonzero(s >> _U(64 - _WHOLE) >= size)
            if len(go):
                word, here = s.take(go), pos.take(go)
                here -= 1
                out[here], pos[go], s[go] = word.astype(np.uint32), here, word >> _U(32)
            q = (s * inverse[j, :m]).astype(_U)  # the quotient, or one less
            rest = (s - q * size).view(np.int64)
            over = rest >= whole[j, :m]
            q += over
            rest -= whole[j, :m] * over
            move = np.where(rest < zero[j, :m], to_zero[j, :m], np.where(rest < both[j, :m], to_one[j, :m], to_two[j, :m]))
            move += rest
            q <<= _U(_WHOLE)
            np.add(q, move.view(_U), out=s)
    for k in (0, 32):
        pos -= 1
        out[pos] = (state >> _U(k)).astype(np.uint32)
    return out, np.stack([pos, end])


def _decode(words: np.ndarray, at: np.ndarray, n: np.ndarray, order0: np.ndarray, slots: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rows of ids from the words that begin at ``at``, longest row first. ``table`` says which of the tables one after the other in
    ``order0`` (by id) and ``slots`` (ids by share) is a row's."""
    lanes, steps = len(n), int(n[0])
    model, m = Model(lanes), lanes
    words, state, pos = words.astype(_U), np.zeros(lanes, _U), at.copy()
    for _ in range(2):  # a damaged row may read beyond its words; its checksum tells
        state = state << _U(32) | words.take(pos, mode="clip")
        pos += 1
    out = np.zeros((lanes, steps + 33), np.uint16)[:, :-33]  # rows don't begin in the same lines of the cache
    by_id, by_slot = table * IDS, table << _ZERO_BITS
    last = before = np.zeros(lanes, np.int64)
    ready = np.zeros((STEPS, lanes), np.uint16)
    for t in range(steps):
        if n[m - 1] <= t:
            m = _lengths(n, t)
            state, last, before, by_id, by_slot = (v[:m] for v in (state, last, before, by_id, by_slot))
        place = model.places(last, before)
        entry = model.table.take(place)
        named = entry & 0xFFFF
        where = model.states(entry, named)
        rate = model.right.take(where)
        w, w0 = _weights(rate)
        w <<= _ZERO_BITS
        u = (state & _U((1 << _WHOLE) - 1)).astype(np.int32)
        v = u - w[1]
        z = v - w[0]
        first, second = z < 0, v < 0
        x = slots.take(by_slot + (z / w0).astype(np.int64), mode="clip")
        x = np.where(second, named[1], np.where(first, named[0], x))
        hit = named == x
        held = order0.take(by_id + x)
        zero = w0 * (held & _SHARE)
        held >>= _SHARE_BITS
        held *= w0
        w *= hit
        both = zero + w[0]
        rest = np.where(second, both + u, np.where(first, zero + v, z - held))
        both += w[1]
        state >>= _U(_WHOLE)
        state *= both.view(_U)
        state += rest.view(_U)
        go = np.flatnonzero(state < _FLOOR)
        if len(go):
            here = pos.take(go)
            state[go] = state.take(go) << _U(32) | words.take(here, mode="clip")
            here += 1
            pos[go] = here
        model.right[where.ravel()] = _learnt(rate, hit).ravel()
        once = x | 1 << 16
        model.table[place.ravel()] = _renewed(entry, hit, once, once | 2 << 16).ravel()
        before, last = last, x.astype(np.int64)
        j = t % STEPS
        ready[j, :m] = x
        if j == STEPS - 1 or t == steps - 1:
            out[:, t - j : t + 1] = ready[: j + 1].T
    return out


def _groups(n: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(-n, kind="stable")
    for at in range(0, len(order), LANES):
        yield order[at : at + LANES]


def _rows(tables: list[np.ndarray]) -> np.ndarray:
    """Tables one after the other, by id: the shares below it and its own."""
    return np.concatenate([(np.cumsum(t) - t) << _SHARE_BITS | t for t in tables]) if tables else np.zeros(0, np.int64)


def pack_ids(streams: list[np.ndarray], block: int = BLOCK) -> list[bytes]:
    """Each stream of ids as its table and its blocks one after the other: header, then words. Ids must be below 65,536."""
    if any(len(s) and int(s.max()) >= IDS for s in streams):
        raise ValueError("ids of 65,536 and more don't fit this format")
    tables = [shares(np.bincount(s, minlength=IDS)) if len(s) else np.zeros(IDS, np.int64) for s in streams]
    blocks = [(i, s[at : at + block]) for i, s in enumerate(streams) for at in range(0, len(s), block)]
    n = np.array([len(b) for _, b in blocks], np.int64)
    order0 = _rows(tables)
    coded: list[bytes] = [b""] * len(blocks)
    for group in _groups(n):
        ids = np.zeros((len(group), int(n[group[0]]) + 33), np.uint16)[:, :-33]  # rows don't begin in the same lines of the cache
        for row, k in enumerate(group.tolist()):
            ids[row, : n[k]] = blocks[k][1]
        words, (begin, end) = _encode(ids, n[group], order0, np.array([blocks[k][0] for k in group.tolist()], np.int64))
        for k, a, b in zip(group.tolist(), begin.tolist(), end.tolist(), strict=True):
            head = np.array([(n[k], b - a, zlib.crc32(blocks[k][1].astype("<u4").data))], HEAD)
            coded[k] = head.tobytes() + words[a:b].astype("<u4").tobytes()
    out: list[list[bytes]] = [[_table_bytes(t)] if len(s) else [] for s, t in zip(streams, tables, strict=True)]
    for (i, _), c in zip(blocks, coded, strict=True):
        out[i].append(c)
    return [b"".join(o) for o in out]


def unpack_ids(payloads: list[bytes]) -> list[np.ndarray]:
    """The streams of ids; a damaged table or a block that doesn't match its checksum raises ValueError."""
    heads, where, owner, tables = [], [], [], []
    parts, base = [], 0
    for i, data in enumerate(payloads):
        at = 0
        if data:
            table, at = _table_from(data)
            tables.append(table)
        while at < len(data):
            if at + HEAD.itemsize > len(data):
                raise ValueError("a block is cut short")
            head = np.frombuffer(data, HEAD, 1, at)[0]
            at += HEAD.itemsize
            size = int(head["words"])
            if at + 4 * size > len(data):
                raise ValueError("a block is cut short")
            parts.append(np.frombuffer(data, "<u4", size, at))
            heads.append(head)
            where.append(base)
            owner.append((i, len(tables) - 1))
            base += size
            at += 4 * size
    if not heads:
        return [np.zeros(0, np.uint32) for _ in payloads]
    words = np.concatenate(parts)
    order0 = _rows(tables)
    slots = np.concatenate([np.repeat(np.arange(IDS, dtype=np.uint16), t) for t in tables])
    n = np.array([h["ids"] for h in heads], np.int64)
    begin = np.array(where, np.int64)
    of = np.array([t for _, t in owner], np.int64)
    blocks: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(heads)
    for group in _groups(n):
        ids = _decode(words, begin[group], n[group], order0, slots, of[group])
        for row, k in enumerate(group.tolist()):
            blocks[k] = ids[row, : n[k]].astype("<u4")
            if zlib.crc32(blocks[k].data) != heads[k]["crc"]:
                raise ValueError("a block does not match its checksum")
    out: list[list[np.ndarray]] = [[] for _ in payloads]
    for (i, _), b in zip(owner, blocks, strict=True):
        out[i].append(b)
    return [np.concatenate(o) if o else np.zeros(0, np.uint32) for o in out]
