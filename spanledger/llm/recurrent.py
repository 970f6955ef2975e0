"""A bidirectional gated recurrent network with attention pooling, in numpy.

Every word comes in as an embedding of the word, if the vocabulary has it, embeddings of the
characters at its beginning and at its end, and the mean of embeddings of all its bytes, each with its two
neighbours. Words end at spaces of any script and after punctuation, a character of a script that writes
no spaces is a word, and a word over PIECE bytes comes in as several. Two gated recurrent layers read a window of words
forwards and backwards; attention over their states pools the window to one logit.
"""

from __future__ import annotations

import io

import numpy as np

from spanledger.llm import words as W

LENGTH, STRIDE = 32, 24  # words of a window, and from one to the next
HIDDEN, ATTEND, WORD, CHARS = 8, 8, 8, 4
CHAR_BUCKETS = 4096
HEAD, TAIL = 6, 3  # bytes at a word's beginning and end

Params = dict[str, np.ndarray]


PIECE = 24  # bytes of a word that come in as one input

Text = tuple[np.ndarray, np.ndarray, np.ndarray]  # bytes, and the words' starts and ends in them

# code points from the even entries up to the odd ones
_SPACES = np.array([0x85, 0x86, 0xA0, 0xA1, 0x1680, 0x1681, 0x2000, 0x200C, 0x2028, 0x202A, 0x202F, 0x2030, 0x205F, 0x2061, 0x3000, 0x3001, 0xFEFF, 0xFF00])
_PUNCTUATION = np.array([0xA1, 0xAA, 0xAB, 0xB5, 0xB6, 0xBA, 0xBB, 0xC0, 0x2010, 0x2019, 0x201A, 0x2028, 0x2030, 0x205F, 0x3001, 0x3005, 0x3008, 0x3021, 0xFF01, 0xFF10, 0xFF1A, 0xFF21, 0xFF3B, 0xFF41, 0xFF5B, 0xFF66])
_UNSPACED = np.array([0xE00, 0x1100, 0x1780, 0x1800, 0x1950, 0x1AB0, 0x2E80, 0x3000, 0x3001, 0x3130, 0x3190, 0xA4D0, 0xA9E0, 0xAA00, 0xAA60, 0xAAE0, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1B000, 0x1B300, 0x20000, 0x40000])
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all inputs, where their closing punctuation begins, and each row's first input."""
    n = len(low)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(len(offs), np.int64)
    gap, mark = W._SPACE[low], _MARK[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    for width, lead, kept in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        at = np.flatnonzero((low & (0xFF ^ kept)) == lead)
        code = (low[at] & kept).astype(np.int64)
        for k in range(1, width):
            code = code << 6 | low[at + k] & 63
        for which, bounds in ((gap, _SPACES), (mark, _PUNCTUATION)):
            hit = at[np.searchsorted(bounds, code, "right") % 2 == 1]
            for k in range(width):
                which[hit + k] = True
        alone = at[np.searchsorted(_UNSPACED, code, "right") % 2 == 1]
        edge[alone] = edge[alone + width] = True
    quote = np.flatnonzero(low == 39)  # an apostrophe inside a word is part of it
    closed = gap | mark | (low == 39)
    mark[quote] = edge[quote] | edge[quote + 1] | closed[np.maximum(quote - 1, 0)] | closed[np.minimum(quote + 1, n - 1)]
    edge[0] = edge[n] = True
    edge[1:-1] |= gap[1:] | gap[:-1] | mark[:-1] & ~mark[1:]
    cut = np.flatnonzero(edge)
    starts, ends = cut[:-1], cut[1:]
    kept = ~gap[starts]
    starts, ends = starts[kept], ends[kept]
    parts = -(-(ends - starts) // PIECE)
    rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts, ends = np.repeat(starts, parts) + rank * PIECE, np.repeat(ends, parts)
    ends = np.minimum(ends, starts + PIECE)
    letters = np.append(0, np.cumsum(~mark))
    body_end = np.where(letters[ends] > letters[starts], starts + letters[ends] - letters[starts], ends)
    return starts, ends, body_end, np.searchsorted(starts, offs)


def inputs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Text]:
    """Of all words of a piece: hash, beginning and end as character buckets; each row's first word; their text."""
    low = W._LOWER[buf]
    starts, ends, body_end, first = _words(low, offs)
    hashes = W.span_hashes(low, starts, body_end)
    sides = []
    for edge, step, reach in ((starts, 1, HEAD), (body_end - 1, -1, TAIL)):
        value = np.zeros(len(edge), np.int64)
        for k in range(reach):
            at = np.clip(edge + step * k, starts, body_end - 1)
            value = value * 263 + low[at] + 1
        sides.append((value * 0x9E3779B1 >> 12) % CHAR_BUCKETS)
    return hashes, sides[0], sides[1], first, (low, starts, ends)


def grams(text: Text, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of all bytes of the given words, each with its neighbours; whose they are; bytes of each word."""
    low, starts, ends = text
    begin, size = starts[words], ends[words] - starts[words]
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = begin[owner] + inside
    before = np.where(inside > 0, low[at - 1], 0)
    after = np.where(inside + 1 < size[owner], low[np.minimum(at + 1, len(low) - 1)], 0)
    return _gram(before, low[at], after), owner, size


def _gram(before: np.ndarray, low: np.ndarray, after: np.ndarray) -> np.ndarray:
    value = ((before.astype(np.uint32) * np.uint32(263) + low) * np.uint32(263) + after + np.uint32(1)) * np.uint32(0x9E3779B1)
    return (value >> np.uint32(20)).astype(np.int64)  # below CHAR_BUCKETS


def bodies(table: np.ndarray, text: Text, first: int, last: int) -> np.ndarray:
    """The mean embedding of the bytes of each of the words from ``first`` to before ``last``."""
    low, starts, ends = text
    begin, size = starts[first:last] - starts[first], ends[first:last] - starts[first:last]
    part = low[starts[first] : ends[last - 1]]
    before, after = np.zeros_like(part), np.zeros_like(part)
    before[1:], after[:-1] = part[:-1], part[1:]
    before[begin] = after[begin + size - 1] = 0
    bucket = _gram(before, part, after)
    out = np.empty((len(size), CHARS), np.float32)
    total = np.zeros(len(part) + 1)
    for c in range(CHARS):
        np.cumsum(table[:, c][bucket], dtype=np.float64, out=total[1:])
        out[:, c] = (total[begin + size] - total[begin]) / size
    return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of words of all overlapping windows of a piece."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(1, -(-(size - (LENGTH - STRIDE)) // STRIDE)), 0)
    row = np.repeat(np.arange(len(size)), count)
    rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + rank * STRIDE
    return row, start, np.minimum(first[row + 1] - start, LENGTH)


def fresh(vocabulary: np.ndarray, seed: int = 1) -> Params:
    """Random weights over a sorted vocabulary of word hashes; row 0 stands for any other word."""
    rng = np.random.Generator(np.random.PCG64(seed))

    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = {"vocabulary": vocabulary, "word": draw(len(vocabulary) + 1, WORD, scale=0.1), "char": draw(CHAR_BUCKETS, CHARS, scale=0.05)}
    p["gram"] = draw(CHAR_BUCKETS, CHARS, scale=0.05)
    for side in "fb":
        p["x" + side] = draw(WORD + CHARS, 3 * HIDDEN, scale=0.3)
        p["h" + side] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
        p["c" + side] = np.zeros(3 * HIDDEN, np.float32)
    return p | {"u": draw(2 * HIDDEN, ATTEND, scale=0.3), "v": draw(ATTEND, scale=0.3), "o": draw(2 * HIDDEN, scale=0.3), "k": np.zeros(1, np.float32)}


def dump(p: Params) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def load(data: bytes) -> Params:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def known(p: Params, hashes: np.ndarray) -> np.ndarray:
    """Rows of the word table."""
    v = p["vocabulary"]
    if not len(v):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(v, hashes), len(v) - 1)
    return np.where(v[at] == hashes, at + 1, 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _layer(gates: np.ndarray, wh: np.ndarray, mask: np.ndarray, order: range, keep: list | None) -> np.ndarray:
    """States of one direction for gate inputs (step, window, 3 * HIDDEN)."""
    h = np.zeros((gates.shape[1], HIDDEN), np.float32)
    out = np.empty((*gates.shape[:2], HIDDEN), np.float32)
    for t in order:
        rec = h @ wh
        zr = _sigmoid(gates[t, :, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
        new = n + z * (h - n)
        m = mask[t][:, None]
        if not m.all():
            new = np.where(m, new, h)
        if keep is not None:
            keep.append((h, z, r, n, rec[:, 2 * HIDDEN :]))
        h = out[t] = new
    return out


def forward(p: Params, gates: dict[str, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each window's logit, and the local logits (step, window) that attention weighs."""
    steps = mask.shape[0]
    caches: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
    states = np.concatenate([
        _layer(gates["f"], p["hf"], mask, range(steps), caches["f"]), _layer(gates["b"], p["hb"], mask, range(steps - 1, -1, -1), caches["b"]),
    ], 2)
    a = np.tanh(states @ p["u"])
    energy = np.where(mask, a @ p["v"], -1e9)
    weight = np.exp(energy - energy.max(0))
    weight /= weight.sum(0)
    local = states @ p["o"] + p["k"][0]
    logit = (weight * local).sum(0)
    if keep is not None:
        keep.update(states=states, a=a, weight=weight, local=local, caches=caches)
    return logit, local


def _gradient(p: Params, words: np.ndarray, begin: np.ndarray, end: np.ndarray, mask: np.ndarray, label: np.ndarray, found: tuple | None = None) -> Params:
    """Gradient of the mean cross-entropy over windows of word rows and character buckets (step, window),
    and of the ``grams`` of their words, if given."""
    x = np.concatenate([p["word"][words], p["char"][begin] + p["char"][end]], 2)
    if found:
        bucket, owner, count = found
        mean = np.stack([np.bincount(owner, p["gram"][bucket, c], len(count)) for c in range(CHARS)], 1) / count[:, None]
        x[:, :, WORD:] += mean.reshape(*words.shape, CHARS).astype(x.dtype)
    keep: dict = {}
    logit, _ = forward(p, {s: x @ p["x" + s] + p["c" + s] for s in "fb"}, mask, keep)
    g = {k: np.zeros_like(v) for k, v in p.items() if k != "vocabulary"}
    d = ((_sigmoid(logit) - label) / len(label)).astype(np.float32)
    states, a, weight, local = keep["states"], keep["a"], keep["weight"], keep["local"]
    dlocal = weight * d
    denergy = weight * (local - (weight * local).sum(0)) * d
    da = denergy[:, :, None] * p["v"] * (1 - a * a)
    dstates = dlocal[:, :, None] * p["o"] + da @ p["u"].T
    g["o"] = np.einsum("tb,tbk->k", dlocal, states)
    g["k"] = dlocal.sum(keepdims=True).reshape(1)
    g["v"] = np.einsum("tb,tbk->k", denergy, a)
    g["u"] = np.einsum("tbi,tbj->ij", states, da)
    dx = np.zeros_like(x)
    steps = mask.shape[0]
    for side, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        wh, dh = p["h" + side], np.zeros((x.shape[1], HIDDEN), np.float32)
        part = dstates[:, :, :HIDDEN] if side == "f" else dstates[:, :, HIDDEN:]
        cache = keep["caches"][side][::-1]
        for i, t in enumerate(order):
            h, z, r, n, rec = cache[i]
            dh = dh + part[t]
            m = mask[t][:, None]
            live = np.where(m, dh, 0)
            dn = live * (1 - z) * (1 - n * n)
            dz = live * (h - n) * z * (1 - z)
            dr = dn * rec * r * (1 - r)
            dgate = np.concatenate([dz, dr, dn], 1)
            drec = np.concatenate([dz, dr, dn * r], 1)
            g["h" + side] += h.T @ drec
            g["x" + side] += x[t].T @ dgate
            g["c" + side] += dgate.sum(0)
            dx[t] += dgate @ p["x" + side].T
            dh = np.where(m, live * z + drec @ wh.T, dh)
    np.add.at(g["word"], words.ravel(), dx[:, :, :WORD].reshape(-1, WORD))
    for side in (begin, end):
        np.add.at(g["char"], side.ravel(), dx[:, :, WORD:].reshape(-1, CHARS))
    if found:
        share = (dx[:, :, WORD:].reshape(-1, CHARS) / count[:, None])[owner]
        for c in range(CHARS):
            g["gram"][:, c] = np.bincount(bucket, share[:, c], CHAR_BUCKETS)
    return g


def train(p: Params, words: np.ndarray, begin: np.ndarray, end: np.ndarray, size: np.ndarray, label: np.ndarray, text: Text, spot: np.ndarray, epochs: int, rate: float = 0.01, batch: int = 256, seed: int = 1) -> None:
    """Adam over shuffled windows (window, step), whose words are those at ``spot`` of the text; changes ``p`` in place."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = [k for k in p if k != "vocabulary"]
    one, two = ({k: np.zeros_like(p[k]) for k in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            mask = np.arange(LENGTH)[:, None] < size[pick]
            g = _gradient(p, words[pick].T, begin[pick].T, end[pick].T, mask, label[pick], grams(text, spot[pick].T.ravel()))
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            for k in names:
                v = g[k] * scale
                one[k] += 0.1 * (v - one[k])
                two[k] += 0.001 * (v * v - two[k])
                p[k] -= (rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def evidence(p: Params, buf: np.ndarray, offs: np.ndarray, at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all windows of a piece: row, first word and logit; and per row the sums that a document's
    score is made of: (rows, 4) greatest logit, soft count of telling windows, soft count of telling
    words, words."""
    hashes, begin, end, first, text = inputs(buf, offs)
    word = known(p, hashes)
    row, start, size = windows(first)
    tables = {s: (p["word"] @ p["x" + s][:WORD] + p["c" + s], p["char"] @ p["x" + s][WORD:]) for s in "fb"}
    logits, soft = np.zeros(len(row), np.float32), np.zeros(len(row), np.float32)
    for a in range(0, len(row), at_once):
        here, n = start[a : a + at_once], size[a : a + at_once]
        steps = int(n.max())
        mask = np.arange(steps)[:, None] < n
        spot = np.minimum(here + np.arange(steps)[:, None], len(word) - 1)
        w, b, e = word[spot], begin[spot], end[spot]
        body = bodies(p["gram"], text, int(here[0]), int(spot.max()) + 1)
        logit, local = forward(p, {s: t[0][w] + t[1][b] + t[1][e] + (body @ p["x" + s][WORD:])[spot - here[0]] for s, t in tables.items()}, mask)
        logits[a : a + at_once] = logit
        soft[a : a + at_once] = (_sigmoid(local) * mask).sum(0)
    rows = len(offs) - 1
    out = np.zeros((rows, 4))
    out[:, 0] = -10
    np.maximum.at(out[:, 0], row, np.clip(logits, -10, 10))
    out[:, 1] = np.log1p(np.bincount(row, _sigmoid(logits), rows))
    out[:, 2] = np.log1p(np.bincount(row, soft, rows))
    out[:, 3] = np.log1p(np.diff(first))
    return row, start, logits, out
