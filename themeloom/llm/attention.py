"""A small causal self-attention model over subword ids, in numpy.

One attention layer with one head reads a window of ids; its output, added to the embedding, gives the chances
of the next id's class. Classes hold ids of about equal total count, so frequent ids are classes of their own;
within a class an id has its smoothed share of the class's count. Both factors together are a
distribution over all ids.
"""

from __future__ import annotations

import math

import numpy as np

WIDTH, WINDOW, STRIDE = 16, 32, 24
CLASSES, FREQUENT = 64, 2048
SMOOTH = 0.1


class Vocabulary:
    """Classes, chances within a class, and embedding rows of ids, from their counts over the training texts."""

    def __init__(self, counts: np.ndarray):
        total = counts.astype(np.float64) + SMOOTH
        order = np.argsort(-total, kind="stable")
        upto = np.cumsum(total[order]) - total[order] / 2
        group = np.minimum(CLASSES - 1, (CLASSES * upto / total.sum()).astype(np.int64))
        self.kind = np.empty(len(counts), np.int64)
        self.kind[order] = group
        mass = np.bincount(self.kind, total, CLASSES)
        self.within = np.log(total / mass[self.kind])  # natural, as all logs here
        self.prior = np.log(np.maximum(mass, 1e-9) / mass.sum()).astype(np.float32)
        self.row = FREQUENT + self.kind
        self.row[order[:FREQUENT]] = np.arange(min(FREQUENT, len(counts)))


def start(prior: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """First weights: small random ones, and the class shares as the output's constant part."""
    rng = np.random.default_rng(seed)
    made = {"e": (FREQUENT + CLASSES, WIDTH), "p": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "o": (WIDTH, WIDTH), "u": (WIDTH, CLASSES)}
    w = {n: (rng.normal(size=s) * 0.25).astype(np.float32) for n, s in made.items()}
    return w | {"b": prior.astype(np.float32)}


class Room:
    """Arrays that are used again from batch to batch, by name: memory that is asked for anew costs more than the arithmetic on it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size or self.held[name].dtype != dtype:
            self.held[name] = np.empty(size, dtype)
        return self.held[name][:size].reshape(shape)


_EARLIER = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Places of a later window that were scored in the window before: they are read, and have no output.
LEAD = WINDOW - STRIDE


def _blocks(wide: int, whole: np.ndarray | None) -> list[tuple[np.ndarray | slice, int, int]]:
    """Windows, first and last place of the places with an output: all from LEAD on, and those before in the windows marked ``whole``."""
    if whole is None or wide <= LEAD or whole.all():
        return [(slice(None), 0, wide)]
    rest = [(slice(None), LEAD, wide)]
    return rest + [(np.flatnonzero(whole), 0, LEAD)] if whole.any() else rest


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _placed(values: np.ndarray, blocks: list) -> np.ndarray:
    """One value a place of the blocks, in their order."""
    parts = [values[at, low:high].reshape(-1) for at, low, high in blocks]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _cross(a: np.ndarray, b: np.ndarray, rows: int = 128) -> np.ndarray:
    """``a.T @ b`` of two tall matrices, some rows at a time: one product of all rows is slower."""
    cut = len(a) // rows * rows
    out = a[cut:].T @ b[cut:]
    if cut:
        out += (a[:cut].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1) @ b[:cut].reshape(-1, rows, b.shape[1])).sum(0)
    return out


def forward(w: dict[str, np.ndarray], rows: np.ndarray, whole: np.ndarray | None = None, room: Room | None = None) -> dict:
    """All values for windows of embedding rows, at most WINDOW wide; padding at the end changes nothing before it.

    ``h`` has an output for every place; with ``whole``, for the places of the blocks only, one after another, and 1 as a last column.
    """
    room, kind = room or Room(), w["e"].dtype
    many, wide = rows.shape
    x = np.take(w["e"], rows, axis=0, out=room("x", (many, wide, WIDTH), kind), mode="clip")
    x += w["p"][:wide]
    # one product of two plain matrices is several times faster than one a window
    k = np.matmul(_flat(x), w["k"], out=room("k", (many * wide, WIDTH), kind)).reshape(x.shape)
    # a last column of ones gives the sum of the weights
    v = room("v", (many, wide, WIDTH + 1), kind)
    v[:, :, WIDTH] = 1
    np.matmul(_flat(x), w["v"], out=_flat(v)[:, :WIDTH])
    blocks = _blocks(wide, whole)
    places = [(many if isinstance(at, slice) else len(at)) * (high - low) for at, low, high in blocks]
    y, c = (room(n, (sum(places), WIDTH), kind) for n in "yc")
    done, parts = 0, []
    for i, ((at, low, high), n) in enumerate(zip(blocks, places, strict=True)):
        own = y[done : done + n].reshape(-1, high - low, WIDTH)
        own[:] = x[at, low:high]
        # WIDTH is a power of four, so the scale changes no digit
        q = np.matmul(_flat(own), w["q"] * kind.type(1 / np.sqrt(WIDTH)), out=room(f"q{i}", (n, WIDTH), kind)).reshape(own.shape)
        s = np.matmul(q, k[at, :high].transpose(0, 2, 1), out=room(f"s{i}", (*q.shape[:2], high), kind))
        # bounded instead of shifted by the largest, which saves two passes
        np.clip(s, -40, 40, out=s)
        np.exp(s, out=s)
        s *= _EARLIER[low:high, :high]
        mixed = np.matmul(s, v[at, :high], out=room(f"m{i}", (*q.shape[:2], WIDTH + 1), kind))
        np.divide(mixed[:, :, :WIDTH], mixed[:, :, WIDTH:], out=c[done : done + n].reshape(q.shape))
        parts.append((at, low, high, done, done + n, q, s, 1 / mixed[:, :, WIDTH:]))
        done += n
    h = room("h", (done, WIDTH + 1), kind)
    h[:, WIDTH] = 1
    np.add(y, np.matmul(c, w["o"], out=room("co", c.shape, kind)), out=h[:, :WIDTH])
    return {"x": x, "y": y, "k": k, "v": v, "c": c, "blocks": blocks, "parts": parts, "h": h[:, :WIDTH].reshape(x.shape) if whole is None else h}


def logits(w: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    z = h.reshape(-1, h.shape[-1]) @ w["u"]
    z += w["b"]
    return np.clip(z, -60, 60, out=z).reshape(*h.shape[:-1], -1)


def _chances(w: dict[str, np.ndarray], h: np.ndarray, kinds: np.ndarray, room: Room) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``exp`` of the logits of outputs with a last column of ones, their sums, and the logit of each one's own class."""
    z = np.matmul(h, np.concatenate([w["u"], w["b"][None]]), out=room("z", (len(h), CLASSES), h.dtype))
    np.clip(z, -60, 60, out=z)
    own = z[np.arange(len(h)), kinds]
    np.exp(z, out=z)
    return z, z @ np.ones(CLASSES, z.dtype), own


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, kinds: np.ndarray, real: np.ndarray, room: Room | None = None, g: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over real places, into ``g`` if given."""
    room, kind = room or Room(), w["e"].dtype
    g = {n: np.empty_like(d) for n, d in w.items()} if g is None else g
    real = real.astype(bool)
    f = forward(w, rows, real[:, :LEAD].any(1), room)
    x, y, k, v, c = (f[n] for n in "xykvc")
    # only places that count have an output
    at = np.flatnonzero(_placed(real, f["blocks"]))
    some = len(at) < len(y)
    h = np.take(f["h"], at, axis=0, out=room("hs", (len(at), WIDTH + 1), kind), mode="clip") if some else f["h"]
    own = _placed(kinds, f["blocks"])[at]
    z, sums, _ = _chances(w, h, own, room)
    # the gradient of the logits is z, less the sum at the own class, over the sum and the number of places
    z[np.arange(len(at)), own] -= sums
    scale = (1 / (sums * kind.type(max(1, len(at)))))[:, None]
    turned = _cross(np.multiply(h, scale, out=room("hr", h.shape, kind)), z)
    g["u"][:], g["b"][:] = turned[:WIDTH], turned[WIDTH]
    dh = np.matmul(z, w["u"].T, out=room("dhs", (len(at), WIDTH), kind))
    dh *= scale
    if some:
        full = room("dh", y.shape, kind)
        full[:] = 0
        full[at] = dh
        dh = full
    g["o"][:] = _cross(c, dh)
    dc = np.matmul(dh, w["o"].T, out=room("dc", c.shape, kind))
    # the weighted mean of the gradients of the weights, place by place, is the product of output and its gradient
    mean = np.einsum("ij,ij->i", dc, c)
    dk, dv, dq = room("dk", k.shape, kind), room("dv", k.shape, kind), room("dq", y.shape, kind)
    for i, (chosen, low, high, first, last, q, s, over) in enumerate(f["parts"]):
        e = room(f"e{i}", (len(s), high - low, WIDTH + 1), kind)
        np.multiply(dc[first:last].reshape(q.shape), over, out=e[:, :, :WIDTH])
        np.multiply(mean[first:last].reshape(*q.shape[:2], 1), -over, out=e[:, :, WIDTH:])
        ds = np.matmul(e, v[chosen, :high].transpose(0, 2, 1), out=room(f"ds{i}", s.shape, kind))
        ds *= s
        np.matmul(ds, k[chosen, :high], out=dq[first:last].reshape(q.shape))
        if not i:
            np.matmul(ds.transpose(0, 2, 1), q, out=dk)
            np.matmul(s.transpose(0, 2, 1), e[:, :, :WIDTH], out=dv)
        else:
            dk[chosen, :high] += ds.transpose(0, 2, 1) @ q
            dv[chosen, :high] += s.transpose(0, 2, 1) @ e[:, :, :WIDTH]
    small = kind.type(1 / np.sqrt(WIDTH))
    g["q"][:] = _cross(y, dq) * small
    g["k"][:], g["v"][:] = _cross(_flat(x), _flat(dk)), _cross(_flat(x), _flat(dv))
    dx = np.matmul(_flat(dk), w["k"].T, out=room("dx", (rows.size, WIDTH), kind))
    dx += np.matmul(_flat(dv), w["v"].T, out=room("dxv", dx.shape, kind))
    dh += np.matmul(dq, w["q"].T * small, out=room("dy", y.shape, kind))
    placed = dx.reshape(x.shape)
    for chosen, low, high, first, last, *_ in f["parts"]:
        placed[chosen, low:high] += dh[first:last].reshape(-1, high - low, WIDTH)
    g["p"][:] = 0
    g["p"][: rows.shape[1]] = (np.ones(len(rows), kind) @ dx.reshape(len(rows), -1)).reshape(-1, WIDTH)
    # numbers of two bytes are sorted by their digits
    narrow = rows.reshape(-1).astype(np.min_scalar_type(len(w["e"])))
    order = np.argsort(narrow, kind="stable")
    held = narrow[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    g["e"][:] = 0
    g["e"][held[first]] = np.add.reduceat(np.take(dx, order, axis=0, out=room("dxs", dx.shape, kind), mode="clip"), first)
    return g


class Adam:
    """Steps of all weights at once, which lie in one array."""

    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.s = rate, 0, None, None

    def step(self, w: np.ndarray, g: np.ndarray) -> None:
        """Moves ``w`` by its gradient ``g``, whose memory is used up."""
        if self.m is None:
            self.m, self.s, self.room = np.zeros_like(w), np.zeros_like(w), np.empty_like(w)
        self.t += 1
        m, s, held = self.m, self.s, self.room
        np.multiply(g, g, out=held)
        held *= np.float32(0.01)
        s *= np.float32(0.99)
        s += held
        g *= np.float32(0.1)
        m *= np.float32(0.9)
        m += g
        np.multiply(s, np.float32(1 / (1 - 0.99**self.t)), out=held)
        np.sqrt(held, out=held)
        held += np.float32(1e-8)
        np.divide(m, held, out=held)
        held *= np.float32(self.rate / (1 - 0.9**self.t))
        w -= held


def windows(ids: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts: places of the ids to score (-1: padding or scored before), the ids
    read (place - 1; -1: the start of the text), and the text of each window.

    The first window of a text scores all its places, later ones the last STRIDE, so each id is scored
    once, with at least WINDOW - STRIDE ids before it where the text has them.
    """
    sizes = sizes.astype(np.int32)
    many = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), many)
    nth = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
    first = (np.cumsum(sizes) - sizes).astype(np.int32)[text]
    local = nth[:, None] * np.int32(STRIDE) + np.arange(WINDOW, dtype=np.int32)
    inside = local < sizes[text][:, None]
    place = np.where(inside, first[:, None] + local, np.int32(-1))
    fresh = inside & ((nth[:, None] == 0) | (np.arange(WINDOW) >= WINDOW - STRIDE))
    before = np.where(inside & (local > 0), place - 1, np.int32(-1))
    return np.where(fresh, place, np.int32(-1)), before, text


def score_texts(w: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, begin: int, chunk: int = 256) -> np.ndarray:
    """log10 probability of each text; texts are taken together up to some 200,000 ids, so memory follows one text."""
    ends = np.cumsum(sizes)
    out = []
    low = 0
    while low < len(sizes):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + 200_000, "right")))
        out.append(_score(w, vocabulary, ids[done : ends[high - 1]], sizes[low:high], begin, chunk))
        low = high
    return np.concatenate([np.empty(0), *out]) / np.log(10)


def _score(w: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, begin: int, chunk: int) -> np.ndarray:
    target, before, text = windows(ids, sizes, begin)
    row, kind, within = vocabulary.row[ids], vocabulary.kind[ids], vocabulary.within[ids]
    # one row more, for the start of a text
    row = np.append(row, vocabulary.row[begin])
    out, room = np.zeros(len(sizes)), Room()
    for low in range(0, len(text), chunk):
        t = target[low : low + chunk]
        f = forward(w, row[before[low : low + chunk]], (t[:, :LEAD] >= 0).any(1), room)
        places = _placed(t, f["blocks"])
        at = np.flatnonzero(places >= 0)
        places = places[at]
        h = f["h"] if len(at) == len(f["h"]) else f["h"][at]
        _, sums, own = _chances(w, h, kind[places], room)
        of = _placed(np.broadcast_to(text[low : low + chunk, None], t.shape), f["blocks"])[at]
        out += np.bincount(of, own - np.log(sums) + within[places], len(sizes))
    return out


def train_texts(w: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, begin: int, adam: Adam, batch: int = 128) -> None:
    """One pass of gradient steps over all windows of the texts, in a fixed mixed order."""
    target, before, text = windows(ids, sizes, begin)
    row, kind = np.append(vocabulary.row[ids], vocabulary.row[begin]), np.append(vocabulary.kind[ids], 0)
    order = np.random.default_rng(len(text)).permutation(len(text))
    # all weights, and all gradients, in one array each
    flat = np.concatenate([w[n].ravel() for n in sorted(w)])
    step, room = np.empty_like(flat), Room()
    own, g = _views(flat, w), _views(step, w)
    for low in range(0, len(order), batch):
        some = order[low : low + batch]
        t = target[some]
        gradients(own, row[before[some]], kind[t], t >= 0, room, g)
        adam.step(flat, step)
    for n in w:
        w[n][:] = own[n]


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def to_bytes(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(w[n].astype("<f4").tobytes() for n in sorted(w))


def from_bytes(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return _views(np.frombuffer(raw, "<f4").copy(), like)
