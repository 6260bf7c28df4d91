"""A gated recurrent language model in numpy, with a class-factored softmax.

Symbols are the head (frequent words, learned) and the tail classes (all other
words by their first bytes; what decides inside a class is not this module's
concern). The softmax first chooses a class, then a head word in its class.

Texts lie end to end in a stream of symbols, and a stream is cut into lanes that
run side by side. State is carried from window to window of a lane; where a text
begins there is none.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

EMBED, HIDDEN = 16, 20
#: Words in each head class.
WIDTH = 32
WINDOW = 32


@dataclass
class Shape:
    """``head`` words in classes of ``WIDTH``, then ``tail`` classes."""

    head: int
    tail: int

    @property
    def head_classes(self) -> int:
        return -(-self.head // WIDTH)

    @property
    def classes(self) -> int:
        return self.head_classes + self.tail

    @property
    def symbols(self) -> int:
        return self.head + self.tail

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.head, symbol // WIDTH, self.head_classes + symbol - self.head)


def initial(shape: Shape, counts: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights; the biases start at the symbols' frequencies."""
    r = np.random.default_rng(seed)
    draw = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[-2])).astype(np.float32)
    counts = counts + 0.5
    by_class = np.bincount(shape.class_of(np.arange(shape.symbols)), counts, shape.classes)
    word = np.full(shape.head_classes * WIDTH, -1e4, np.float32)
    word[: shape.head] = np.log(counts[: shape.head])
    word = word.reshape(-1, WIDTH)
    word -= np.log(np.exp(word).sum(axis=1, keepdims=True))
    return {
        "embed": (r.standard_normal((shape.symbols + 1, EMBED)) * 0.3).astype(np.float32),  # the last row begins a text
        "in": draw(EMBED, 3 * HIDDEN),
        "state": draw(HIDDEN, 2 * HIDDEN),
        "new": draw(HIDDEN, HIDDEN),
        "gates": np.zeros(3 * HIDDEN, np.float32),
        "class": draw(HIDDEN, shape.classes),
        "class_bias": np.log(by_class / by_class.sum()).astype(np.float32),
        "word": draw(shape.head_classes, HIDDEN, WIDTH),
        "word_bias": word,
    }


def inputs(p: dict) -> np.ndarray:
    """What each symbol adds to the gates; halved where a sigmoid follows, see :func:`unrolled`."""
    table = p["embed"] @ p["in"] + p["gates"]
    table[:, : 2 * HIDDEN] *= 0.5
    return table


def unrolled(p: dict, table: np.ndarray, symbols: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, list, np.ndarray, np.ndarray, np.ndarray]:
    """(states after each step, states before it, gates, candidates, reset states).

    ``symbols`` and ``fresh``: (steps, lanes); a lane that is fresh at a step
    begins a text there. A sigmoid is half a tanh of half its argument.
    """
    steps, lanes = symbols.shape
    half = p["state"] * table.dtype.type(0.5)
    xs = table[symbols]
    states, gate = np.empty((steps, lanes, HIDDEN), table.dtype), np.empty((steps, lanes, 2 * HIDDEN), table.dtype)
    new, reset = np.empty_like(states), np.empty_like(states)
    begins, before = fresh.any(axis=1).tolist(), []
    for t in range(steps):
        if begins[t]:
            h = h * ~fresh[t][:, None]
        before.append(h)
        g, n, s = gate[t], new[t], states[t]
        np.matmul(h, half, out=g)
        g += xs[t, :, : 2 * HIDDEN]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        np.multiply(g[:, HIDDEN:], h, out=reset[t])
        np.matmul(reset[t], p["new"], out=n)
        n += xs[t, :, 2 * HIDDEN :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=s)
        s *= g[:, :HIDDEN]
        s += n
        h = s
    return states, before, gate, new, reset


class Room:
    """Arrays that are used again: fresh memory for each would cost more than what fills it."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = int(np.prod(shape))
        had = self.held.get(name)
        if had is None or len(had) < size:
            had = self.held[name] = np.empty(size, np.float32)
        return had[:size].reshape(shape)


#: Logits are biases, which are logs of probabilities to begin with, and sums of
#: weights by states under 1. While the weights' sums are under this, exponentials
#: neither overflow nor all vanish, and the rows' maxima need not be looked for.
TAME = 30


def exponentials(logits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """In place, each row by its own factor; gives the rows' sums."""
    if np.abs(weights).sum(axis=-2).max() > TAME:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def product(room: Room | None, name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b if room is None else np.matmul(a, b, out=room(name, len(a), b.shape[1]))


def class_logits(p: dict, h: np.ndarray, room: Room | None = None) -> np.ndarray:
    out = product(room, "class", h, p["class"])
    out += p["class_bias"]
    return out


def in_classes(cls: np.ndarray, head_classes: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Places of head targets by class, and (class, begin, end) of each there."""
    head = np.flatnonzero(cls < head_classes)
    order = head[np.argsort(cls[head].astype(np.int16), kind="stable")]
    ends = np.searchsorted(cls[order], np.arange(head_classes + 1)).tolist()
    return order, [(c, ends[c], ends[c + 1]) for c in range(head_classes) if ends[c] < ends[c + 1]]


def word_logits(p: dict, h: np.ndarray, parts: list[tuple[int, int, int]], room: Room | None = None) -> np.ndarray:
    out = np.empty((len(h), WIDTH), h.dtype) if room is None else room("word", len(h), WIDTH)
    for c, a, b in parts:
        np.matmul(h[a:b], p["word"][c], out=out[a:b])
        out[a:b] += p["word_bias"][c]
    return out


def picked(logits: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural log of the softmax at one column of each row; spoils ``logits``."""
    sums = exponentials(logits, weights)
    return np.log(np.maximum(logits[np.arange(len(at)), at], 1e-37) / sums)


def log_probs(p: dict, shape: Shape, h: np.ndarray, target: np.ndarray, room: Room | None = None) -> np.ndarray:
    """Natural log of each target symbol's probability after states ``h``."""
    cls = shape.class_of(target)
    out = picked(class_logits(p, h, room), cls, p["class"])
    order, parts = in_classes(cls, shape.head_classes)
    if parts:
        out[order] += picked(word_logits(p, h[order], parts, room), target[order] - cls[order] * WIDTH, p["word"])
    return out


def errors(logits: np.ndarray, at: np.ndarray, n: int, weights: np.ndarray) -> float:
    """Turns logits into the gradient of the loss over n targets; gives the sum of losses."""
    sums = exponentials(logits, weights)
    rows = np.arange(len(at))
    own = logits[rows, at]
    loss = float(np.log(sums / np.maximum(own, 1e-37)).sum(dtype=np.float64))
    logits *= (1 / (n * sums))[:, None]
    logits[rows, at] -= logits.dtype.type(1 / n)
    return loss


def gradients(p: dict, shape: Shape, symbols: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: Room | None = None) -> tuple[dict, float, np.ndarray]:
    """Gradients of a window's mean loss, its mean loss and the state after it.

    ``symbols``, ``targets`` and ``fresh``: (steps, lanes); a target of -1 is
    not learned. Nothing goes back beyond the window or a text's beginning.
    """
    steps, lanes = symbols.shape
    states, before, gate, new, reset = unrolled(p, inputs(p), symbols, fresh, h)
    hs, target = states.reshape(-1, HIDDEN), targets.ravel()
    use = np.flatnonzero(target >= 0)
    n = max(1, len(use))
    all_used = len(use) == len(hs)
    hu, tu = (hs, target) if all_used else (hs[use], target[use])
    cls = shape.class_of(tu)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = class_logits(p, hu, room)
    loss = errors(d, cls, n, p["class"])
    g["class"], g["class_bias"] = hu.T @ d, d.sum(axis=0)
    du = d @ p["class"].T
    order, parts = in_classes(cls, shape.head_classes)
    if parts:
        ha = hu[order]
        d = word_logits(p, ha, parts, room)
        loss += errors(d, tu[order] - cls[order] * WIDTH, n, p["word"])
        back = np.empty_like(ha)
        for c, a, b in parts:
            g["word"][c], g["word_bias"][c] = ha[a:b].T @ d[a:b], d[a:b].sum(axis=0)
            np.matmul(d[a:b], p["word"][c].T, out=back[a:b])
        du[order] += back
    if all_used:
        dh_all = du.reshape(steps, lanes, HIDDEN)
    else:
        dh_all = np.zeros_like(hs)
        dh_all[use] = du
        dh_all = dh_all.reshape(steps, lanes, HIDDEN)
    dh = np.zeros((lanes, HIDDEN), hs.dtype)
    din = np.empty((steps, lanes, 3 * HIDDEN), hs.dtype) if room is None else room("din", steps, lanes, 3 * HIDDEN)
    back_new, back_state = p["new"].T.copy(), p["state"].T.copy()
    slope = gate * (1 - gate)
    candidate = (1 - gate[:, :, :HIDDEN]) * (1 - new * new)
    begins = fresh.any(axis=1).tolist()
    for t in range(steps - 1, -1, -1):
        b, z, r = before[t], gate[t, :, :HIDDEN], gate[t, :, HIDDEN:]
        dh = dh + dh_all[t]
        dn = din[t, :, 2 * HIDDEN :]
        np.multiply(dh, candidate[t], out=dn)
        dr = dn @ back_new
        dgate = din[t, :, : 2 * HIDDEN]
        np.subtract(b, new[t], out=dgate[:, :HIDDEN])
        dgate[:, :HIDDEN] *= dh
        np.multiply(dr, b, out=dgate[:, HIDDEN:])
        dgate *= slope[t]
        dh *= z
        dr *= r
        dh += dr
        dh += dgate @ back_state
        if begins[t]:
            dh *= ~fresh[t][:, None]
    flat = din.reshape(-1, 3 * HIDDEN)
    g["state"] = np.concatenate(before).T @ flat[:, : 2 * HIDDEN]
    g["new"] = reset.reshape(-1, HIDDEN).T @ flat[:, 2 * HIDDEN :]
    symbol = symbols.ravel()
    order = np.argsort(symbol.astype(np.int16), kind="stable")
    first = np.flatnonzero(np.diff(symbol[order], prepend=-1))
    rows, sums = symbol[order][first], np.add.reduceat(flat[order], first, axis=0)
    g["embed"][rows] = sums @ p["in"].T
    g["in"], g["gates"] = p["embed"][rows].T @ sums, flat.sum(axis=0)
    return g, loss / n, states[-1]


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def update(self, p: dict, g: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        step = np.float32(self.rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, x in g.items():
            x *= scale
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (x - m)
            x *= x
            v += np.float32(0.01) * (x - v)
            np.sqrt(v, out=x)
            x += np.float32(1e-6)
            np.divide(m, x, out=x)
            x *= step
            p[k] -= x


def learned(p: dict, shape: Shape, best: Adam, texts: list[np.ndarray], most_lanes: int = 256, least_windows: int = 64) -> int:
    """Updates the weights by truncated backpropagation over texts end to end.

    Every symbol is a target once. There are as many lanes as leave so many
    windows to each, and ``most_lanes`` at the outside.
    """
    target = np.concatenate(texts).astype(np.int32)
    n = len(target)
    sizes = np.array([len(t) for t in texts])
    fresh = np.zeros(n, bool)
    fresh[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    symbol = np.concatenate([[shape.symbols], target[:-1]])
    symbol[fresh] = shape.symbols
    lanes = max(1, min(most_lanes, n // (least_windows * WINDOW)))
    steps = -(-n // lanes)
    room = steps * lanes - n
    # A lane is a row of these; a window is a few columns, handed on with steps first.
    grid = [np.concatenate([x, np.full(room, fill, x.dtype)]).reshape(lanes, steps) for x, fill in ((symbol, 0), (target, -1), (fresh, False))]
    h, room = np.zeros((lanes, HIDDEN), np.float32), Room()
    for at in range(0, steps, WINDOW):
        x, y, f = (np.ascontiguousarray(a[:, at : at + WINDOW].T) for a in grid)
        g, _, h = gradients(p, shape, x, y, f, h, room)
        best.update(p, g)
    return n


def document_log_probs(p: dict, shape: Shape, texts: list[np.ndarray], most_lanes: int = 512) -> np.ndarray:
    """Natural log probability of every whole text's symbols.

    Texts are dealt to lanes, longest first, each to the lane that is shortest
    so far; no text is cut, and state is carried from window to window. There
    are no more lanes than the longest text leaves busy.
    """
    out = np.zeros(len(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    lanes = int(max(1, min(most_lanes, -(-int(sizes.sum()) // int(sizes.max())))))
    ends, heap = np.zeros(lanes, np.int64), [(0, k) for k in range(lanes)]
    steps = 0
    placed = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if n:
            at, lane = heap[0]
            heapq.heapreplace(heap, (at + n, lane))
            placed.append((i, lane, at, n))
            steps = max(steps, at + n)
            ends[lane] = at + n
    target, owner = np.full((lanes, steps), -1, np.int32), np.zeros((lanes, steps), np.int32)
    fresh = np.zeros((lanes, steps), bool)
    for i, lane, at, n in placed:
        target[lane, at : at + n] = texts[i]
        owner[lane, at : at + n] = i
        fresh[lane, at] = True
    # Lanes that end first fall away first.
    by_end = np.argsort(-ends, kind="stable")
    target, owner, fresh, ends = target[by_end], owner[by_end], fresh[by_end], ends[by_end]
    table, h = inputs(p), np.zeros((lanes, HIDDEN), np.float32)
    last, room = np.full(lanes, shape.symbols, np.int32), Room()
    for at in range(0, steps, WINDOW):
        live = int(np.searchsorted(-ends, -at, side="left"))  # lanes longer than this
        y, who, f = (np.ascontiguousarray(a[:live, at : at + WINDOW].T) for a in (target, owner, fresh))
        x = np.concatenate([last[None, :live], y[:-1]])
        x[f] = shape.symbols
        states = unrolled(p, table, np.maximum(x, 0), f, h[:live])[0]
        h, last = states[-1], y[-1]
        use = np.flatnonzero(y.ravel() >= 0)
        got = log_probs(p, shape, states.reshape(-1, HIDDEN)[use], y.ravel()[use], room)
        out += np.bincount(who.ravel()[use], got.astype(np.float64), len(texts))
    return out
