"""Benchmark decontamination by the q-gram lemma.

A window of a benchmark item and a passage within e edits of it share at least
m - q + 1 - q * e of the window's q-grams (m characters), and these lie in e + 1
neighbouring diagonals. Shared q-grams are counted in overlapping bands of
diagonals; only bands that reach the bound are verified, by alignment within the
band. Besides, what is copied word for word is found at every offset of an item:
shared q-grams that follow each other on one diagonal are a verbatim run, and one
of 13 words or of a window's length is a leak. Characters are bytes of a normal form: ASCII letters in lower case, every
run of ASCII that is no letter or digit one blank, other bytes as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

Q = 8
WINDOW, STRIDE = 100, 50
#: Edits allowed in a window, in hundredths of its length.
EDITS = 8
#: Words of an item in a row that are a leak if they are copied exactly.
VERBATIM = 13
#: Items shorter than this are a leak only as they stand, as whole words.
LEAST = 24
#: Normal bytes worked on at once, and benchmark bytes indexed at once.
PIECE, BLOCK = 1 << 22, 1 << 22
#: Shared q-grams, by window, that are held at once; beyond it a piece is cut in two.
HITS, SMALLEST = 1 << 22, 1 << 11

NORMAL = np.full(256, 32, np.uint8)
NORMAL[48:58], NORMAL[97:123], NORMAL[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)
NORMAL[128:] = np.arange(128, 256)


def normal(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal form of texts that lie end to end; and where each begins in it."""
    out = NORMAL[data]
    blank = out == 32
    drop = blank.copy()
    drop[1:] &= blank[:-1]
    begin = starts[:-1][starts[:-1] < len(data)]
    drop[begin] = blank[begin]  # a text does not begin with a blank
    keep = ~drop
    moved = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], moved[starts]


def grams(data: np.ndarray) -> np.ndarray:
    """The q-gram at each position as a 64-bit number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray(len(data) - Q + 1, "<u8", np.ascontiguousarray(data), strides=(1,)).copy()


def slots(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def owners(found: list[np.ndarray], known: np.ndarray, *columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Where each known q-gram's entries begin, and the columns in that order."""
    g = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.argsort(g, kind="stable")
    first = np.append(np.searchsorted(g[order], known), len(g))
    return first, *(np.concatenate(c)[order] if found else np.zeros(0, np.int32) for c in columns)


def spread(first: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For q-grams k: how many entries each has, and the places of all."""
    n = first[k + 1] - first[k]
    return n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)


def crowded(at: np.ndarray, need: int, reach: int) -> np.ndarray:
    """Which of the sorted places are among ``need`` that lie within ``reach``."""
    if len(at) < need:
        return np.zeros(len(at), bool)
    begins = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] <= reach)
    change = np.zeros(len(at) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + need, -1)
    return np.cumsum(change)[:-1] > 0


class Index:
    """q-grams of some benchmark items and of their windows.

    Windows that are alike, as of a prompt that many items share, are one; its
    items are all told of. ``small``: the items that are a leak as they stand.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.text: list[np.ndarray] = []
        self.items: list[list] = []
        self.whole, self.small = [], {}
        known: dict[bytes, int] = {}
        of_windows, window, offset, of_items, place = [], [], [], [], []
        began, ended, base = [], [], [0]
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            whole = normal(raw, np.array([0, len(raw)]))[0]
            if len(whole) and whole[-1] == 32:
                whole = whole[:-1]
            if len(whole) < LEAST:
                if len(whole):
                    self.small.setdefault(tuple(bytes(whole).split(b" ")), []).append(item)
                continue
            # Word starts before, and word ends up to, each place of the item.
            inner, edge = whole != 32, np.zeros(1, bool)
            began.append(np.cumsum(np.concatenate([[0], inner & ~np.concatenate([edge, inner[:-1]])])))
            ended.append(np.cumsum(np.concatenate([[0], inner & ~np.concatenate([inner[1:], edge])])))
            g = grams(whole)
            of_items.append(g)
            place.append(base[-1] + np.arange(len(g)))
            base.append(base[-1] + len(whole) + 1)
            last = max(0, len(whole) - WINDOW)
            for at in sorted({*range(0, last, STRIDE), last}):
                part = whole[at : at + WINDOW]
                k = known.setdefault(part.tobytes(), len(self.text))
                if k == len(self.text):
                    g = grams(part)
                    of_windows.append(g)
                    window.append(np.full(len(g), k, np.int32))
                    offset.append(np.arange(len(g), dtype=np.int32))
                    self.text.append(part)
                    self.items.append([])
                self.items[k].append(item)
            self.whole.append(item)
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = self.size * EDITS // 100
        self.need = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        self.base = np.array(base, np.int64)
        self.began, self.ended = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (began, ended))
        self.grams = np.unique(np.concatenate(of_items)) if of_items else np.zeros(0, np.uint64)
        self.first, self.window, self.offset = owners(of_windows, self.grams, window, offset)
        self.item_first, self.place = owners(of_items, self.grams, place)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[slots(self.grams)] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the q-grams that are known, and which they are."""
        g = grams(data)
        at = np.flatnonzero(self.seen[slots(g)])
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[k] == g[at]
        return at[same], k[same]

    def verbatim(self, at: np.ndarray, k: np.ndarray) -> list[tuple[int, int]]:
        """(place, item's place) of runs that copy enough of an item exactly."""
        least = min(2 * VERBATIM - 1, WINDOW) - Q + 1
        n, into = spread(self.item_first, k)
        at, place = np.repeat(at, n), self.place[into]
        order = np.lexsort((at, at - place))  # places tell items apart
        at, place = at[order], place[order]
        joint = (np.diff(at, prepend=-2) != 1) | (np.diff(at - place, prepend=-1) != 0)
        first = np.flatnonzero(joint)
        n = np.diff(first, append=len(at))
        first, n = first[n >= least], n[n >= least]
        low, size = place[first], n + Q - 1
        ok = (self.ended[low + size] - self.began[low] >= VERBATIM) | (size >= WINDOW)
        whole = np.searchsorted(self.base, low[ok], side="right") - 1
        return list(zip(at[first[ok]].tolist(), whole.tolist(), strict=True))

    def matches(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]] | None:
        """(text, window, edits) of passages found; ``starts`` has the texts' bounds.

        A verbatim run has its item's place, negative and from -1, for a window.
        None if there are too many hits to hold and the piece can be cut.
        """
        at, k = self.hits(data)
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + Q <= starts[text + 1]
        at, k, text = at[inside], k[inside], text[inside]
        if not len(at):
            return []
        # What a verbatim run or a passage within its budget asks of the places alone.
        least = min(2 * VERBATIM - 1, WINDOW) - Q + 1
        run, close = crowded(at, least, least - 1), crowded(at, int(self.need.min()), int((self.size + self.edits).max()) - Q)
        if len(data) > SMALLEST and (self.first[k[close] + 1] - self.first[k[close]]).sum() + (self.item_first[k[run] + 1] - self.item_first[k[run]]).sum() > HITS:
            return None
        exact = [(int(np.searchsorted(starts, p, side="right")) - 1, -1 - w, 0) for p, w in self.verbatim(at[run], k[run])]
        n, into = spread(self.first, k[close])
        at, text, win, off = np.repeat(at[close], n), np.repeat(text[close], n), self.window[into].astype(np.int64), self.offset[into]
        step = self.edits[win] + 1
        band = (at - off + WINDOW) // step  # diagonals may begin before the text
        wide = len(data) + 2 * WINDOW
        key = np.concatenate([(text * len(self.size) + win) * wide + b for b in (band, np.maximum(band - 1, 0))])
        key, count = np.unique(key, return_counts=True)
        pair, band = key // wide, key % wide
        text, win = pair // len(self.size), pair % len(self.size)
        ok = count >= self.need[win]
        return exact + self.aligned(data, starts, text[ok], win[ok], band[ok])

    def aligned(self, data, starts, text, win, band) -> list[tuple[int, int, int]]:
        """Those candidates whose band holds an alignment within the budget."""
        out: list[tuple[int, int, int]] = []
        for size, edits in sorted({(int(s), int(e)) for s, e in zip(self.size[win], self.edits[win], strict=True)}):
            chosen = np.flatnonzero((self.size[win] == size) & (self.edits[win] == edits))
            wide = 2 * (edits + 1) + 2 * edits + 1
            steps = np.arange(wide, dtype=np.int32)
            for k in range(0, len(chosen), 2048):
                c = chosen[k : k + 2048]
                from_ = band[c] * (edits + 1) - WINDOW - edits
                place = from_[:, None] + np.arange(size + wide)
                live = (place >= starts[text[c]][:, None]) & (place < starts[text[c] + 1][:, None])
                t = np.where(live, data[np.clip(place, 0, len(data) - 1)], 0)
                p = np.stack([self.text[w] for w in win[c]])
                cost = np.zeros((len(c), wide), np.int32)
                for i in range(size):
                    now = cost + (t[:, i : i + wide] != p[:, i : i + 1])
                    np.minimum(now[:, :-1], cost[:, 1:] + 1, out=now[:, :-1])
                    cost = np.minimum.accumulate(now - steps, axis=1) + steps
                best = cost.min(axis=1)
                out += [(int(text[x]), int(win[x]), int(b)) for x, b in zip(c, best, strict=True) if b <= edits]
        return out


#: More than a passage with its edits, and than what makes a verbatim run a leak.
OVERLAP = 4 * WINDOW


def pieces(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes that cover all texts; they overlap by more than a match."""
    at, end = 0, int(bounds[-1])
    while at < end:
        yield at, min(end, at + PIECE)
        if at + PIECE >= end:
            return
        at += PIECE - OVERLAP


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes, end to end, and each text's bounds; null is empty."""
    column = column.fill_null("") if column.null_count else column
    buffers = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def found_in(column: pa.Array, index: Index) -> list[tuple[int, int, int, int]]:
    """(row, item, windows found, least edits); windows of an item that are alike count each."""
    data, bounds = normal(*text_bytes(column))
    best: dict[tuple[int, int], int] = {}
    work = list(pieces(bounds))[::-1] if len(data) and len(index.grams) else []
    while work:
        a, b = work.pop()
        first, last = np.searchsorted(bounds, a, side="right") - 1, np.searchsorted(bounds, b, side="left")
        inner = np.clip(bounds[first : last + 1], a, b) - a
        got = index.matches(data[a:b], inner)
        if got is None:
            middle = (a + b) // 2
            work += [(middle - OVERLAP // 2, b), (a, middle + OVERLAP // 2)]
            continue
        for text, win, edits in got:
            key = int(first) + text, win
            best[key] = min(edits, best.get(key, edits))
    out: dict[tuple[int, int], list[tuple[bool, int]]] = {}
    for (row, win), edits in best.items():
        for item in index.items[win] if win >= 0 else [index.whole[-1 - win]]:
            out.setdefault((row, item), []).append((win >= 0, edits))
    if index.small:
        lengths = {len(w) for w in index.small}
        for row in range(len(bounds) - 1):
            words = data[bounds[row] : bounds[row + 1]].tobytes().split()
            for n in lengths:
                for gram in set(zip(*(words[k:] for k in range(n)), strict=False)) & index.small.keys():
                    for item in index.small[gram]:
                        out.setdefault((row, item), []).append((True, 0))
    return [(row, item, sum(w for w, _ in e), min(d for _, d in e)) for (row, item), e in sorted(out.items(), key=lambda x: (x[0][0], str(x[0][1])))]


def leaks(docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), text: str = "text", block: int = BLOCK) -> DataFrame:
    """(carried columns, item_id, n_windows, edits): every item found in a row.

    ``n_windows``: how many of the item's windows of 100 characters (one each
    50; the whole of a shorter item) have a passage within 8 % edits in the whole
    text, or 0 if there is only a verbatim run, of 13 words of the item or of 100
    characters, from any place in it; ``edits``: the least. Rows without a leak give no row. The benchmark
    is indexed in blocks of so many bytes, each sent to the executors by itself.
    Items under 24 characters are found where they stand as whole words, as one
    window without edits. Null and empty texts and items match nothing; rows
    and items that repeat count each by itself (items that share an id as one);
    tables without rows give none.
    """
    spark = docs.sparkSession
    rows = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    item_type = dict(benchmark.dtypes)["item_id"]
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + f", item_id {item_type}, n_windows int, edits int"

    def passed(items: list[tuple[int, str | None]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(items))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = found_in(batch.column(batch.num_columns - 1), shared.value)
                if got:
                    row, item, n, edits = zip(*got, strict=True)
                    held = [c.take(pa.array(row)) for c in batch.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*held, pa.array(item), pa.array(n, pa.int32()), pa.array(edits, pa.int32())], names=[*carry, "item_id", "n_windows", "edits"])

        return rows.mapInArrow(find, schema)

    made, items, size = [], [], 0
    for item in benchmark.select("item_id", "text").toLocalIterator():
        if size >= block:
            made.append(written(passed(items), "leaks"))
            items, size = [], 0
        items.append((item[0], item[1]))
        size += len(item[1] or "")
    last = passed(items)
    for part in made:
        last = last.unionByName(part)
    return last


def cleaned(docs: DataFrame, benchmark: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns.

    A filter in place: no row moves, whatever the ids. A benchmark of several
    blocks makes as many passes, each over what the one before left.
    """
    spark = docs.sparkSession
    schema, place = docs.schema, docs.columns.index(text)

    def passed(rows: DataFrame, items: list[tuple[int, str | None]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Index(items))

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                stays[[row for row, *_ in found_in(batch.column(place), shared.value)]] = False
                yield batch.filter(pa.array(stays))

        return rows.mapInArrow(clean, schema)

    items, size = [], 0
    for item in benchmark.select("item_id", "text").toLocalIterator():
        if size >= block:
            docs = written(passed(docs, items), "decontaminated")
            items, size = [], 0
        items.append((item[0], item[1]))
        size += len(item[1] or "")
    return passed(docs, items)
