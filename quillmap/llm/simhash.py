"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Distinct fingerprints are laid out in tiles whose members share the population
counts of their parts. A pair of tiles whose counts differ by more than the
radius holds no link and is never made; the rest are compared bit for bit with
numpy. What leaves a tile pair is a spanning forest of its links, nearest first,
so that a group of thousands of copies costs its size and not its square.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, joined_small, let, text_or_empty, words, written
from .components import components

#: Comparisons at once: their bits stay in a core's cache.
BLOCK = 1 << 19
#: Shingles whose bits are unpacked at once.
PART = 1 << 16


def respun(h: np.ndarray, turn: int) -> np.ndarray:
    """Another 64-bit hash of the same things (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(turn * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> Iterator[int]:
    """XXH64 of each of a text's shingles of ``size`` words, repeats included.

    A text of fewer words has one shingle, the words it has; one without words
    (or null) has none.
    """
    w = (text or "").encode().lower().split()
    if not w:
        return iter(())
    grams = iter([b" ".join(w)]) if len(w) < size else map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return (digest(s, 42) for s in grams)


def chunked(hashes: Iterator[int]) -> Iterator[np.ndarray]:
    while len(h := np.fromiter(itertools.islice(hashes, PART), np.uint64)):
        yield h


def sliced(hashes: np.ndarray) -> Iterator[np.ndarray]:
    return (hashes[k : k + PART] for k in range(0, len(hashes), PART))


def summed_signs(parts: Iterable[np.ndarray], width: int) -> np.ndarray:
    """The SimHash of shingles by arrays of their hashes; zeros if there are none."""
    total, n = np.zeros((width, 64), np.int64), 0
    for h in parts:
        for k in range(width):
            bits = (respun(h, k) if k else h).astype("<u8").view(np.uint8).reshape(-1, 8)
            total[k] += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return np.packbits(2 * total > n, axis=1, bitorder="little").view("<u8").ravel()


def wide_fingerprint(text: str | None, size: int = 3, width: int = 1, distinct: bool = False) -> np.ndarray:
    """The SimHash of a text's shingles of ``size`` words, repeats included.

    ``width`` words of 64 bits; the first is that of the shingles' XXH64, the
    others are of hashes spun from it. A text without words has zeros. With
    ``distinct`` each shingle counts once, as in the Jaccard similarity.
    """
    hashes = shingle_hashes(text, size)
    if distinct:
        return summed_signs(sliced(np.unique(np.fromiter(hashes, np.uint64))), width)
    return summed_signs(chunked(hashes), width)


def with_set_id(text: str | None, size: int, width: int) -> tuple[np.ndarray, int, list[int]]:
    """The fingerprint of distinct shingles, 64 bits that stand for their set, and its groups."""
    hashes = np.unique(np.fromiter(shingle_hashes(text, size), np.uint64))
    node = int.from_bytes(hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=8).digest(), "little")
    return summed_signs(sliced(hashes), width), node, groups_of(hashes)


#: Sets are compared where they agree in both least hashes of one of so many
#: pairs: of sets with a similarity of 0.8 all but 0.36 ** 6 = 0.2 % do.
GROUPS = 6


def groups_of(hashes: np.ndarray) -> list[int]:
    """For each pair of spun hashes, what stands for the least ones over the set."""
    if not len(hashes):
        return [0] * GROUPS
    least = [int(min(respun(h, 1000 + k).min() for h in sliced(hashes))) for k in range(2 * GROUPS)]
    return [int.from_bytes(hashlib.blake2b(f"{k}:{least[2 * k]}:{least[2 * k + 1]}".encode(), digest_size=8).digest(), "little", signed=True) for k in range(GROUPS)]


def fingerprint(text: str | None, size: int = 3) -> int:
    return int(wide_fingerprint(text, size)[0])


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells rows apart unless both id and text agree."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), text_or_empty(text)).cast("binary"), 256)


def whole_key(columns: list[str] | tuple[str, ...]) -> Column:
    """What tells rows apart unless they agree in all of these columns."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def fingerprinted(docs: DataFrame, size: int = 3, carry: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = 1, sets: bool = False) -> DataFrame:
    """The carried columns, ``fp`` (64 bits as a long) and ``more`` (the words after it).

    With ``sets`` shingles count once, and there are ``node``, what rows of one set
    of shingles have in common, and ``groups`` (see :func:`groups_of`).
    """
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", fp long, more array<long>" + ", node long, groups array<long>" * sets

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            made = [with_set_id(t.as_py(), size, width) if sets else (wide_fingerprint(t.as_py(), size, width), 0, []) for t in texts]
            fps = np.array([f for f, _, _ in made], np.uint64).view(np.int64).reshape(-1, width)
            more = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * (width - 1)), pa.array(fps[:, 1:].ravel()))
            node = [pa.array(np.array([k for _, k, _ in made], np.uint64).view(np.int64)), pa.array([g for _, _, g in made], pa.list_(pa.int64()))] if sets else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps[:, 0].copy()), more, *node], names=[*carry, "fp", "more", *["node", "groups"] * sets])

    return rows.mapInArrow(hashed, schema)


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after each a is joined with its b."""
    parent = np.arange(len(label))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        if (low == high).all():
            return parent[label]
        np.minimum.at(parent, high, low)
        while (parent != (up := parent[parent])).any():
            parent = up


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of links that span the same components, nearest first (Boruvka)."""
    at = np.argsort(d, kind="stable")
    label, chosen = np.arange(n), [np.zeros(0, np.int64)]
    while True:
        a, b = label[i[at]], label[j[at]]
        live = a != b
        at, a, b = at[live], a[live], b[live]
        k = len(at)
        if not k:
            return np.concatenate(chosen)
        first = np.full(n, k)
        np.minimum.at(first, a, np.arange(k))
        np.minimum.at(first, b, np.arange(k))
        picks = np.unique(first[first < k])
        chosen.append(at[picks])
        label = merged(label, a[picks], b[picks])


def compared(left: np.ndarray, right: np.ndarray, same: bool, radius: int, wide_radius: int | None = None, roots: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links of two tiles: values and distances.

    Tiles have a row for each fingerprint and a column for each of its words.
    All pairs of first words are compared; what is within ``radius`` there is
    held to ``wide_radius`` over all words. Rows are taken in the order of their
    first words, so that ties fall alike in every run.

    With ``roots`` the last two columns have each row's node, which is given in
    place of its first word, and what the node is known to be linked to: rows of
    one root make no link. A node that has links outside the forest is then
    given with the least node of its component here and distance -1.
    """
    name = -2 if roots else 0
    left, right = (x[np.lexsort((x[:, name], x[:, 0]))] for x in (left, right))
    both = left if same else np.concatenate([left, right])
    shift = 0 if same else len(left)
    first, second = left[:, 0].copy(), right[:, 0].copy()
    wide = slice(1, name) if roots else slice(1, None)
    i = j = d = np.zeros(0, np.int64)
    cut = np.zeros(len(both), bool)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def thinned() -> None:
        nonlocal i, j, d, waiting
        i, j, d = (np.concatenate(x) for x in zip((i, j, d), *held, strict=True))
        held.clear()
        waiting = 0
        keep = forest(len(both), i, j, d)
        lost = np.ones(len(i), bool)
        lost[keep] = False
        cut[i[lost]] = cut[j[lost]] = True
        i, j, d = i[keep], j[keep], d[keep]

    step = max(1, BLOCK // max(1, len(right)))
    for at in range(0, len(left), step):
        # Of a tile with itself, each pair is looked at from its earlier member.
        begin = at if same else 0
        off = np.bitwise_count(first[at : at + step, None] ^ second[None, begin:])
        row, col = np.nonzero(off <= radius)
        dist = off[row, col].astype(np.int64)
        row, col = row + at, col + begin
        if same:
            row, col, dist = row[row < col], col[row < col], dist[row < col]
        if roots and len(row):
            apart = left[row, -1] != right[col, -1]
            row, col, dist = row[apart], col[apart], dist[apart]
        if wide_radius is not None and len(row):
            dist = dist + np.bitwise_count(left[row, wide] ^ right[col, wide]).sum(axis=1, dtype=np.int64)
            near = dist <= wide_radius
            row, col, dist = row[near], col[near], dist[near]
        if len(row):
            held.append((row, col + shift, dist))
            waiting += len(row)
            if waiting > max(BLOCK, len(i)):
                thinned()
    if held:
        thinned()
    if not roots:
        return both[i, name], both[j, name], d
    places = np.flatnonzero(cut)
    least = merged(np.arange(len(both)), i, j)[places]
    return np.concatenate([both[i, name], both[places, name]]), np.concatenate([both[j, name], both[least, name]]), np.concatenate([d, np.full(len(places), -1)])


def counts_within(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of population counts that a radius allows, one of each sign."""
    reach = range(-radius, radius + 1)
    found = [x for x in itertools.product(reach, repeat=parts) if sum(map(abs, x)) <= radius]
    return [x for x in found if x >= (0,) * parts]


def linked(fps: DataFrame, radius: int = 2, parts: int = 4, tile_rows: int = 4096, wide_radius: int | None = None, root: str | None = None, group: str | None = None) -> DataFrame:
    """(a, b, distance): links that span all components of distinct ``fp``.

    With ``wide_radius`` a link also has no more differing bits than that over
    ``fp`` and the words in ``more`` together. With ``root``, a column of longs,
    rows that share it are not linked, links are of ``node`` in place of ``fp``,
    which may then repeat, and rows of distance -1 tell which nodes have links
    outside the forests (see :func:`compared`).

    Exact: fingerprints that differ in ``radius`` bits or fewer end in one
    component. ``parts``: into how many parts of equal width the population
    count is taken; more parts skip more tile pairs and make smaller tiles.
    Signatures number (64/parts + 1) ** parts at most, whatever the input.

    ``group``, a column of longs: only rows of one group are compared. A group
    that fits a tile is one, whatever its counts; larger ones are laid out in
    tiles by population counts like a whole table.
    """
    spark = fps.sparkSession
    width = 64 // parts
    mask = (1 << width) - 1
    base = 65
    part = [F.bit_count(F.shiftrightunsigned("fp", width * k).bitwiseAND(F.lit(mask).cast("long"))).cast("long") if width < 64 else F.bit_count("fp").cast("long") for k in range(parts)]
    sig = sum((p * base**k for k, p in enumerate(part)), F.lit(0).cast("long"))
    more = F.col("more") if wide_radius is not None else F.array().cast("array<bigint>")
    more = F.concat(more, F.array("node", root)) if root else more
    at = F.col(group) if group else F.lit(0).cast("long")
    rows = fps.select("fp", more.alias("more"), sig.alias("sig"), F.col("node" if root else "fp").alias("own"), at.alias("at"))
    words = F.concat(F.array("fp"), "more").alias("words")
    made = []
    if group:
        # How large a group is is counted before its rows meet, so none is gathered that has no tile.
        per = written(rows.groupBy("at").count().filter("count > 1"), "groups")
        fits = rows.join(per.filter(F.col("count") <= tile_rows), "at").groupBy("at").agg(F.count(F.lit(1)).alias("n_left"), F.flatten(F.collect_list(words)).alias("left"))
        made.append(fits.select("left", F.array().cast("array<bigint>").alias("right"), "n_left", F.lit(0).cast("long").alias("n_right"), F.lit(True).alias("same")))
        # They number the rows over a tile's at most; with few of them nothing else moves.
        rows = joined_small(rows, per.filter(F.col("count") > tile_rows).select("at"), "at")
    sizes = written(rows.groupBy("at", "sig").count().select("at", "sig", F.ceil(F.col("count") / tile_rows).cast("int").alias("chunks")), "signatures")
    few = not group and (width + 1) ** parts <= 100_000  # all the signatures there can be
    small = F.broadcast if few else (lambda df: df)
    placed = rows.join(small(sizes), ["at", "sig"]).select("at", "sig", F.pmod(F.xxhash64("own"), F.col("chunks")).cast("int").alias("chunk"), words)
    tiles = written(placed.groupBy("at", "sig", "chunk").agg(F.count(F.lit(1)).alias("rows"), F.flatten(F.collect_list("words")).alias("fps")), "tiles")
    offsets = [sum(x * base**k for k, x in enumerate(d)) for d in counts_within(parts, radius)]
    near = F.array(*[F.lit(x).cast("long") for x in offsets])
    # A difference that leaves a part's range could meet another signature's
    # number; the counts themselves are compared again below.
    pairs = tiles.select("at", "sig", "chunk", F.explode(near).alias("o")).withColumn("to", F.col("sig") + F.col("o"))
    pairs = pairs.join(small(sizes.withColumnsRenamed({"sig": "to", "chunks": "n"})), ["at", "to"])
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).filter("sig <> to OR other >= chunk")
    digit = lambda c, k: F.pmod(F.floor(F.col(c) / base**k), F.lit(base))
    pairs = pairs.filter(sum((F.abs(digit("sig", k) - digit("to", k)) for k in range(parts)), F.lit(0)) <= radius)
    left = tiles.select("at", "sig", "chunk", F.col("rows").alias("n_left"), F.col("fps").alias("left"))
    right = tiles.select("at", F.col("sig").alias("to"), F.col("chunk").alias("other"), F.col("rows").alias("n_right"), F.col("fps").alias("right"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    work = pairs.select("at", "sig", "chunk", "to", "other").join(left, ["at", "sig", "chunk"]).join(right, ["at", "to", "other"])
    work = work.repartition(n, "at", "sig", "chunk", "to", "other").select("left", "right", "n_left", "n_right", ((F.col("sig") == F.col("to")) & (F.col("chunk") == F.col("other"))).alias("same"))
    for part in made:
        work = work.unionByName(part)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(c)[k].values.to_numpy().view(np.uint64).reshape(n, -1) for c in (0, 1) if (n := batch.column(c + 2)[k].as_py())]
                a, b, d = compared(sides[0], sides[-1], batch.column(4)[k].as_py(), radius, wide_radius, root is not None)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

    return work.mapInArrow(compare, "a long, b long, distance int")


def shingles(text: Column, size: int) -> Column:
    """The set of a text's shingle hashes; one shingle if it has fewer words."""

    def made(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
        short = F.when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) < size, short).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), at)))

    return let(words(F.translate(text_or_empty(text), UPPER, LOWER)), made)


def sets_of(nodes: DataFrame, docs: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """(node, s): the shingle sets of distinct nodes.

    ``first`` has (node, key): the row of ``docs`` (with its ``key``) that stands
    for a node.
    """
    texts = joined_small(docs.select("key", "text"), written(nodes.join(first, "node"), "simhash-nodes"), "key").dropDuplicates(["node"])
    return written(texts.select("node", shingles(F.col("text"), size).alias("s")), "simhash-shingles")


def verified(links: DataFrame, docs: DataFrame, first: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links between texts whose shingle sets have that Jaccard similarity.

    Two texts without words are alike.
    """
    links = written(links, "simhash-candidates")
    nodes = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(nodes, docs, first, size)
    pair = links.join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return pair.filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b", "distance")


#: Shingles of a tile of sets; a set counts for so many more, so rows are bounded too.
SHINGLES, EACH = 1 << 21, 256


def verified_forest(words: np.ndarray, side: np.ndarray, root: np.ndarray, flat: np.ndarray, sizes: np.ndarray, similarity: float, radius: int, wide_radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and distances of candidates that have the similarity and span all such.

    ``flat`` has the rows' shingle sets one after the other. Rows of one root are
    joined already. If there are two sides, only pairs across them are looked at.
    """
    kinds, ids = np.unique(flat, return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    label = np.unique(root, return_inverse=True)[1]
    across = len(np.unique(side)) > 1
    mark = np.zeros(len(kinds), bool)
    found: list[tuple[int, int, int]] = []
    for i in range(len(sizes) - 1):
        near = (np.bitwise_count(words[i + 1 :, 0] ^ words[i, 0]) <= radius) & (label[i + 1 :] != label[i])
        if across:
            near &= side[i + 1 :] != side[i]
        j = np.flatnonzero(near) + i + 1
        off = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
        may = (off <= wide_radius) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))
        j, off = j[may], off[may]
        if not len(j):
            continue
        mine = ids[begins[i] : ends[i]]
        mark[mine] = True
        upto = np.concatenate([[0], np.cumsum(mark[np.concatenate([ids[begins[k] : ends[k]] for k in j])])])
        mark[mine] = False
        last = np.cumsum(sizes[j])
        both = upto[last] - upto[last - sizes[j]]
        good = both >= similarity * (sizes[i] + sizes[j] - both)
        for k, d in zip(j[good], off[good], strict=True):
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                found.append((i, k, d))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def verified_in_tiles(rows: DataFrame, sets: DataFrame, similarity: float, radius: int, wide_radius: int) -> DataFrame:
    """(a, b, distance): links of the similarity that span all candidates' components.

    ``rows`` have node, root, fp, more and the group they are compared in (at).
    Each candidate whose ends no link joins yet is held to its shingle sets where
    the tiles meet; nothing but a spanning forest leaves a pair of tiles. A group
    beyond a tile's shingles is dealt into several, so no task holds more than two.
    """
    heavy = rows.join(sets, "node")
    weight = F.ceil(F.sum(F.size("s") + EACH) / SHINGLES).cast("int")
    per = written(rows.join(sets.select("node", "s"), "node").groupBy("at").agg(weight.alias("chunks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "simhash-weights")
    placed = joined_small(heavy, per, "at").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("at", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "node", "root", "fp", "more", "s")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        chunk, node, root, fp = (table[c].to_numpy() for c in ("chunk", "node", "root", "fp"))
        more, s = (pa.concat_arrays(table[c].chunks) for c in ("more", "s"))
        i = j = d = np.zeros(0, np.int64)
        # Of two tiles one may be empty; then there is no pair across them.
        if table["low"][0].equals(table["high"][0]) or len(np.unique(chunk)) > 1:
            words = np.concatenate([fp[:, None], more.flatten().to_numpy().reshape(len(fp), -1)], axis=1).view(np.uint64)
            i, j, d = verified_forest(words, chunk, root, s.flatten().to_numpy(), s.value_lengths().to_numpy().astype(np.int64), similarity, radius, wide_radius)
        return pa.table([pa.array(node[i]), pa.array(node[j]), pa.array(d.astype(np.int32))], ["a", "b", "distance"])

    return met.groupBy("at", "low", "high").applyInArrow(compare, "a long, b long, distance int")


def verified_links(fps: DataFrame, docs: DataFrame, first: DataFrame, size: int, similarity: float, radius: int, tile_rows: int, wide_radius: int) -> DataFrame:
    """Verified links that join all candidates which have the similarity.

    Of each tile pair's candidates a forest is verified, nearest first. Where
    candidates outside it may join what the verified links leave apart, their
    ends alone meet again, with their shingle sets, and every candidate between
    two components is verified there (see :func:`verified_in_tiles`).
    """
    grouped = fps.select("node", "fp", "more", F.explode("groups").alias("at"))
    made = written(linked(grouped.withColumn("root", F.col("node")), radius, 1, tile_rows, wide_radius, "root", "at"), "simhash-links")
    known = written(verified(made.filter("distance >= 0").dropDuplicates(["a", "b"]), docs, first, size, similarity), "simhash-verified")
    cut = made.filter("distance < 0").select(F.col("a").alias("node"), F.col("b").alias("near")).distinct()
    if cut.isEmpty():
        return known
    cut = written(classes(cut.select("node").distinct(), known, "node").join(cut, "node"), "simhash-cut")
    apart = cut.groupBy("near").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("near")
    again = written(joined_small(cut, written(apart, "simhash-apart"), "near").select("node", "root").distinct(), "simhash-again")
    rows = again.join(grouped, "node")
    more = verified_in_tiles(rows, sets_of(again.select("node"), docs, first, size), similarity, radius, wide_radius)
    return known.unionByName(written(more, "simhash-verified"))


def classes(fps: DataFrame, links: DataFrame, of: str = "fp") -> DataFrame:
    """(fp, root): the least fingerprint of each one's component (or of another column)."""
    roots = written(components(links).withColumnRenamed("node", "__node"), "simhash-roots")
    joined = fps.select(of).join(roots, F.col(of) == F.col("__node"), "left")
    return joined.select(of, F.coalesce("root", of).alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, parts: int = 4, tile_rows: int = 4096, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row.

    ``component_id`` is the least doc_id that links reach; null ids count for
    nothing (a component of null ids alone has null). Null, empty and wordless
    texts have fingerprint zero and link like others; repeated rows make a row
    each; an empty table gives an empty table; other columns are not read.
    """
    rows = written(fingerprinted(docs, size, text=text).drop("more"), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    of = classes(fps, linked(fps, radius, parts, tile_rows))
    by_root = of.join(fps, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(of.join(by_root, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 17, width: int = 4, wide_radius: int = 54, tile_rows: int = 8192) -> DataFrame:
    """One row of each group of near-duplicates: least doc_id, nulls last.

    Only texts of one group are compared (see :func:`groups_of`): those that
    share the least hashes of their shingles, so that the work follows the texts
    that have something in common and not the square of all.
    Fingerprints of distinct ``size``-word shingles have ``width`` words of 64 bits. At a
    Jaccard similarity of 0.8 SimHash expects 39 of 256 bits to differ, 5.7 more
    or less, and 9.7 of the first 64, 2.9 more or less; of texts that share
    nothing, 128. Pairs within both radii are candidates, and a link is a
    candidate whose shingle sets really have the similarity. Rows of one set are
    one node; rows of one fingerprint are candidates like others.
    Every candidate is verified unless verified links join its ends already
    (see :func:`verified_links`). Needs doc_id and text; all columns stay.

    Null, empty and wordless texts are alike, as their sets are empty. Of rows
    that share the least doc_id, and of rows with null ids alone, one stays: by
    all their columns, so that reruns agree. Rows that repeat are one. An empty
    table gives an empty table.
    """
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns])
    keyed = docs.select("doc_id", "text", whole_key(columns).alias("key"), whole.alias("row"))
    rows = written(fingerprinted(keyed, size, ("doc_id", "key"), width=width, sets=True), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("key"), F.col("fp").alias("fp"), F.col("more").alias("more"), F.col("groups").alias("groups"))
    nodes = written(rows.groupBy("node").agg(F.min(order).alias("first")), "distinct-sets")
    known = nodes.select("node", "first.fp", "first.more", "first.groups")
    links = verified_links(known, keyed, nodes.select("node", F.col("first.key").alias("key")), size, similarity, radius, tile_rows, wide_radius)
    of = classes(nodes, links, "node")
    stays = of.join(nodes, "node").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    return keyed.select("key", "row").join(stays, "key").dropDuplicates(["key"]).select("row.*")
