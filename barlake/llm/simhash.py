"""Near-duplicates by SimHash fingerprints that are compared bit-sliced.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word shingles. Fingerprints
meet in cells: all that agree on the bits of one of several key sets. Inside a cell the fingerprints are kept
as bit planes (plane p holds bit p of every lane), and all lanes are compared with those s places further at
once: the XOR of a plane with itself shifted is one bit of each distance, carry-save adders add the planes to
bit-sliced counters, and a block is abandoned when all its lanes exceed the radius. A cell yields a link from each
linked fingerprint to the smallest one that it is connected with there, never all pairs. Cells over `CELL_ROWS` fingerprints are dealt out as a grid of chunk
pairs, so no task holds a hot cell. Links become components by label propagation with pointer jumping.

Key sets are exact for the contract's radius (`block_keys`: with b blocks and a radius r any two fingerprints
within r bits agree on b - r blocks) or sampled bit positions for wide radii (`sampled_keys`).

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a fingerprint and so
a component. Rows with a null doc_id take part; a component of such rows only has a null component_id.

Tables of fingerprints, cells and links grow with the input but take few bytes as Parquet, so that Spark would broadcast them
up to sizes that the driver cannot hold. Their joins are asked to be merge joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake import session
from barlake.llm.common import fixed_hash, mix64, rows, texts

CELL_ROWS = 4096
HASH_SEED = 42
#: Shingle hashes counted at a time, so that a very long text needs no more memory than others.
HASHES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = 4, width: int = 64) -> bytes:
    """The fingerprint of one text, most significant bit first; `width` is a multiple of 64.

    A-Z are lower-cased and words are runs of bytes other than blanks and ASCII control white space.
    The first 64 bits come from XXH64 of the shingle, further words are mixed from it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(width // 8)
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    counts = np.zeros(width, np.int64)
    for at in range(0, len(parts), HASHES_AT_ONCE):
        h = fixed_hash(parts[at : at + HASHES_AT_ONCE], HASH_SEED)
        wide = np.stack([h] + [mix64(h, k) for k in range(1, width // 64)], axis=1)
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(h), -1), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > len(parts)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, width: int = 64) -> DataFrame:
    """doc_id and fp (binary) of every row of docs, from its whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield rows({"doc_id": b.column("doc_id"), "fp": [fingerprint(t, shingle, width) for t in texts(b, "text")]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def block_keys(width: int, radius: int, blocks: int) -> list[list[int]]:
    """Key sets that every pair within the radius shares at least one of: blocks - radius blocks each."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    parts = [list(map(int, p)) for p in np.array_split(np.arange(width), blocks)]
    return [sum(c, []) for c in combinations(parts, blocks - radius)]


def sampled_keys(width: int, tables: int, bits: int, seed: int = 7) -> list[list[int]]:
    """Fixed random bit positions; a pair with a share d of differing bits is missed with (1-(1-d)^bits)^tables."""
    rng = np.random.default_rng(seed)
    return [sorted(map(int, rng.choice(width, bits, replace=False))) for _ in range(tables)]


def _cells(distinct: DataFrame, keys: list[list[int]]) -> DataFrame:
    """A row (cell, fp) for each distinct fingerprint and key set."""
    schema = pa.schema([("cell", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp")
            if not len(fps):
                continue
            bits = _bits(fps.to_pylist())
            for t, positions in enumerate(keys):
                value = bits[:, positions].astype(np.int64) @ (1 << np.arange(len(positions), dtype=np.int64))
                yield rows({"cell": value * len(keys) + t, "fp": fps}, schema)

    return distinct.select("fp").mapInArrow(run, "cell long, fp binary")


def _bits(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1)


def _plane(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def _lanes(plane: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(plane.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def _beyond(counter: list[int], radius: int, lanes: int) -> int:
    """The lanes whose bit-sliced count is over the radius."""
    over, equal = 0, lanes
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            over |= equal & counter[k]
            equal &= ~counter[k]
    return over


def _within(planes: list[int], shift: int, lanes: int, radius: int) -> int:
    """Of the given lanes, those whose fingerprint differs from that `shift` lanes further in at most radius bits."""
    counter = [0] * (len(planes).bit_length() + 1)

    def add(k: int, a: int, b: int) -> int:
        c = counter[k]
        u = c ^ a
        counter[k] = u ^ b
        return (c & a) | (u & b)

    for at in range(0, len(planes), 4):
        a, b, c, d = ((p ^ (p >> shift)) & lanes for p in planes[at : at + 4])
        carry = add(1, add(0, a, b), add(0, c, d))
        k = 2
        while carry:
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
            k += 1
        if at + 4 > radius and at % 16 == 12:
            lanes &= ~_beyond(counter, radius, lanes)
            if not lanes:
                return 0
    return lanes & ~_beyond(counter, radius, lanes)


def forest(group: np.ndarray, bits: np.ndarray, radius: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links inside each group of lanes; with sides, of links between different sides only.

    Equal group numbers stand together. Groups are compared in order of size, so that the lanes still at
    work for a shift are always the first ones; groups that have become connected leave.
    """
    if len(group) < 2:
        return []
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    by_size = np.argsort(-size, kind="stable")
    order = np.concatenate([np.arange(first[g], first[g] + size[g]) for g in by_size if size[g] > 1] or [np.empty(0, np.int64)])
    size = size[by_size][size[by_size] > 1]
    if not len(order):
        return []
    lane, label, edges, bits = order, np.arange(len(order)), [], bits[order]
    side = None if side is None else side[order]
    begin = np.cumsum(size) - size
    planes: list[int] | None = None
    shift = check = 1
    while shift < size[0]:
        if shift == check:
            check *= 2
            # what is connected, or shorter than the shift, needs no further comparison
            live = (np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin)) & (size > shift)
            if planes is None or 2 * size[live].sum() <= len(lane):
                if not live.any():
                    break
                pick = np.repeat(live, size)
                lane, label, bits, side = lane[pick], label[pick], bits[pick], None if side is None else side[pick]
                size = size[live]
                begin = np.cumsum(size) - size
                start = np.repeat(begin, size)
                end = start + np.repeat(size, size)
                planes = [_plane(bits[:, p]) for p in range(bits.shape[1])]
        n = int(size[size > shift].sum())
        here = np.arange(n)
        here = here[here + shift < end[:n]]
        here = here[label[here] != label[here + shift]]
        if side is not None:
            here = here[side[here] != side[here + shift]]
        if len(here):
            flags = np.zeros(n, bool)
            flags[here] = True
            found = _within(planes, shift, _plane(flags), radius)
            for i in _lanes(found, n) if found else ():
                a, b = label[i], label[i + shift]
                if a != b:
                    own = label[start[i] : end[i]]
                    own[own == b] = a
                    edges.append((int(lane[i]), int(lane[i + shift])))
        shift += 1
    return edges


def stars(edges: list[tuple[int, int]], names: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Each member of the edges' components with the component's smallest name.

    Cells that hold the same texts so yield the same links, and copies of a link go before it is used.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for x, y in edges:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b, key=names.__getitem__)] = min(a, b, key=names.__getitem__)
    return [(names[x], names[root(x)]) for x in list(parent) if root(x) != x]


def links(distinct: DataFrame, radius: int, keys: list[list[int]], cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that a chain of links connects."""
    cells = _cells(distinct, keys)
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / cell_rows).cast("int")
    dealt = (
        cells.join(sizes.hint("merge"), "cell")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    )
    dealt = dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(t: pa.Table) -> Iterator[pa.RecordBatch]:
            fps = t.column("fp").to_pylist()
            if len(fps) < 2:
                return
            cell, i, j, part = (t.column(c).to_numpy() for c in ("cell", "i", "j", "part"))
            new = np.r_[False, (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            # on the grid's diagonal every lane is a side of its own
            side = np.where(i == j, np.arange(len(fps)), -1 - part)
            if found := stars(forest(np.cumsum(new), _bits(fps), radius, side), fps):
                yield rows({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema)

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            t = pa.Table.from_batches(held)
            cell, i, j = (t.column(c).to_numpy() for c in ("cell", "i", "j"))
            open_ = np.flatnonzero((cell != cell[-1]) | (i != i[-1]) | (j != j[-1]))
            if len(open_):
                cut = int(open_[-1]) + 1
                yield from compared(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of the edges (a, b).

    Each node first moves to its smallest neighbour, so all but few edges lie inside one of the stars that this
    makes; only edges between stars take part in the label propagation.
    """
    both = session.cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    stars_ = session.cut(_first_labels(both))
    ends = [stars_.select(F.col("node").alias(c), F.col("label").alias(f"{c}_star")) for c in ("a", "b")]
    between = both.join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b").where("a_star <> b_star")
    between = session.cut(between.select(F.col("a_star").alias("a"), F.col("b_star").alias("b")).distinct())
    if between.isEmpty():
        return stars_
    labels = session.cut(_first_labels(between))
    while True:
        near = between.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        # a star that no edge leaves keeps its own name
        jumped = session.cut(stepped.join(jump.hint("merge"), "to", "left").select("node", "was", F.least("to", "further").alias("label")))
        if jumped.filter(F.col("label") != F.col("was")).isEmpty():
            break
        labels = jumped.select("node", "label")
    final = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
    return stars_.join(final.hint("merge"), "label", "left").select("node", F.coalesce("last", "label").alias("label"))


def _first_labels(both: DataFrame) -> DataFrame:
    return both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))


def components(prints: DataFrame, radius: int, keys: list[list[int]], cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every fingerprinted row."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    joined = connected(links(distinct.select("fp"), radius, keys, cell_rows))
    named = distinct.join(joined.hint("merge"), distinct.fp == joined.node, "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label"))
    named = session.cut(named)
    ids = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_fp = named.join(ids.hint("merge"), "label").select("fp", "component_id")
    return prints.join(of_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, width: int = 64, radius: int = 4, keys: list[list[int]] | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, fp and component_id per row of docs; by default as the contract of `op10_simhash` has it."""
    keys = keys or block_keys(width, radius, radius + 2)
    return components(session.cut(fingerprints(docs, shingle, width)), radius, keys, cell_rows)


#: For texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: such sets are at an
#: angle whose share of 256 bits is at most 0.15, with a standard deviation of 0.022.
SIMILAR = {"shingle": 5, "width": 256, "radius": 44, "keys": sampled_keys(256, 28, 14)}


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's result: doc_id, fingerprint (16 hex digits) and component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
