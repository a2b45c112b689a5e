"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit SimHashes of word shingles. Two of them are linked if at most ``distance`` (4) bits differ, and
linked documents form components.

Candidate search. The 64 bits are dealt to three blocks, so that linked fingerprints differ in at most one bit of some
block. The anchors of a block are a covering code: a perfect Hamming(15,11) code, of covering radius one, times all
values of the block's other bits. Each fingerprint has one home, the anchor that covers it, and is replicated to every
anchor that can be the home of a fingerprint one bit away (covering radius plus threshold). A pair is therefore
compared at the home of its first member, whatever the data; nothing is approximate.

Groups. Equal fingerprints are one node. At an anchor, homes are compared with residents in bounded chunks and only a
spanning forest of the links found leaves the task, never all pairs. An anchor with more than ``hot`` homes is dealt to
several tasks. Components come from alternating large-star and small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, heavy_join

#: (first bit, Hamming-coded bits, plain bits) of each block.
BLOCKS = ((0, 15, 7), (22, 15, 6), (43, 15, 6))
#: Pairs that one vector operation compares.
CHUNK = 1 << 20


def fingerprint_of(text: bytes | None, width: int = 4) -> int:
    """SimHash of one UTF-8 text: unsigned; zero for a text without words, or none."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    digest = xxhash.xxh64_intdigest
    return fingerprint_of_hashes(np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles)))


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set; zero for none."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _hamming15() -> tuple[np.ndarray, np.ndarray]:
    """Of each 15-bit word: its codeword, and the 7 other codewords within distance 2 (of a codeword: itself again)."""
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, np.int64)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    home = np.where(syndrome > 0, words ^ (1 << np.maximum(syndrome - 1, 0)), words)
    near = np.sort(np.stack([home[words ^ (1 << bit)] for bit in range(15)], axis=1), axis=1)
    others = np.repeat(home[:, None], 7, axis=1)
    for w in range(1 << 15):
        own = np.unique(near[w])
        own = own[own != home[w]]
        others[w, : len(own)] = own
    return home, others


_TABLES: list[np.ndarray] = []


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, anchor key, is it the home) for every anchor a fingerprint goes to."""
    if not _TABLES:
        _TABLES.extend(_hamming15())
    home15, others15 = _TABLES
    index, keys, homes = [], [], []
    rows = np.arange(len(fps))
    for table, (first, coded, plain) in enumerate(BLOCKS):
        block = (fps >> np.uint64(first)).astype(np.int64) & ((1 << (coded + plain)) - 1)
        low, high = block & 0x7FFF, block >> 15
        tag = np.int64(table) << 24
        home = home15[low]
        for code, rest, own in [(home, high, True), *((others15[low, j], high, False) for j in range(7)), *((home, high ^ (1 << j), False) for j in range(plain))]:
            used = rows if own else np.flatnonzero((code != home) | (rest != high))
            index.append(used)
            keys.append((tag | rest << 15 | code)[used])
            homes.append(np.full(len(used), own))
    return np.concatenate(index), np.concatenate(keys), np.concatenate(homes)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (node, smallest node that it is linked to through these links), without the smallest themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, part, fp, home) sorted by anchor and part: the spanning links that the anchors show."""
    empty = np.zeros(0, np.int64)
    held = [empty, empty, np.zeros(0, bool)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))

    def compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> None:
        nonlocal size
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else empty
        ends = np.r_[starts[1:], len(key)]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        mine = np.flatnonzero(home)
        many = (ends - starts)[group[mine]]
        until = np.cumsum(many)
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + CHUNK, side="right")))
            some, n = mine[at:to], many[at:to]
            left = np.repeat(some, n)
            right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[some]], n)
            a, b = fp[left], fp[right]
            near = np.flatnonzero((a != b) & (np.bitwise_count((a ^ b).view(np.uint64)) <= distance))
            if len(near):
                found.append(forest(a[near], b[near]))
                size += len(found[-1][0])
                if size > 4 * CHUNK:
                    found[:] = [packed()]
                    size = len(found[0][0])
            at = to

    for batch in batches:
        anchor, part, fp, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        key = anchor.astype(np.int64) << 24 | part
        held = [np.concatenate([x, y]) for x, y in zip(held, (key, fp, home), strict=True)]
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if last > CHUNK // 8:
            compare(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    compare(*held)
    if found:
        a, b = packed()
        for at in range(0, len(a), 1 << 16):
            yield pa.record_batch([pa.array(a[at : at + (1 << 16)]), pa.array(b[at : at + (1 << 16)])], ["a", "b"])


def links(distinct: DataFrame, distance: int = 4, hot: int = 8192) -> DataFrame:
    """Spanning links ``a, b`` between the distinct fingerprints ``fp`` that differ in at most ``distance`` <= 5 bits.

    At most five: three blocks share the differing bits, and one of the blocks then has at most one.
    """
    if not 0 <= distance <= 5:
        raise ValueError("the anchors cover distances up to 5")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            for at in range(0, len(fps), 2000):
                some = fps[at : at + 2000]
                index, keys, homes = anchors(some.view(np.uint64))
                yield pa.record_batch([pa.array(keys.astype(np.int32)), pa.array(some[index]), pa.array(homes)], ["anchor", "fp", "home"])

    dealt = distinct.select("fp").mapInArrow(deal, "anchor int, fp long, home boolean")
    homes = distinct.select("fp").mapInArrow(deal, "anchor int, fp long, home boolean").filter("home")
    crowded = cut(homes.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor", F.ceil(F.col("n") / hot).cast("int").alias("parts")), "anchors")
    if (n := crowded.count()) == 0:
        rows = dealt.select("anchor", F.lit(0).alias("part"), "fp", "home")
    else:
        # a home stays in one part, a resident goes to all of them; as a resident the home goes too
        side = F.broadcast(crowded) if n <= 100_000 else crowded
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        rows = dealt.join(side, "anchor", "left").select("anchor", "fp", F.col("home"), F.coalesce("parts", F.lit(1)).alias("parts"))
        rows = rows.select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "fp", "home", "parts").select("anchor", "part", "fp", (F.col("home") & (F.col("part") == own)).alias("home"))
    spread = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return spread.mapInArrow(lambda batches: _links(batches, distance), "a long, b long")


#: Links that one task joins by itself: some MB.
LOCAL = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v) of a whole graph to rows (node, root)."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = top(root.setdefault(u, u)), top(root.setdefault(v, v))
            if a != c:
                root[max(a, c)] = min(a, c)
    yield pa.record_batch([pa.array(list(root), pa.int64()), pa.array([top(x) for x in root], pa.int64())], ["node", "root"])


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``: the root is the component's smallest node.

    Alternating stars settle within a logarithmic number of rounds. What a node's neighbours are told is a written table,
    so that an adaptive skew join can deal out a node of very many links. As soon as ``local`` links at most are left, one
    task joins them, which gives the same and spares the rounds.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if mark == seen or mark[0] == 0:
            break
        if mark[0] <= local:
            return now.coalesce(1).mapInArrow(_joined, "node long, root long")
        seen = mark
        both = now.union(now.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        new = cut(star, "edges")
        drop(now)
        drop(low)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, hot: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the component's smallest doc_id that is not null.

    Null and empty texts, and those of white space only, have fingerprint zero and are linked like any other. Equal rows
    give equal rows. A row without doc_id takes part in its component but never names it. An empty table gives no rows.
    Columns other than the two named ones are not read.
    """
    fps = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, distance, hot))
    named = cut(roots.join(nodes, roots["node"] == nodes["fp"]).select("node", "root", "first"), "named")
    least = cut(named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "least")
    linked = heavy_join(named, least, "root").select(F.col("node").alias("fp"), "component_id")
    own = cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "components")
    for t in (nodes, named, least):
        drop(t)
    return heavy_join(fps, own, "fp").select("doc_id", "fp", "component_id")
