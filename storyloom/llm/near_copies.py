"""Near copies by the exact Jaccard similarity of word shingles, over the links of SimHash anchors and wider keys.

Two texts are linked if their sets of five-word shingles have a similarity of at least ``limit`` (0.8); linked documents
form components. Texts of equal sets are one node.

Candidate search. The anchors of :mod:`simhash_dedup` link all fingerprints of at most four different bits. A similarity of
0.8 leaves about ten of 64 bits different, farther than a covering code of 64 bits can reach. So each set also has ``BANDS``
keys of ``ROWS`` minimum hashes, and sets that share a key are candidates: at 0.8 a pair shares none with a chance of 3 in
100,000, and less above. Candidates are told as a star per key, never as all pairs, and the stars' components are formed.

Check. The sets of a candidate component go to one task, where any two members that are not yet joined are compared; only
true links leave it, as a spanning forest. A component of over ``group`` members or ``SHINGLES`` shingles is dealt to parts
of that size. Then one member of each part's components meets those of the other parts, which joins what most copies are
like. What is still apart from the component's largest set of joined members is compared, in blocks, with all the others.
So nothing is lost, and the work grows with the members times those few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .simhash_dedup import components, fingerprint_of_hashes, links
from .store import cut, drop, heavy_join

BANDS, ROWS = 20, 4
#: Rows that are broadcast at most: some 20 MB as a hash table.
SMALL = 200_000
#: Members and shingles (8 bytes each) that a task compares at once; members of a block of those that are still apart.
GROUP, SHINGLES, BLOCK = 500, 1 << 20, 128
_RNG = np.random.default_rng(42)
_MASK = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_FACTOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(text: bytes | None, width: int = 5) -> np.ndarray:
    """Hashes of the shingles of one UTF-8 text, repeats included; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1) if words else 0
    return np.fromiter((digest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n)


def shingles(text: bytes | None, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes of one UTF-8 text, in order."""
    return np.unique(shingle_hashes(text, width))


def node_of(found: np.ndarray) -> int:
    """The number of a set, as a signed long."""
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 42), np.uint64).view(np.int64))


def bands(found: np.ndarray) -> list[int]:
    """Keys of a set; none of the empty set, which is like itself alone."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        least = np.minimum(least, ((found[at : at + 512, None] ^ _MASK) * _FACTOR).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def alike(a: np.ndarray, b: np.ndarray, limit: float) -> bool:
    """Whether two ordered sets have a Jaccard similarity of ``limit`` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < limit * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= limit * (len(a) + len(b) - both)


def forest(rows: list[tuple[bool, int, int, np.ndarray]], limit: float) -> list[tuple[int, int]]:
    """Links that span the components of rows (asks, label, node, set).

    Those of equal label are joined already. One that asks is compared with all that it isn't joined with yet; one that
    doesn't ask, with those that ask only.
    """
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    own = {}  # the part that a label is in
    out = []
    for asks, label, node, found in sorted(rows, key=lambda r: r[0]):
        mine = own.setdefault(label, label)
        if asks:
            for key in [k for k in parts if k != mine]:
                m = next((m for m, other in parts[key] if alike(found, other, limit)), None)
                if m is not None:
                    out.append((node, m))
                    parts.setdefault(mine, []).extend(parts.pop(key))
                    own = {a: mine if k == key else k for a, k in own.items()}
        parts.setdefault(mine, []).append((node, found))
    return out


def _sketches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = [shingle_hashes(t.as_py(), width) for t in b.column(2)]
        sets = [np.unique(h) for h in hashes]
        fps = np.fromiter((fingerprint_of_hashes(h) for h in hashes), np.uint64, len(hashes)).view(np.int64)
        columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.record_batch([b.column(0), b.column(1), *columns], ["doc_id", "h", "node", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (root, parts, node, text) to rows (root, parts, node, the set)."""
    for b in batches:
        yield pa.record_batch([*b.columns[:3], pa.array([shingles(t.as_py(), width).tobytes() for t in b.column(3)], pa.binary())], ["root", "parts", "node", "found"])


def _compared(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Rows (root, block, chunk, asks, label, node, set), sorted by the first three: the links of each of their groups."""
    at, group = None, []

    def done() -> pa.RecordBatch:
        pairs = forest(group, limit)
        return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for b in batches:
        for root, block, chunk, asks, label, node, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (root, block, chunk) != at:
                yield done()
                at, group = (root, block, chunk), []
            group.append((asks, label, node, np.frombuffer(found, np.uint64)))
    yield done()


def compared(rows: DataFrame, limit: float) -> DataFrame:
    """Links ``a, b`` within the groups (root, block, chunk) of rows (root, block, chunk, asks, label, node, found)."""
    columns = ["root", "block", "chunk", "asks", "label", "node", "found"]
    return rows.select(columns).repartition("root", "block", "chunk").sortWithinPartitions("root", "block", "chunk").mapInArrow(lambda b: _compared(b, limit), "a long, b long")


def _deal(n: Column) -> Column:
    return F.pmod(F.xxhash64("node"), n).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _candidates(nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that span whatever may be alike: a star per key, and the anchors' links of fingerprints."""
    keys = nodes.select("node", F.explode("bands").alias("band"))
    shared = cut(keys.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("band", "low"), "bands")
    stars = keys.join(_small(shared), "band").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    worded = nodes.filter("size > 0")
    first = cut(worded.groupBy("fp").agg(F.min("node").alias("low")), "fingerprints")
    same = worded.join(first, "fp").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    near = links(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    return stars.union(same).union(near.select("x", "y")).distinct()


def _spanning(sets: DataFrame, limit: float, group: int, block: int, shingles: int = SHINGLES) -> DataFrame:
    """All links ``a, b`` (spanning) within the candidate components of ``sets`` (root, parts, node, found)."""
    alone = sets.withColumns({"block": _deal(F.col("parts")), "chunk": F.lit(0), "asks": F.lit(True), "label": F.col("node")})
    inner = cut(compared(alone, limit), "links")
    large = sets.filter("parts > 1")
    if large.limit(1).count() == 0:
        return inner

    def labelled(edges: DataFrame) -> DataFrame:
        named = components(edges).withColumnRenamed("root", "_l")
        return large.join(named, "node", "left").select("root", "node", "found", (F.octet_length("found") / 8).alias("_size"), F.coalesce("_l", "node").alias("label"))

    heads = cut(labelled(inner).filter("label = node"), "heads")
    dealt = lambda members, size, most: F.greatest(F.ceil(members / most), F.ceil(size / shingles)).cast("int")
    counts = cut(heads.groupBy("root").agg(dealt(F.count("*"), F.sum("_size"), group).alias("n")), "counts")
    met = heads.join(_small(counts), "root").withColumns({"block": _deal(F.col("n")), "chunk": F.lit(0), "asks": F.lit(True)})
    inner = cut(inner.union(compared(met, limit)), "links")
    now = cut(labelled(inner), "labelled")
    sizes = now.groupBy("root", "label").agg(F.count("*").alias("n"), F.sum("_size").alias("size"))
    told = sizes.groupBy("root").agg(F.max(F.struct("n", "label", "size")).alias("top"), F.sum("n").alias("all"), F.sum("size").alias("size"))
    blocks = dealt(F.col("all") - F.col("top.n"), F.col("size") - F.col("top.size"), block)
    apart = cut(told.filter("all > top.n").select("root", F.col("top.label").alias("largest"), blocks.alias("blocks"), dealt(F.col("all"), F.col("size"), group).alias("chunks")), "apart")
    if apart.limit(1).count() == 0:
        return inner
    members = now.join(_small(apart), "root").withColumn("asks", F.col("label") != F.col("largest"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = members.filter("asks").withColumns({"block": _deal(F.col("blocks")), "chunk": each("chunks")})
    others = members.withColumn("chunk", _deal(F.col("chunks"))).withColumn("block", each("blocks"))
    others = others.filter(~(F.col("asks") & (F.col("block") == _deal(F.col("blocks"))))).withColumn("asks", F.lit(False))
    return inner.union(compared(asking.unionByName(others), limit))


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def keep_first(docs: DataFrame, width: int = 5, limit: float = 0.8, group: int = GROUP, block: int = BLOCK, shingles: int = SHINGLES) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest doc_id, null being the last.

    Null and empty texts, and those without words, are alike. Of rows without doc_id, and of rows that share one, the text's
    hash decides, and of equal rows any one stays. An empty table gives no rows. Other columns are carried along; only
    ``doc_id`` and ``text`` are read.
    """
    h = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), F.col("text").cast("binary").alias("text"))
    seen = cut(rows.mapInArrow(lambda b: _sketches(b, width), "doc_id long, h long, node long, size long, fp long, bands array<long>"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_no"), F.col("doc_id"), F.col("h")))
    nodes = cut(seen.groupBy("node").agg(first.alias("first"), F.count("*").alias("n"), F.any_value("size").alias("size"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "nodes")
    asked = cut(components(_candidates(nodes)).join(nodes.select("node", "first", "size"), "node"), "asked")
    parts = F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("size") / shingles)).cast("int")
    many = cut(asked.groupBy("root").agg(parts.alias("parts")).filter("parts > 1"), "many")
    named = asked.join(_small(many), "root", "left").select("root", F.coalesce("parts", F.lit(1)).alias("parts"), "node", F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    texts = rows.join(_small(cut(named, "named")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("root", "parts", "node", "text").dropDuplicates(["node"])
    sets = cut(texts.mapInArrow(lambda b: _sets(b, width), "root long, parts int, node long, found binary"), "sets")
    linked = cut(components(_spanning(sets, limit, group, block, shingles)).join(nodes.select("node", "first"), "node"), "components")
    least = cut(linked.groupBy("root").agg(F.min("first").alias("kept"), F.count("*").alias("n")), "least")
    told = heavy_join(linked.select("root", "node"), least, "root")
    own = cut(nodes.join(told.select("node", "kept"), "node", "left").filter("n > 1 or kept is not null").select("node", "n", F.coalesce("kept", "first").alias("kept")), "kept")
    copies = heavy_join(seen.select("doc_id", "h", "node"), own, "node")
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("h") == F.col("kept.h"))
    judged = cut(copies.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.any_value(same).alias("stays"), F.count("*").alias("times")).filter("not stays or times > 1"), "judged")
    for t in (nodes, asked, sets, linked, least, own):
        drop(t)
    keyed = docs.select(F.struct(*[_named(c) for c in docs.columns]).alias("_row"), h.alias("_h"), F.col("doc_id").cast("long").alias("_id"))
    on = lambda side: keyed["_id"].eqNullSafe(side["_id"]) & (keyed["_h"] == side["_h"])
    gone = _small(judged.select("_id", "_h"))
    left = keyed.join(gone, on(gone), "left_anti").select("_row.*")
    repeated = judged.filter("stays")
    if repeated.limit(1).count() == 0:
        return left
    some = _small(repeated.select("_id", "_h"))
    once = keyed.join(some, on(some), "left_semi").dropDuplicates(["_id", "_h"]).select("_row.*")
    return left.unionByName(once)
