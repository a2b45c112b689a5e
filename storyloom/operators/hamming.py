"""Pairs of 64-bit hashes within a distance, without ever comparing all the hashes of a crowded key in one task.

With distance + 2 blocks of bits, two such hashes agree in at least two of them: there is a table for each choice of two
blocks, whose key is their bits (26 at distance 3). A key with more than ``CROWD`` pairs to compare is split once more:
the bits outside the key are cut into distance + 1 parts, and near hashes agree in one of them, which makes keys of some
36 bits. What is crowded even then is dealt to square chunks of at most ``CHUNK`` by ``CHUNK`` hashes, each a key of its
own. A pair is taken from the first table and the first part that have it, so none comes twice.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.hashing import hamming
from storyloom.sources.shared import cut

#: Pairs that a key compares before it is split, and hashes on each side of a chunk.
CROWD, CHUNK = 1 << 22, 1 << 14
#: Rows that are broadcast at most, by count.
SMALL = 200_000


def blocks_of(n: int) -> list[tuple[int, int]]:
    """64 bits in n blocks: where each starts, and how wide it is."""
    size, more = divmod(64, n)
    out, at = [], 0
    for i in range(n):
        width = size + (i < more)
        out.append((at, width))
        at += width
    return out


def _bits(h: Column, block: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(h, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))


def _joined(h: Column, blocks: list[tuple[int, int]]) -> Column:
    """The blocks' bits beside each other."""
    out = F.lit(0).cast("long")
    for b in blocks:
        out = F.shiftleft(out, b[1]).bitwiseOR(_bits(h, b))
    return out


class Tables:
    """The tables for a distance, and the keys of a hash in them."""

    def __init__(self, distance: int) -> None:
        self.distance = distance
        self.blocks = blocks_of(distance + 2)
        self.choices = list(combinations(range(len(self.blocks)), 2))
        self.parts = distance + 1
        widest = 64 - min(sum(self.blocks[k][1] for k in c) for c in self.choices)
        self.part = -(-widest // self.parts)  # bits of a part outside the key

    def keyed(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """A row per table: the columns, ``h, t, key`` and the ``rest`` of the bits."""
        h = F.col("h")

        def table(t: int, choice: tuple[int, ...]) -> Column:
            rest = [b for k, b in enumerate(self.blocks) if k not in choice]
            own = _joined(h, [self.blocks[k] for k in choice])
            return F.struct(F.lit(t).alias("t"), (own + F.lit(t << 40)).alias("key"), _joined(h, rest).alias("rest"))

        return df.select("h", *columns, F.explode(F.array(*[table(t, c) for t, c in enumerate(self.choices)])).alias("_e")).select("h", *columns, "_e.*")

    def split(self, keyed: DataFrame) -> DataFrame:
        """A row per part of the rest, which goes into the key: ``s`` is the part."""
        bits = [F.struct(F.lit(s).alias("s"), F.shiftrightunsigned("rest", s * self.part).bitwiseAND(F.lit((1 << self.part) - 1)).alias("bits")) for s in range(self.parts)]
        out = keyed.withColumn("_p", F.explode(F.array(*bits)))
        key = F.struct(F.col("key").alias("k"), F.col("_p.s").alias("s"), F.col("_p.bits").alias("bits"))
        return out.withColumns({"s": F.col("_p.s"), "key": key}).drop("_p")

    def first_table(self, a: Column, b: Column) -> Column:
        """The first table in which two hashes share a key."""
        same = [_bits(a.bitwiseXOR(b), x) == 0 for x in self.blocks]
        out = F.lit(-1)
        for t, (p, q) in reversed(list(enumerate(self.choices))):
            out = F.when(same[p] & same[q], t).otherwise(out)
        return out

    def first_part(self, a: Column, b: Column) -> Column:
        """The first part in which two rests are equal."""
        out = F.lit(-1)
        for s in reversed(range(self.parts)):
            out = F.when(F.shiftrightunsigned(a.bitwiseXOR(b), s * self.part).bitwiseAND(F.lit((1 << self.part) - 1)) == 0, s).otherwise(out)
        return out


def _crowded(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """``key, l, r`` of the keys whose sides make more than that many pairs."""
    each = left.select("key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("key", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return cut(each.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).filter(F.col("l") * F.col("r") > most), "crowded")


def _meet(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the written ``keys``, which are broadcast where they are few; else the fullest are."""
    if keys.count() <= SMALL:
        return rows.join(F.broadcast(keys), "key", how)
    order = keys.orderBy(F.desc(F.col("l") + F.col("r")), "key").limit(SMALL)
    top = cut(order, "fullest")
    rest = keys.join(F.broadcast(top.select("key")), "key", "left_anti")
    if how == "left_anti":
        return rows.join(F.broadcast(top.select("key")), "key", "left_anti").join(rest, "key", "left_anti")
    light = rows.join(F.broadcast(top.select("key")), "key", "left_anti").join(rest, "key")
    return rows.join(F.broadcast(top), "key").unionByName(light)


def pairs(left: DataFrame, right: DataFrame, distance: int = 3, same: bool = False, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """``a, b`` and the other columns of both sides (none in common) for rows (h, ...) whose hashes are within the distance.

    Each side has distinct hashes, without nulls. With ``same`` both sides are one set, and each pair comes once, a below b.
    """
    tables = Tables(distance)
    more_l, more_r = ([c for c in df.columns if c != "h"] for df in (left, right))
    l1, r1 = tables.keyed(left, more_l), tables.keyed(right, more_r)
    a, b = F.col("a"), F.col("b")
    near = hamming(a, b) <= distance
    if same:
        near = (a < b) & near

    def sides(x: DataFrame, y: DataFrame, extra: list[str]) -> tuple[DataFrame, DataFrame]:
        return x.select(F.col("h").alias("a"), "key", *extra, "t", F.col("rest").alias("rest_a"), *more_l), y.select(F.col("h").alias("b"), "key", *extra, F.col("rest").alias("rest_b"), *more_r)

    def plain(x: DataFrame, y: DataFrame) -> DataFrame:
        p, q = sides(x, y, [])
        return p.join(q, "key").filter(near & (F.col("t") == tables.first_table(a, b))).select("a", "b", *more_l, *more_r)

    n = left.count()
    if n * (n if same else right.count()) <= crowd:
        return plain(l1, r1)  # no key can be crowded
    full = _crowded(l1, r1, crowd)
    if full.limit(1).count() == 0:
        return plain(l1, r1)
    out = plain(_meet(l1, full, "left_anti"), _meet(r1, full, "left_anti"))
    l2, r2 = (cut(tables.split(_meet(x, full, "inner").drop("l", "r")), "split") for x in (l1, r1))
    fuller = _crowded(l2, r2, chunk * chunk)
    first = (F.col("t") == tables.first_table(a, b)) & (F.col("s") == tables.first_part(F.col("rest_a"), F.col("rest_b")))

    def parted(x: DataFrame, y: DataFrame, extra: list[str]) -> DataFrame:
        p, q = sides(x, y, extra)
        return p.withColumn("s", F.col("key.s")).join(q, ["key", *extra]).filter(near & first).select("a", "b", *more_l, *more_r)

    if fuller.limit(1).count() == 0:
        return out.unionByName(parted(l2, r2, []))
    out = out.unionByName(parted(_meet(l2, fuller, "left_anti"), _meet(r2, fuller, "left_anti"), []))
    parts = {"i": F.ceil(F.col("l") / chunk).cast("int"), "j": F.ceil(F.col("r") / chunk).cast("int")}
    deal = lambda n: F.pmod(F.xxhash64("h", F.lit(7)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l3 = _meet(l2, fuller, "inner").withColumn("i", deal(parts["i"])).withColumn("j", each(parts["j"])).drop("l", "r")
    r3 = _meet(r2, fuller, "inner").withColumn("j", deal(parts["j"])).withColumn("i", each(parts["i"])).drop("l", "r")
    return out.unionByName(parted(l3, r3, ["i", "j"]))
