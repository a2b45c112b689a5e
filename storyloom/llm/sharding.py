"""Shards by balanced label propagation, under the law ``rows``: shard counts differ by at most one. Catalyst only.

Linked are the documents of equal text. A document's neighbours are the others of its text, so that its links need no
edge table: its group stands for them, and what a group has in each shard is one small aggregate. All start in shards of
equal size by a hash of the row. In each round linked documents move towards the shard that holds most of their group,
the greatest gains first and within the quotas: for each document that comes, one without links goes to where it came
from; where no such documents are left, moves between two shards are accepted in equal numbers both ways. So the counts
never change. A group that fills a shard goes on with the fullest one that has room. The rounds end when nobody moves.

Scale. Only digests leave the scan. Documents without links take part only when they are displaced; the rounds shuffle
linked rows alone. A huge group is counted per (group, shard) by partial aggregation. Ranks within a shard come from
counts per small bucket plus ranks within the bucket, never from one task's sort of all rows. The driver sees counts per
shard only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import cut


def ranked(df: DataFrame, groups: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add a gapless rank from 0 within ``groups``, in the order of ``bucket`` first: a row per (group, bucket) is summed up."""
    dealt = df.withColumn("_b", bucket)
    sizes = dealt.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*groups, "_b", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order))
    inner = dealt.withColumn("_own", own)
    return inner.join(starts, [*groups, "_b"]).withColumn(name, F.col("_start") + F.col("_own") - 1).drop("_b", "_own", "_start")


def _spread(n: int) -> Column:
    """One of n buckets by a hash of the row's digest and id."""
    return F.pmod(F.xxhash64("h", "doc_id", "copy"), F.lit(n)).cast("int")


def assign(docs: DataFrame, shards: int = 24, rounds: int = 20, buckets: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, links, kept_links`` of every row.

    ``size`` is the text's UTF-8 bytes plus 8; ``slot`` counts from 0 without gaps in each shard; ``links`` is the number
    of other rows with the same text and ``kept_links`` of those in the same shard. A null text is like an empty one.
    Equal rows and rows without doc_id are placed each for itself; an empty table gives no rows; other columns are not
    read. Fewer rows than shards leave shards empty.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    digest = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.crc32(text)).alias("h"))
    rows = cut(digest.withColumn("copy", F.monotonically_increasing_id()), "digests")
    total = rows.count()
    order = [F.col("h"), F.col("doc_id"), F.col("copy")]
    place = _global_rank(rows, order)
    low, more = divmod(total, shards)
    cutoff = more * (low + 1)
    shard = F.when(F.col("at") < cutoff, F.floor(F.col("at") / (low + 1))).otherwise(more + F.floor((F.col("at") - cutoff) / max(low, 1)))
    now = cut(place.select("doc_id", "size", "text_crc32", "h", "copy", shard.cast("int").alias("shard")), "shards")
    sizes = rows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    linked = cut(now.join(sizes, "h", "left_semi").select("h", "doc_id", "copy", "shard"), "linked")
    alone = cut(ranked(now.join(linked, "copy", "left_anti").select("h", "doc_id", "copy", "shard"), ["shard"], order, _spread(buckets), "rank").select("copy", "shard", "rank"), "alone")
    room = _sizes(alone)
    used = dict.fromkeys(range(shards), 0)
    displaced: list[DataFrame] = []
    for _ in range(rounds):
        free = {s: room.get(s, 0) - used[s] for s in range(shards) if room.get(s, 0) > used[s]}
        moves = cut(_into_room(linked, free, buckets), "moves")
        came = {r["to"]: r["n"] for r in moves.groupBy("to").agg(F.count("*").alias("n")).collect()}
        if came:
            first = _table(used)
            left = moves.select(F.col("to").alias("shard"), (F.col("rank") + F.element_at(first, F.col("to"))).alias("rank"), F.col("shard").alias("new"))
            displaced.append(cut(alone.join(left, ["shard", "rank"]).select("copy", "new"), "displaced"))
            for s, n in came.items():
                used[s] += n
        elif displaced:
            # those that gave way may do so again from where they are now
            alone, displaced = cut(ranked(_placed(alone, displaced), ["shard"], [F.col("copy")], F.pmod(F.xxhash64("copy"), F.lit(buckets)).cast("int"), "rank"), "alone"), []
            room, used = _sizes(alone), dict.fromkeys(range(shards), 0)
            continue
        else:
            moves = cut(_exchanged(_moves(linked, None), buckets), "moves")
            if moves.limit(1).count() == 0:
                break
        linked = cut(linked.join(moves.select("copy", "to"), "copy", "left").select("h", "doc_id", "copy", F.coalesce("to", "shard").alias("shard")), "linked")
    held = linked.groupBy("h", "shard").agg(F.count("*").alias("here"))
    counts = linked.groupBy("h").agg(F.count("*").alias("all"))
    known = linked.join(held, ["h", "shard"]).join(counts, "h").select("copy", F.col("shard").alias("to"), "here", "all")
    known = known.unionByName(_placed(alone, displaced).select("copy", F.col("shard").alias("to")), allowMissingColumns=True)
    done = now.join(known, "copy", "left").select(
        "doc_id", "size", "text_crc32", "h", "copy", F.coalesce("to", "shard").alias("shard"), F.coalesce(F.col("all") - 1, F.lit(0)).cast("long").alias("links"), F.coalesce(F.col("here") - 1, F.lit(0)).cast("long").alias("kept_links")
    )
    slots = ranked(cut(done, "placed"), ["shard"], order, _spread(buckets), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "links", "kept_links")


def _sizes(alone: DataFrame) -> dict[int, int]:
    return {r["shard"]: r["n"] for r in alone.groupBy("shard").agg(F.count("*").alias("n")).collect()}


def _placed(alone: DataFrame, displaced: list[DataFrame]) -> DataFrame:
    """``copy, shard`` of the documents without links, where they are now. None is displaced twice between two calls."""
    if not displaced:
        return alone.select("copy", "shard")
    moved = displaced[0]
    for d in displaced[1:]:
        moved = moved.unionByName(d)
    return alone.join(moved, "copy", "left").select("copy", F.coalesce("new", "shard").alias("shard"))


def _global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rank all rows from 0, in the order of 65536 buckets by a hash of the row."""
    dealt = rows.withColumn("_b", _spread(1 << 16))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_n"))
    # a table of 65536 rows at most, summed in one task
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_b", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return dealt.withColumn("_own", own).join(starts, "_b").withColumn("at", F.col("_start") + F.col("_own") - 1).drop("_b", "_own", "_start")


def _table(values: dict[int, int]) -> Column:
    """A literal map with a row for each shard."""
    return F.create_map(*(F.lit(x).cast("int") if i % 2 == 0 else F.lit(x).cast("long") for k, v in values.items() for i, x in enumerate((k, v))))


def _moves(linked: DataFrame, free: list[int] | None) -> DataFrame:
    """``h, doc_id, copy, shard, to, gain`` of every row that has more neighbours in its group's fullest shard (of ``free``)."""
    held = linked.groupBy("h", "shard").agg(F.count("*").alias("here"))
    open_ = held if free is None else held.filter(F.col("shard").isin(free))
    # of equal shards a hash picks one, lest all groups want the same
    best = open_.groupBy("h").agg(F.max(F.struct("here", F.xxhash64("h", "shard"), "shard")).alias("best")).select("h", F.col("best.here").alias("most"), F.col("best.shard").alias("to"))
    split = held.join(best, "h").filter((F.col("shard") != F.col("to")) & (F.col("here") <= F.col("most"))).select("h", "shard", "to", (F.col("most") - F.col("here") + 1).alias("gain"))
    return linked.join(split, ["h", "shard"]).select("h", "doc_id", "copy", "shard", "to", "gain")


def _by_gain(wanted: DataFrame, groups: list[str], buckets: int) -> DataFrame:
    """Rank within the groups, the greatest gains first. Buckets are levels of the gain, dealt by a hash."""
    level = F.least(F.floor(F.log2(F.col("gain").cast("double"))), F.lit(40)).cast("int")
    return ranked(wanted, groups, [F.desc("gain"), F.col("h"), F.col("doc_id"), F.col("copy")], (40 - level) * buckets + _spread(buckets), "rank")


def _into_room(linked: DataFrame, free: dict[int, int], buckets: int) -> DataFrame:
    """``copy, shard, to, rank``: the moves that documents without links can make room for."""
    wanted = _moves(linked, sorted(free))
    if not free:
        return wanted.select("copy", "shard", "to", F.lit(0).cast("long").alias("rank")).limit(0)
    return _by_gain(wanted, ["to"], buckets).filter(F.col("rank") < F.element_at(_table(free), F.col("to"))).select("copy", "shard", "to", "rank")


def _exchanged(wanted: DataFrame, buckets: int) -> DataFrame:
    """``copy, to``: as many moves from a to b as from b to a."""
    demand = wanted.groupBy("shard", "to").agg(F.count("*").alias("n"))
    back = demand.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("n").alias("back"))
    quota = demand.join(back, ["shard", "to"]).select("shard", "to", F.least("n", "back").alias("quota"))
    return _by_gain(wanted, ["shard", "to"], buckets).join(quota, ["shard", "to"]).filter(F.col("rank") < F.col("quota")).select("copy", "to")
