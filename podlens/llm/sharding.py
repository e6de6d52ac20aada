"""Op 4: shards of even size by balanced label propagation, in DataFrame operations only.

Documents are linked through groups (here: equal texts). A shard is a label. In each round every group
counts its members by shard, every linked document looks for the shard where most of its group is, and
moves there as far as the quota of that shard allows. A shard's quota is its equal part of all bytes,
less what linked documents in it take. Documents without links then fill every shard up to the same
number of bytes. A group larger than a shard spreads over as few shards as can hold it. All linked documents
start with labels drawn one by one and take part in the rounds. A smaller group that full shards kept
apart is moved as a whole when the rounds end, so that none of its links is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podlens.llm.tables import prepare, store

SHARDS = 8
# A shard with less than this part of its quota left is full: no group gathers there any more.
LEAST_ROOM = 0.01
# Documents of a shard are ordered in so many parts, which are summed or counted before any is sorted.
PARTS = 4096


def _part(draw: str) -> Column:
    return F.pmod(F.shiftright(draw, 20), F.lit(PARTS))


def running_parts(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """For every part of each ``key`` what the parts before it sum to: one row for each part."""
    parts = rows.groupBy(key, "part").agg(F.sum(value).alias("in_part"))
    ahead = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)))


def with_running(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """``rows`` with ``before``: what comes before each row of its ``key`` in the order of part, draw, row.

    Keys are shards, so the sums by part, which are broadcast, have at most PARTS rows for each shard.
    """
    parts = F.broadcast(running_parts(rows, key, value).drop("in_part"))
    order = Window.partitionBy(key, "part").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(value).over(order), F.lit(0))
    rows = rows.withColumn("inner", inner).join(parts, [key, "part"])
    return rows.withColumn("before", F.col("before") + F.col("inner")).drop("inner")


def propagate(members: DataFrame, quota: int, shards: int = SHARDS) -> DataFrame:
    """Shards of linked documents: ``members`` has row, draw, part, size and group.

    No move brings a shard above ``quota`` bytes. Rounds go on until nothing moves, or until groups no
    longer gather: the sum of the squares of what each group has in a shard must rise, and cannot for ever.
    """
    spark = members.sparkSession
    home = F.pmod(F.xxhash64("group"), F.lit(shards)).cast("int")
    start = F.pmod(F.xxhash64(F.lit("start"), "draw"), F.lit(shards)).cast("int")
    state = store(members.withColumns({"shard": start, "home": home}), "labels")
    every = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    gathered = -1.0
    while True:
        loads = state.groupBy("shard").agg(F.sum("size").alias("load"))
        # As many rows as shards.
        left = F.lit(quota) - F.coalesce("load", F.lit(0))
        room = F.broadcast(every.join(loads, "shard", "left").select("shard", left.alias("room")))
        votes = state.groupBy("group", "shard", "home").agg(F.sum("size").alias("there"))
        votes = store(votes, "votes")
        together = votes.agg(F.sum(F.col("there").cast("double") * F.col("there"))).first()[0] or 0.0
        if together <= gathered:
            break
        gathered = together
        votes = votes.join(room, "shard")
        # Most bytes first; of equals the group's home, then the smaller shard. A group has a row for each shard.
        rank = F.struct("there", (F.col("shard") == F.col("home")).alias("at_home"), (-F.col("shard")).alias("other"))
        open_rank = F.when(F.col("room") > quota * LEAST_ROOM, rank)
        best = F.max(open_rank).over(Window.partitionBy("group"))
        votes = votes.withColumns({"rank": rank, "best": best})
        wish = F.when(F.col("best") > F.col("rank"), -F.col("best.other")).otherwise(F.col("shard"))
        wishes = state.join(votes.select("group", "shard", wish.alias("wish")), ["group", "shard"])
        wishes = store(wishes, "wishes")
        moving = wishes.filter("wish != shard")
        parts = running_parts(moving, "wish", F.col("size")).join(room.withColumnRenamed("shard", "wish"), "wish")
        # Whole parts of the movers are admitted while they fit: at most PARTS rows for each shard.
        admitted = parts.filter("before + in_part <= room").select("wish", "part", F.lit(True).alias("admitted"))
        moved = wishes.join(F.broadcast(admitted), ["wish", "part"], "left")
        go = F.coalesce("admitted", F.lit(False)) & (F.col("wish") != F.col("shard"))
        new = F.when(go, F.col("wish")).otherwise(F.col("shard"))
        moved = store(moved.select(*members.columns, new.alias("shard"), "home", go.alias("moved")), "labels")
        state = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            break
    return state.drop("home")


def fill_by_size(rows: DataFrame, placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """As ``fill``, large rows first, so that the small ones even out what those leave."""
    typical = rows.agg(F.avg("size")).first()[0] or 0
    large, small = rows.filter(F.col("size") > typical), rows.filter(F.col("size") <= typical)
    first = store(fill(large, placed, shards), "large")
    return first.unionByName(fill(small, placed.select("shard", "size").unionByName(first.select("shard", "size")), shards))


def fill(loose: DataFrame, placed: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards for documents without links, so that every shard ends near the same number of bytes.

    They stand in one order; each shard takes the stretch that fills what its placed documents leave.
    """
    loads = {row["shard"]: row["load"] for row in placed.groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    total = (loose.agg(F.sum("size")).first()[0] or 0) + sum(loads.values())
    end, chosen = 0.0, F.lit(shards - 1)
    bounds = []
    for shard in range(shards):
        end += max(total / shards - loads.get(shard, 0), 0.0)
        bounds.append((end, shard))
    ordered = with_running(loose.withColumn("all", F.lit(0)), "all", F.col("size"))
    middle = F.col("before") + F.col("size") / 2
    # The last shard takes what rounding leaves.
    for end, shard in reversed(bounds):
        chosen = F.when(middle < end, shard).otherwise(chosen)
    return ordered.withColumn("shard", chosen).select(*loose.columns, "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of all documents.

    The law is ``bytes``: shards have near equal bytes (UTF-8 of the text, and 1 for each document).
    ``slot`` numbers the documents of a shard from 0. A null text has the size 1, the checksum of the
    empty text, and no links; empty texts are linked like all equal texts. Rows that repeat are linked
    by their texts. An empty table gives no rows. Columns but ``doc_id`` and ``text`` are not read.
    """
    prepare(docs.sparkSession)
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(raw)).alias("group"),
    )
    rows = rows.withColumn("draw", F.xxhash64(F.lit("draw"), "doc_id", "group"))
    rows = store(rows.withColumn("part", _part("draw")), "digests")
    total = rows.agg(F.sum("size")).first()[0] or 0
    quota = total // shards
    counts = rows.filter("group is not null").groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    shared = store(counts.filter("n > 1").select("group", (F.col("bytes") <= quota).alias("fits"), "bytes"), "groups")
    members = store(rows.join(shared.select("group", "fits"), "group", "left"), "members")
    loose = members.filter("fits is null").drop("fits")
    linked = store(propagate(members.filter("fits is not null").drop("fits"), quota, shards), "propagated")
    # A group that fits in a shard but was stopped on its way by a full one is placed whole, as one row.
    torn = linked.groupBy("group").agg(F.count_distinct("shard").alias("shards")).filter("shards > 1")
    torn = store(torn.join(shared.filter("fits"), "group").select("group", "bytes"), "torn")
    settled = store(linked.join(torn, "group", "left_anti"), "settled")
    draw = F.xxhash64(F.lit("draw"), "group")
    nodes = torn.select("group", F.col("bytes").alias("size"), draw.alias("draw"), draw.alias("row"))
    nodes = store(fill_by_size(nodes.withColumn("part", _part("draw")), settled, shards), "nodes")
    gathered = linked.drop("shard").join(nodes.select("group", "shard"), "group")
    labelled = store(settled.unionByName(gathered.select(*settled.columns)), "labelled")
    placed = store(labelled.unionByName(fill_by_size(loose, labelled, shards).select(*labelled.columns)), "shards")
    slots = with_running(placed, "shard", F.lit(1))
    return slots.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("before").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
