"""Even shards by balanced label propagation over links between documents.

Documents are linked through hubs: rows with equal texts share one. A document
starts in the shard that the hash of its row names, apart from its neighbours.
In each round it wants to move to the shard where most members of its hub are.
A hub of more rows than a quota needs several shards: its members want into as
many of its best ones, bounded parts of the group dealt to them by hash, so no
vote sends more than it must to one shard. Between two shards as many rows move
one way as the other way; beyond that a shard takes what its quota leaves room
for. A shard that could take none is left out of later votes. What exceeds a
quota in the end is taken out again, and it and all documents without links
fill the shards up to their quotas, so row counts differ by one at most,
whatever the links are.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccluster.sources.scratch import materialize

log = logging.getLogger(__name__)

SHARDS = 40
ROUNDS = 20
# Between rounds a shard may hold a tenth more than its quota, so that full
# shards can trade in circles; the end takes whole parts out again.
SLACK = 10
# Rows of the largest part of a group, and of a range that one task numbers.
PART_ROWS = 50_000
RANGE_ROWS = 20_000
# Parts fall into so many buckets; a target accepts or refuses a bucket whole.
BUCKETS = 4096


def _bucket(value: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(count)).cast("int")


def _per_shard(values: list[int]) -> Column:
    """The number that belongs to the column ``shard``."""
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("shard") + 1)


def text_links(docs: DataFrame, quota: int) -> DataFrame:
    """``(uid, hub, part)`` of rows that share their ``digest`` with others."""
    most = max(1, min(PART_ROWS, quota // 4))
    groups = (
        docs.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("group"), F.ceil(F.col("n") / most).alias("parts"))
    )
    groups = materialize(groups, "groups")
    part = F.xxhash64("digest", F.pmod(F.xxhash64("uid"), F.col("parts")))
    return docs.join(groups, docs["digest"] == groups["group"]).select(
        "uid", F.xxhash64("digest").alias("hub"), part.alias("part")
    )


def _accepted(wanted: DataFrame, room: list[int]) -> DataFrame:
    """The ``(shard, bucket)`` that fit into each shard's room, in bucket order.

    ``wanted`` has a row per document; its counts are at most one row per shard
    and bucket.
    """
    order = Window.partitionBy("shard").orderBy("bucket")
    return (
        wanted.groupBy("shard", "bucket")
        .agg(F.count("*").alias("n"))
        .withColumn("total", F.sum("n").over(order))
        .filter(F.col("total") <= _per_shard(room))
        .select("shard", "bucket")
    )


def _loads(state: DataFrame, shards: int) -> list[int]:
    loads = [0] * shards
    for row in state.groupBy("shard").count().collect():
        loads[row.shard] = row["count"]
    return loads


def _spots(counts: DataFrame, quota: int) -> DataFrame:
    """``(hub, all, spots)``: rows of each hub and its best shards, as many as its rows need.

    Equal counts are told apart by a hash of hub and shard, so small groups
    spread over all shards.
    """
    rank = F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")
    ranked = counts.groupBy("hub").agg(
        F.sum("n").alias("all"), F.sort_array(F.collect_list(rank), asc=False).alias("ranked")
    )
    needed = F.least(F.size("ranked"), F.ceil(F.col("all") / max(1, quota)).cast("int"))
    return ranked.select("hub", "all", F.slice("ranked", 1, needed).alias("spots"))


def _cut(counts: DataFrame, quota: int) -> int:
    """Links of members to their hub that lead out of the hub's best shards."""
    inside = F.aggregate("spots", F.lit(0).cast("bigint"), lambda total, spot: total + spot["n"])
    apart = _spots(counts, quota).agg(F.sum(F.col("all") - inside).alias("apart"))
    return apart.first().apart or 0


def _wishes(state: DataFrame, counts: DataFrame, closed: set[int], quota: int) -> DataFrame:
    """``(uid, part, source, shard)`` of documents that want to move to ``shard``."""
    open_counts = counts.filter(~F.col("shard").isin(list(closed))) if closed else counts
    spots = _spots(open_counts, quota).select("hub", "spots")
    own = counts.select("hub", "shard", F.col("n").alias("here"))
    spot = F.element_at("spots", (F.pmod(F.xxhash64("part"), F.size("spots")) + 1).cast("int"))
    mine = F.struct("here", F.xxhash64("hub", "shard").alias("tie"), "shard")
    return (
        state.join(spots, "hub")
        .join(own, ["hub", "shard"])
        .select("uid", "part", F.col("shard").alias("source"), spot.alias("best"), mine.alias("own"))
        .filter("best > own")
        .select("uid", "part", "source", F.col("best.shard").alias("shard"))
    )


def _allowance(flows: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Rows that may move from one shard to another: exchanges, then what room is left for."""
    room, allowed = list(room), {}
    for (source, target), asked in sorted(flows.items()):
        exchanged = min(asked, flows.get((target, source), 0))
        more = min(asked - exchanged, room[target])
        room[target] -= more
        allowed[source, target] = exchanged + more
    return allowed


def _moves(wishes: DataFrame, flows: dict[tuple[int, int], int], allowed: dict[tuple[int, int], int]) -> DataFrame:
    """``(moved, target)``: as many wishes as allowed, rows of one part one after the other."""
    if flows != allowed:
        ranges = max(1, -(-max(flows.values()) // RANGE_ROWS))
        # one row per pair of shards
        limits = wishes.sparkSession.createDataFrame(
            [(s, t, n) for (s, t), n in allowed.items()], "source int, shard int, allowed bigint"
        )
        queued = _numbered(wishes, ["source", "shard"], ["part", "uid"], ranges, "position")
        wishes = queued.join(F.broadcast(limits), ["source", "shard"]).filter("position < allowed")
    return wishes.select(F.col("uid").alias("moved"), F.col("shard").alias("target"))


def propagate(links: DataFrame, quotas: list[int]) -> tuple[DataFrame, list[int]]:
    """``(uid, part, hub, shard)`` after the rounds, and the cut links before each of them."""
    shards, quota = len(quotas), max(quotas)
    state = materialize(
        links.select("uid", "part", "hub", _bucket(F.col("uid"), shards).alias("shard")), "state"
    )
    loads, closed, cuts = _loads(state, shards), set(), []
    for _ in range(ROUNDS):
        counts = materialize(state.groupBy("hub", "shard").agg(F.count("*").alias("n")), "votes")
        cuts.append(_cut(counts, quota))
        # two rounds without a gain settle it
        if not cuts[-1] or (len(cuts) > 2 and cuts[-1] >= cuts[-3]):
            break
        wishes = materialize(_wishes(state, counts, closed, quota), "wishes")
        flows = {
            (r.source, r.shard): r["count"] for r in wishes.groupBy("source", "shard").count().collect()
        }
        allowed = _allowance(flows, [max(0, most + most // SLACK - load) for most, load in zip(quotas, loads)])
        taken = {target: 0 for _, target in flows}
        for (source, target), n in allowed.items():
            taken[target] += n
            loads[source] -= n
            loads[target] += n
        full = {target for target, n in taken.items() if not n} - closed
        log.info("cut links %d, wishes %d, moves %d", cuts[-1], sum(flows.values()), sum(taken.values()))
        if not any(taken.values()) and not full:
            break
        closed |= full
        moves = materialize(_moves(wishes, flows, allowed), "moves")
        state = materialize(
            state.join(moves, F.col("uid") == F.col("moved"), "left").select(
                "uid", "part", "hub", F.coalesce("target", "shard").alias("shard")
            ),
            "state",
        )
    return state, cuts


def place_linked(links: DataFrame, quotas: list[int]) -> DataFrame:
    """``(uid, part, shard)`` of the linked documents that fit into the quotas."""
    state, cuts = propagate(links, quotas)
    log.info("cut links by round: %s", cuts)
    placed = state.select(
        "uid", "part", "shard", _bucket(F.col("part"), BUCKETS).alias("bucket")
    )
    return materialize(
        placed.join(_accepted(placed, quotas), ["shard", "bucket"]).select("uid", "part", "shard"),
        "placed",
    )


def _numbered(rows: DataFrame, group: list[str], within: list[str], count: int, out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, ... without gaps per ``group``.

    Rows fall into ranges by the hash of ``within[0]``, equal values into the
    same one; only the sizes of the ranges are summed up in order.
    """
    spread = rows.withColumn("_range", _bucket(F.col(within[0]), count))
    sizes = spread.groupBy(*group, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *group, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    row = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*within)) - 1
    return (
        spread.withColumn("_row", row)
        .join(starts, [*group, "_range"])
        .withColumn(out, (F.col("_start") + F.col("_row")).cast("bigint"))
        .drop("_range", "_row", "_start")
    )


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(uid, shard, slot)`` of every row of the written table ``(uid, digest)``.

    ``uid`` is unique; rows with equal ``digest`` are linked, null ones never.
    Row counts of the shards differ by one at most; slots have no gaps.
    """
    total = docs.count()
    quotas = [total // shards + (n < total % shards) for n in range(shards)]
    links = text_links(docs, quotas[-1])
    placed = place_linked(links, quotas)
    parts = materialize(links.select("uid", "part"), "parts")
    rest = (
        docs.select("uid")
        .join(placed.select("uid"), "uid", "left_anti")
        .join(parts, "uid", "left")
        .select("uid", F.coalesce("part", "uid").alias("part"))
    )
    loads = [0] * shards
    for row in placed.groupBy("shard").count().collect():
        loads[row.shard] = row["count"]
    room_ends, end = [], 0
    for quota, load in zip(quotas, loads):
        end += quota - load
        room_ends.append(end)
    ranges = max(1, -(-end // RANGE_ROWS))
    ends = F.array(*[F.lit(e).cast("bigint") for e in room_ends])
    filled = _numbered(materialize(rest, "rest"), [], ["part", "uid"], ranges, "position").select(
        "uid", F.size(F.filter(ends, lambda e: e <= F.col("position"))).alias("shard")
    )
    everyone = materialize(placed.select("uid", "shard").unionByName(filled), "everyone")
    return _numbered(everyone, ["shard"], ["uid"], max(1, -(-quotas[0] // RANGE_ROWS)), "slot")


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 16. A null text has no bytes, the
    checksum of an empty one, and no links. Repeated rows and null ids are rows
    of their own. With fewer rows than shards some shards stay empty.
    """
    text = F.col(text_col).cast("binary")
    base = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.length(text), F.lit(0)) + 16).cast("bigint").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "base",
    )
    placed = balanced_shards(base.select("uid", "digest"), shards)
    return base.join(placed, "uid").select("doc_id", "size", "text_crc32", "shard", "slot")


def op9_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; row counts at most one apart."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
