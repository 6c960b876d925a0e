"""Sharding by balanced label propagation: linked documents move to one shard under quotas, counts stay at most one apart.

Documents are linked by hubs: a hub is anything that several documents share (here: the text), so no pairs are made. A
cut edge is a document apart from its hub's largest part. Documents without a partner are free: they cost nothing
anywhere and fill the shards up at the end.

Linked documents start spread evenly. Each round is three joins: hubs count their documents per shard; each document adds
up, over its hubs, the neighbours it would have in each shard that has room; and it asks to move to the best one if that has more than its own (ties go
to a shard in an order of the hub's own, so all documents of a hub agree). Requests from shard i to shard j are at most as many as
fit: the 16 x 16 request counts are scaled down until no shard takes in more than its room and what leaves it. Who may go is
cut off a histogram by gain and hub, so that hubs move whole; a hub larger than a quota is cut by a hash of its documents.
Rounds end when a round moves less than one in `still` linked documents.

At last the documents of each shard are numbered along a range exchange, linked ones first by hub. Those
above the shard's count and the free ones are numbered together and fill the shards' remaining places. So counts are exact whatever the
rounds did, and a place in the shard comes with it. The driver sees counts per shard, per pair of shards and per partition only.

Defined results: a null text is empty; null ids are kept; every repeated row is a document of its own and linked to its copies; ties go by
hashes of row numbers; further columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise

SHARDS = 16
ROUNDS = 24
STILL = 500
#: Classes of requests: 32 gains x HUBS parts of the hubs.
HUBS = 16
#: Shares of a class are cut at so many parts.
PARTS = 1 << 20


def counted(rows: DataFrame, by: str = "shard") -> dict:
    return {r[0]: r[1] for r in rows.groupBy(by).count().collect()}


def quotas(wanted: dict, room: list[int]) -> dict:
    """(i, j) -> how many may move, of wanted ones: no shard takes in more than its room and what leaves it.

    Requests only shrink from step to step, so the steps end: what does not leave a shard leaves less room in it.
    """
    x = {k: float(v) for k, v in wanted.items()}
    for _ in range(1000):
        over = False
        for j, free in enumerate(room):
            into = sum(v for k, v in x.items() if k[1] == j)
            most = max(0.0, free + sum(v for k, v in x.items() if k[0] == j))
            if into > most + 1e-6:
                over = True
                for k in x:
                    if k[1] == j:
                        x[k] *= most / into
        if not over:
            break
    else:
        # Not settled: room alone is always safe.
        into = {j: sum(v for k, v in wanted.items() if k[1] == j) for j in range(len(room))}
        x = {k: v * min(1.0, max(0, room[k[1]]) / into[k[1]]) for k, v in wanted.items()}
    return {k: int(v) for k, v in x.items()}


def requests(linked: DataFrame, links: DataFrame, open_shards: list[int], shards: int = SHARDS) -> DataFrame:
    """Documents that would have more neighbours in another open shard: rid, shard, target, gain, hub (one of those that decide)."""
    at = links.join(linked, "rid")
    held = at.groupBy("hub", "shard").agg(F.count("*").alias("n"))
    # At most one entry per shard in a hub's map.
    held = held.groupBy("hub").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("held"))
    # Stored, so that the join below has exchanges of its own, of which a hot hub's can be split.
    held = materialise(held.filter(F.size("held") > 1), "held")
    near = at.join(held, "hub").select("rid", "shard", "hub", F.explode("held").alias("target", "n"))
    near = near.filter((F.col("target") == F.col("shard")) | F.col("target").isin(open_shards))
    turn = F.pmod(F.col("target") + F.pmod(F.xxhash64("hub"), F.lit(1 << 20)), F.lit(shards))
    rank = F.struct(F.sum("n").alias("n"), F.max(F.struct("n", turn.alias("turn"), "hub")).alias("by"))
    each = near.groupBy("rid", "shard", "target").agg(rank.alias("r"))
    own = F.max(F.when(F.col("target") == F.col("shard"), F.col("r.n")))
    best = F.max(F.struct(F.col("r.n").alias("n"), F.col("r.by.turn").alias("turn"), "target", F.col("r.by.hub").alias("hub")))
    found = each.groupBy("rid", "shard").agg(own.alias("own"), best.alias("best")).filter("best.target <> shard")
    return found.select("rid", "shard", "best.target", (F.col("best.n") - F.col("own")).alias("gain"), "best.hub")


def admitted(asked: DataFrame, room: list[int]) -> tuple[DataFrame, int]:
    """(rid, target) of the requests that are granted, about how many."""
    level = 31 - F.least(F.floor(F.log2(F.col("gain") + 1.0)), F.lit(31))
    asked = materialise(asked.withColumn("kind", (level * HUBS + F.pmod(F.xxhash64("hub", F.lit(1)), F.lit(HUBS))).cast("int")), "asked")
    hist = sorted((r["shard"], r["target"], r["kind"], r["count"]) for r in asked.groupBy("shard", "target", "kind").count().collect())
    wanted: dict = {}
    for i, j, _, n in hist:
        wanted[i, j] = wanted.get((i, j), 0) + n
    left, share, going = quotas(wanted, room), [], 0
    for i, j, kind, n in hist:
        take = min(n, left[i, j])
        left[i, j] -= take
        going += take
        if take:
            share.append((i, j, kind, PARTS * take // n))
    if not share:
        return asked.select("rid", "target").limit(0), 0
    # At most SHARDS^2 x 32 x HUBS rows.
    table = asked.sparkSession.createDataFrame(share, "shard int, target int, kind int, part long")
    lucky = F.pmod(F.xxhash64("rid", F.lit(2)), F.lit(PARTS))
    return asked.join(F.broadcast(table), ["shard", "target", "kind"]).filter(lucky < F.col("part")).select("rid", "target"), going


def propagate(links: DataFrame, most: int, shards: int = SHARDS, rounds: int = ROUNDS, still: int = STILL) -> DataFrame:
    """(rid, shard) of all documents in a stored frame of links (rid, hub); at most about `most` of them in a shard."""
    linked = materialise(links.select("rid").distinct().select("rid", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard")), "linked")
    for _ in range(rounds):
        load = counted(linked)
        room = [most - load.get(j, 0) for j in range(shards)]
        open_shards = [j for j in range(shards) if room[j] > 0] or [min(range(shards), key=lambda j: (load.get(j, 0), j))]
        moves, n = admitted(requests(linked, links, open_shards, shards), room)
        if n * still < sum(load.values()) or not n:
            break
        linked = materialise(linked.join(moves, "rid", "left").select("rid", F.coalesce("target", "shard").alias("shard")), "linked")
    return linked


def cut_edges(shards: DataFrame, links: DataFrame) -> int:
    """Documents apart from the largest part of their hub, over all hubs."""
    held = links.join(shards, "rid").groupBy("hub", "shard").count().groupBy("hub").agg((F.sum("count") - F.max("count")).alias("cut"))
    return held.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def numbered(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds a gapless number from 0 within an integer group, along `order`, which must be unique. Rows are spread by a range
    exchange; the table of starts has a row per partition and per group."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "numbered").withColumn("_part", F.shiftright("_at", 33))
    parts = sorted((r[group], r["_part"], r["first"], r["n"]) for r in placed.groupBy(group, "_part").agg(F.min("_at").alias("first"), F.count("*").alias("n")).collect())
    starts, seen = [], {}
    for g, part, first, n in parts:
        starts.append((g, part, seen.get(g, 0) - first))
        seen[g] = seen.get(g, 0) + n
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "_g int, _part long, _by long")) if starts else None
    if table is None:
        return placed.withColumn(out, F.col("_at")).drop("_at", "_part")
    both = placed.join(table.withColumnRenamed("_g", group), [group, "_part"])
    return both.withColumn(out, F.col("_at") + F.col("_by")).drop("_at", "_part", "_by")


def fill(docs: DataFrame, linked: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rid, shard, slot of all documents of a stored frame (rid): counts at most one apart."""
    n = docs.count()
    size = [n // shards + (j < n % shards) for j in range(shards)]
    hub = links.groupBy("rid").agg(F.min("hub").alias("hub"))
    own = numbered(linked.join(hub, "rid"), "shard", ["hub", "rid"], "slot").select("rid", "shard", "slot")
    most = F.element_at(F.array(*map(F.lit, size)), F.col("shard") + 1)
    own = materialise(own.withColumn("fits", F.col("slot") < most), "placed")
    kept = own.filter("fits").select("rid", "shard", "slot")
    load = counted(kept)
    free = docs.join(links.select("rid").distinct(), "rid", "left_anti").select("rid").unionByName(own.filter(~F.col("fits")).select("rid"))
    free = numbered(free.withColumn("one", F.lit(0)), "one", ["rid"], "k")
    # Free documents take the remaining places shard by shard.
    shard, slot, at = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for j in range(shards):
        have = load.get(j, 0)
        here = (F.col("k") >= at) & (F.col("k") < at + size[j] - have)
        shard = F.when(here, F.lit(j)).otherwise(shard)
        slot = F.when(here, F.col("k") - at + have).otherwise(slot)
        at += size[j] - have
    return kept.unionByName(free.select("rid", shard.alias("shard"), slot.alias("slot")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; rows of equal texts are linked. Size: bytes of the text and one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text).alias("text_crc32"), F.md5(text).alias("hub"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = materialise(rows, "documents")
    shared = rows.groupBy("hub").count().filter("count > 1").select("hub")
    links = materialise(rows.join(shared, "hub", "left_semi").select("rid", "hub"), "links")
    linked = propagate(links, rows.count() // shards, shards, **how)
    placed = fill(rows.select("rid"), linked, links, shards)
    return rows.join(placed, "rid").select("doc_id", "size", "text_crc32", "shard", "slot")
