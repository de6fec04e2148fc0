"""Sharding by balanced label propagation.

Documents that share a link key are neighbours. Each has a shard as its label. In a
round every key counts its documents per shard and holds on to the shards that have most
of them, as many as it needs; its other documents ask to move there. Every other round
it needs so many that their quotas hold all its documents, in the rounds between so many
that their documents and free places do. Of two shards as many documents change places as
ask on both sides, and a shard takes exactly as many more as its quota leaves room for.
Askers are admitted in the order of their keys, in buckets, so that those of one key move
together. A document never moves to a shard with fewer of its key, so the squares of all
counts add up to more each time and the rounds end: when none of either kind moves a
document. Documents without a neighbour go where room is left, and with them so do those
for whom their shard has none, which makes the sizes exact.

Laws: ``rows`` gives every shard its share of rows, counts at most one apart; ``key`` is
a rendezvous hash of ``doc_id`` and looks at nothing else (a null id counts as id 0).

Everything is joins, windows and aggregations. Ranks are taken within buckets whose
number follows the rows, and bucket totals are summed up beside them.

Edge cases: a null text has no link and no bytes; an empty table gives an empty table; a
group larger than a shard fills several; rows that share a ``doc_id`` are ordered by a
hash of their text, equal rows among them take places of their own; other columns do not
matter. ``rows`` numbers its rows, so identical rows are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

#: Rows of one ranking bucket, about.
BUCKET_ROWS = 2_000
#: Buckets of a key with more documents than ``BUCKET_ROWS``.
KEY_BUCKETS = 256
#: So many askers at most are ranked by one sort for a shard, without buckets.
FEW_ASKERS = 200_000
#: Steps in which a document's draw places it among those of its key that move.
DRAWS = 1 << 30


def sized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, link``: what the laws look at; ``link`` is null without a text."""
    body = F.col(text).cast("string")
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(body.isNotNull(), F.xxhash64(body, F.lit(3))).alias("link"),
    )


def _spread(*columns: str) -> Column:
    return F.xxhash64(*columns, F.lit(17))


def ranked(rows: DataFrame, by: list[str], order: list[Column], buckets: int, name: str) -> DataFrame:
    """Adds ``name``: gapless ranks from 0 within ``by``, counted bucket by bucket.

    Rows need a ``bucket`` below ``buckets``; ``order`` orders rows in a bucket.
    """
    totals = rows.groupBy(*by, "bucket").agg(F.count("*").alias("_n"))
    # Buckets are summed in blocks, so no window meets more than the root of their number.
    block = max(1, int(buckets**0.5))
    totals = totals.withColumn("_block", F.floor(F.col("bucket") / block))
    inside = Window.partitionBy(*by, "_block").orderBy("bucket")
    blocks = totals.groupBy(*by, "_block").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_block") if by else Window.partitionBy(F.lit(0)).orderBy("_block")
    blocks = blocks.withColumn("_of_block", F.sum("_m").over(before) - F.col("_m"))
    totals = totals.withColumn("_in_block", F.sum("_n").over(inside) - F.col("_n"))
    totals = totals.join(blocks.drop("_m"), [*by, "_block"]).select(
        *by, "bucket", (F.col("_in_block") + F.col("_of_block")).alias("_before")
    )
    own = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy(*order)) - 1
    return (
        rows.withColumn("_own", own)
        .join(totals, [*by, "bucket"])
        .withColumn(name, (F.col("_own") + F.col("_before")).cast("long"))
        .drop("_own", "_before")
    )


def _room(spark, total: int, shards: int) -> DataFrame:
    """``shard, quota``: rows per shard, at most one apart."""
    return spark.range(shards).select(
        F.col("id").cast("int").alias("shard"),
        (F.lit(total // shards) + (F.col("id") < total % shards).cast("long")).cast("long").alias("quota"),
    )


def _asking(linked: DataFrame, free: DataFrame, swaps: bool, turn: int) -> DataFrame:
    """The documents that ask to move, with the shard ``to`` they ask for and their key's ``all``.

    A key holds on to its fullest shards until their places, with ``swaps`` all of the
    quota and else those free, hold all of its documents; the others ask for the places
    left in these, fullest first.
    """
    counts = linked.groupBy("link", "shard").agg(F.count("*").alias("n")).join(free, "shard")
    spare = F.greatest(F.col("quota") - F.col("n"), F.lit(0)) if swaps else F.col("free")
    # A key has at most one row per shard.
    fullest = Window.partitionBy("link").orderBy(F.desc("n"), F.xxhash64("link", "shard"), "shard")
    counts = counts.withColumn("spare", spare).select(
        "link",
        "shard",
        "n",
        "spare",
        F.sum("n").over(Window.partitionBy("link")).alias("all"),
        F.sum(F.col("n") + F.col("spare")).over(fullest).alias("held"),
        F.sum("spare").over(fullest).alias("upto"),
    )
    held = F.col("held") - F.col("n") - F.col("spare") < F.col("all")
    plan = counts.groupBy("link", "all").agg(
        F.sum(F.when(~held, F.col("n")).otherwise(0)).alias("movers"),
        F.collect_list(F.when(held, F.col("shard"))).alias("held"),
        F.array_sort(F.collect_list(F.when(held & (F.col("spare") > 0), F.struct("upto", "shard")))).alias("places"),
    )
    draw = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(DRAWS))
    at = F.floor(draw / DRAWS * F.col("movers"))
    to = F.get(F.filter("places", lambda x: x["upto"] > F.col("at")), F.lit(0))["shard"]
    askers = linked.join(plan.filter("movers > 0"), "link").filter(~F.array_contains("held", F.col("shard")))
    return askers.withColumn("at", at).select("row", "link", "shard", "all", to.alias("to")).filter("`to` is not null")


def _admitted(askers: DataFrame, free: DataFrame, buckets: int, turn: int) -> DataFrame:
    """``(row, _to)`` of the askers that move: equal numbers both ways, then as many as are free."""
    mixed = F.xxhash64("link", F.lit(turn))
    askers = askers.withColumn("mixed", mixed)
    order = [F.col("mixed"), F.col("link"), F.col("row")]
    flow = askers.groupBy("shard", "to").agg(F.count("*").alias("m"))
    back = flow.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("m").alias("back"))
    both = flow.join(back, ["shard", "to"], "left").select(
        "shard", "to", F.least("m", F.coalesce("back", F.lit(0))).alias("swapped")
    )
    free = free.select(F.col("shard").alias("to"), "free")
    if askers.count() <= FEW_ASKERS:
        rank = F.row_number().over(Window.partitionBy("shard", "to").orderBy(*order))
        placed = askers.withColumn("rank", rank).join(both, ["shard", "to"])
        placed = placed.withColumn("swap", (F.col("rank") <= F.col("swapped")).cast("int"))
        to = Window.partitionBy("to")
        placed = placed.withColumn("swaps", F.sum("swap").over(to))
        placed = placed.withColumn("nth", F.row_number().over(to.orderBy(F.desc("swap"), *order)) - F.col("swaps"))
        return placed.join(free, "to").filter("swap = 1 or nth <= free").select("row", F.col("to").alias("_to"))
    inside = F.when(F.col("all") > BUCKET_ROWS, F.pmod(F.xxhash64("row"), F.lit(KEY_BUCKETS))).otherwise(0)
    askers = askers.withColumn("bucket", F.pmod("mixed", F.lit(buckets)) * KEY_BUCKETS + inside)
    placed = materialize(ranked(askers, ["shard", "to"], order, buckets * KEY_BUCKETS, "rank").join(both, ["shard", "to"]))
    rest = ranked(placed.filter("rank >= swapped").drop("rank"), ["to"], order, buckets * KEY_BUCKETS, "rank")
    rest = rest.join(free, "to").filter("rank < free").select("row", F.col("to").alias("_to"))
    return placed.filter("rank < swapped").select("row", F.col("to").alias("_to")).unionByName(rest)


def propagate(linked: DataFrame, room: DataFrame, rounds: int | None = None) -> DataFrame:
    """Label propagation over ``(row, doc_id, link, shard)``; returns the same columns.

    Goes on until no document moves, or for ``rounds`` rounds.
    """
    buckets = max(1, linked.count() // BUCKET_ROWS)
    turn, still = 0, 0
    while still < 2 and (rounds is None or turn < rounds):
        used = linked.groupBy("shard").agg(F.count("*").alias("used"))
        free = room.join(used, "shard", "left").select(
            "shard", "quota", F.greatest(F.col("quota") - F.coalesce("used", F.lit(0)), F.lit(0)).alias("free")
        )
        # One row per shard.
        free = linked.sparkSession.createDataFrame(free.collect(), free.schema)
        askers = materialize(_asking(linked, free, turn % 2 == 0, turn))
        moves = _admitted(askers, free, buckets, turn) if (asking := askers.count()) else askers
        turn += 1
        if not asking:
            still += 1
            continue
        moves = materialize(moves)
        if moves.isEmpty():
            still += 1
            continue
        still = 0
        linked = materialize(
            linked.join(moves, "row", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to")
        )
    return linked


def rendezvous(key: Column, shards: int) -> Column:
    """A shard from an id and the number of shards: with one more, rows move to the new one only.

    The highest draw over the shards wins, so a shard added later takes only the rows
    whose highest draw is its own.
    """
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s).alias("draw"), s.alias("shard"))
    )
    return F.array_max(draws)["shard"].cast("int")


def assign(docs: DataFrame, shards: int = 40, law: str = "rows", rounds: int | None = None, links: DataFrame | None = None) -> DataFrame:
    """Per document row ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``docs`` has the columns of `sized`; ``links`` replaces its ``link`` by ``(doc_id, link)``.
    """
    if law not in ("rows", "key"):
        raise ValueError("law is 'rows' or 'key'")
    if links is not None:
        docs = docs.drop("link").join(links.select("doc_id", "link").dropDuplicates(["doc_id"]), "doc_id", "left")
    rows = materialize(docs.withColumn("row", F.monotonically_increasing_id()))
    spark, total = rows.sparkSession, rows.count()
    buckets = max(1, total // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(_spread("doc_id", "row"), F.lit(buckets)).cast("int"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    if law == "key":
        key = F.coalesce("doc_id", F.lit(0))
        placed = rows.withColumn("shard", rendezvous(key, shards)).withColumn("grown_shard", rendezvous(key, shards + 1))
        placed = ranked(placed, ["shard"], order, buckets, "slot")
    else:
        room = _room(spark, total, shards)
        several = rows.filter("link is not null").groupBy("link").agg(F.count("*").alias("n")).filter("n > 1")
        linked = rows.join(several.select("link"), "link", "left_semi").select(
            "row", "doc_id", "link", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")
        )
        linked = propagate(materialize(linked), room, rounds).select("row", "shard")
        labelled = rows.join(linked, "row", "left")
        # What exceeds a quota joins the rows without a label.
        held = ranked(labelled.filter("shard is not null"), ["shard"], order, buckets, "slot").join(room, "shard")
        held = materialize(held)
        kept = held.filter("slot < quota").drop("quota")
        loose = labelled.filter("shard is null").drop("shard").unionByName(
            held.filter("slot >= quota").drop("shard", "slot", "quota")
        )
        loose = ranked(loose, [], order, buckets, "rank")
        used = kept.groupBy("shard").agg(F.count("*").alias("used"))
        free = room.join(used, "shard", "left").select(
            "shard", F.coalesce("used", F.lit(0)).alias("used"), (F.col("quota") - F.coalesce("used", F.lit(0))).alias("free")
        )
        upto = F.sum("free").over(Window.partitionBy(F.lit(0)).orderBy("shard"))
        free = free.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("free"))
        # ``shards`` rows, so the range join meets a table of proven size.
        filled = loose.join(F.broadcast(free), (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
        filled = filled.withColumn("slot", (F.col("used") + F.col("rank") - F.col("from")).cast("long"))
        columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
        placed = kept.select(*columns).unionByName(filled.select(*columns))
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", "grown_shard"
    )
