"""Sharding by balanced label propagation, in iterated joins.

Every row has a hub (rows of one hub are linked). Shards begin as an even deal of all rows. In each round the rows of a
hub vote: the shards that hold most of them are its targets, one, or as many as the hub needs to fit. Linked rows
elsewhere ask to move to a target. Quotas let a move happen only as an exchange: two requests in opposite directions
swap; the others change places, rank by rank, with rows of the target shard that have no links. So the counts of all
shards stay at most one apart (the law `rows`) in every round, and cut links only go down. Rounds go on, as many as it takes, until
nothing moves or PATIENCE rounds in a row bring the rows that ask to move to no new least number. Ranks come from counts by (key, salt) and their running sums, so no shard or hub is gathered in one task.

A hub is a name of 64 bits, the length and the checksum among what is hashed; if two texts ever had one name, their rows
would be drawn to the same shard, and nothing else. Null texts count as empty texts, equal to each other; null ids and repeated rows are rows like others; an empty table
gives an empty result; other columns have no effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.storage import drop_table, write_table

SHARDS = 40
LAW = "rows"
#: Rounds in a row in which the rows that ask to move reach no new least number.
PATIENCE = 3
#: Rows of counts by (key, salt) that are broadcast at most.
MOST_COUNTS = 1 << 18


def ranked(df: DataFrame, key: str, name: str, keys: int, by: str = "row") -> DataFrame:
    """Adds the place of each row among those of its key (keys of them at most), from 0 without gaps; by: a column without ties. df should be a table."""
    salts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_COUNTS // keys))
    salted = df.withColumn("salt", F.pmod(F.xxhash64(by, F.lit(5)), F.lit(salts)))
    counts = salted.groupBy(key, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, "salt").orderBy(by)
    placed = salted.withColumn("place", F.row_number().over(inside) - 1)
    return placed.join(F.broadcast(offsets), [key, "salt"]).withColumn(name, F.col("offset") + F.col("place")).drop("salt", "offset", "place")


def _round(state: DataFrame, capacity: int, shards: int) -> tuple[int, DataFrame, list[str]]:
    """How many rows ask to move, (row, to) of the rows that change places, and the tables they are read from."""
    held = state.where("linked").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    vote = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("hub", "shard").alias("tie"), F.col("shard").alias("shard"))))
    votes = held.groupBy("hub").agg(F.sum("n").alias("all"), vote.alias("vote"))  # at most one element a shard
    targets = votes.select("hub", F.slice("vote", F.lit(1), F.least(F.ceil(F.col("all") / capacity), F.lit(shards)).cast("int")).getField("shard").alias("targets"))
    asking = state.where("linked").join(targets, "hub").where(~F.array_contains("targets", F.col("shard")))
    chosen = F.get("targets", F.pmod(F.xxhash64("row", F.lit(3)), F.size("targets").cast("long")).cast("int"))
    asked, asked_at = write_table(asking.select("row", F.col("shard").alias("from"), chosen.alias("to")).withColumn("way", F.col("from") * shards + F.col("to")), "asked")
    ways = asked.groupBy("way", "from", "to").agg(F.count(F.lit(1)).alias("n"))
    back = ways.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("n").alias("m"))
    before = Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    even = F.least("n", F.coalesce("m", F.lit(0)))
    open_ = ways.join(F.broadcast(back), ["from", "to"], "left").withColumn("even", even)
    open_ = open_.select("way", "even", F.coalesce(F.sum(F.col("n") - F.col("even")).over(before), F.lit(0)).alias("earlier"))  # at most shards^2 rows
    requests = ranked(asked, "way", "rank", shards * shards).join(F.broadcast(open_), "way").withColumn("rest", F.col("rank") - F.col("even"))
    requests, requests_at = write_table(requests.select("row", "from", "to", F.col("rest"), (F.col("rest") + F.col("earlier")).alias("turn")), "requests")
    free = ranked(state.where("not linked").select("row", "shard"), "shard", "turn", shards).select(F.col("row").alias("other"), F.col("shard").alias("to"), "turn")
    swapped = requests.where("rest < 0").select("row", "to")
    traded = requests.where("rest >= 0").join(free, ["to", "turn"]).select("row", "other", "from", "to")
    traded, traded_at = write_table(traded, "traded")
    moves = swapped.union(traded.select("row", "to")).union(traded.select("other", "from"))
    return asked.count(), moves, [asked_at, requests_at, traded_at]


def assign(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(row, shard) for nodes (row: unique long, hub), which should be a table."""
    spark = nodes.sparkSession
    total = nodes.count()
    capacity = max(1, -(-total // shards))
    sizes = nodes.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", F.lit(True).alias("linked"))
    dealt = ranked(nodes.select("row", "hub").withColumn("all", F.lit(0)), "all", "rank", 1).drop("all")
    begun = dealt.join(sizes, "hub", "left").select("row", "hub", F.coalesce("linked", F.lit(False)).alias("linked"), F.pmod("rank", F.lit(shards)).cast("int").alias("shard"))
    state, path = write_table(begun, "shards")
    fewest, since = total + 1, 0
    while True:
        asking, moves, used = _round(state, capacity, shards)
        fewest, since = (asking, 0) if asking < fewest else (fewest, since + 1)
        if since == PATIENCE or moves.isEmpty():
            drop_table(spark, *used)
            break
        before = path
        state, path = write_table(state.join(moves, "row", "left").select("row", "hub", "linked", F.coalesce("to", "shard").alias("shard")), "shards")
        drop_table(spark, before, *used)
    return state.select("row", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, law, shard, slot and grown_shard; equal texts are linked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    binary = text.cast("binary")
    size = (F.octet_length(binary) + 16).cast("long")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(binary).alias("text_crc32"), F.xxhash64(binary, size, F.crc32(binary)).alias("hub"))
    nodes, nodes_at = write_table(read.withColumn("row", F.monotonically_increasing_id()), "rows")
    placed, _ = write_table(nodes.join(assign(nodes, shards), "row"), "placed")
    drop_table(docs.sparkSession, nodes_at)
    slots = ranked(placed, "shard", "slot", shards)
    return slots.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the law `rows`."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
