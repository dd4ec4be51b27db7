"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a token line: its documents in shuffled (hash) order, laid end to end and
repeated. The line is cut into blocks of `block` tokens. Golden-ratio points go through the
cumulative weights; the k-th point of a source is its k-th slot and takes its k-th block, so
any stretch of the mix holds the sources near their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import stage
from .common import word_count

#: 2 ** 31 / golden ratio, odd: multiples of it modulo 2 ** 31 are the golden-ratio points.
GOLDEN = 1327217885
RING = 1 << 31
#: Hash buckets of one source's line; offsets are summed per bucket, then over buckets.
LINE_BUCKETS = 4096
BINS = 1024
CHUNK = 65536
WEIGHTS = (5, 2, 1)
REPEATS = 3


def order_key(doc_id: Column, seed: str) -> Column:
    """60 hash bits that fix a document's place on its source's line."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source: its size, weight, target tokens and place in the order of sources.

    A target is `least(repeats * size, weight * level)` with the one level that makes targets
    add up to all tokens: what sources over their limit cannot take is shared by weight.
    Sources are one row each; their windows hold nothing else.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("src") % n + 1).cast("int"))
    per = per.withColumn("src", (F.row_number().over(by_name) - 1).cast("long")).withColumn("weight", pick)
    cap = F.col("source_size") * repeats
    along = Window.orderBy(cap / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(along), F.lit(0))
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(along), F.lit(0))
    per = per.withColumn("_level", left / share).withColumn("_top", F.max("_level").over(whole))
    target = F.least(cap.cast("double"), F.col("weight") * F.col("_top"))
    return per.withColumn("target", target).drop("_level", "_top")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(slot, src, rank): which source's which block stands at each place of the mix.

    Points beyond a source's quota are passed over; what a source still lacks after the last
    point (a few blocks, by the discrepancy) follows at the end.
    """
    spark = targets.sparkSession
    order = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    quota = targets.select("src", F.ceil(F.round("target") / block).cast("long").alias("quota")).where("quota > 0")
    quota = quota.withColumn("below", F.coalesce(F.sum("quota").over(order), F.lit(0)))
    total = quota.agg(F.sum("quota")).first()[0] or 0
    bins = F.sequence(
        F.floor(F.col("below") / total * BINS), F.least(F.lit(BINS - 1), F.floor((F.col("below") + F.col("quota")) / total * BINS))
    )
    spans = quota.select("src", "quota", "below", F.explode(bins).alias("bin"))
    at = (F.col("id") % RING * GOLDEN % RING) / RING
    points = spark.range(total).select(F.col("id").alias("slot"), (at * total).alias("at"), F.floor(at * BINS).alias("bin"))
    hit = points.join(spans, "bin").where("at >= below and at < below + quota")
    hit = hit.select("slot", "src", "quota", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    # ranks: counts per chunk of slots, summed over chunks, then counted inside the chunk
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = hit.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n"))
    starts = chunks.select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot"))
    ranked = hit.withColumn("inside", inside).join(starts, ["src", "chunk"])
    ranked = ranked.withColumn("rank", F.col("start") + F.col("inside")).where("rank <= quota")
    reached = chunks.groupBy("src").agg(F.sum("n").alias("got"))
    lacking = quota.join(reached, "src", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    lacking = lacking.withColumn("end", F.coalesce(F.sum(F.expr("quota - got")).over(order), F.lit(0)))
    tail = lacking.select("src", "got", "end", F.explode(F.sequence(F.col("got") + 1, F.col("quota"))).alias("rank"))
    tail = tail.select((F.lit(total) + F.col("end") + F.col("rank") - F.col("got") - 1).alias("slot"), "src", "rank")
    return ranked.select("slot", "src", "rank").unionByName(tail)


def mix(
    docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, block: int = 1024, seed: str = "mix"
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix over `doc_id`, `source` and `text` of `docs`.

    documents: doc_id, size, source_size, target and `taken`, one row per input row.
    pieces: slot, doc_id, first, words - the words `first .. first + words - 1` of a document
    that stand in a slot; ordered by slot they are the mix.

    Sources stand in code point order, null last, and get the weights in turn. A null or blank
    text has size 0 and is taken 0 times; a null doc_id is a document like others; repeated
    rows are documents of their own. The order on a line is a hash of doc_id (then size), so
    reruns agree. Other columns are not read. An empty table gives empty results.
    """
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    sizes = stage(sizes.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = stage(source_targets(sizes, weights, repeats), "targets")
    key = order_key(F.col("doc_id"), seed)
    lines = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).drop(targets.source)
    lines = lines.withColumn("key", key).withColumn("bucket", F.shiftright("key", 48))
    inside = Window.partitionBy("src", "bucket").orderBy("key", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    buckets = lines.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("src", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("begin"))
    placed = lines.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["src", "bucket"])
    placed = placed.withColumn("begin", F.col("begin") + F.col("own"))
    placed = stage(placed.select("row", "doc_id", "src", "size", "source_size", "target", "begin"), "lines")
    length = F.round("target").cast("long")
    rounds = placed.where("size > 0").withColumn("length", length)
    rounds = rounds.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rounds = rounds.withColumn("lo", F.expr("turn * source_size + begin")).where("lo < length")
    rounds = rounds.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("length")))
    cut = F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))
    parts = rounds.withColumn("b", F.explode(cut)).withColumn("from", F.greatest("lo", F.col("b") * block))
    parts = parts.withColumn("words", F.least("hi", (F.col("b") + 1) * block) - F.col("from"))
    parts = parts.select("row", "doc_id", "src", (F.col("b") + 1).alias("rank"), (F.col("from") - F.col("lo")).alias("first"), "words")
    pieces = parts.join(schedule(targets, block), ["src", "rank"])
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    result = placed.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )
    return result, pieces.select("slot", "doc_id", "first", "words")
