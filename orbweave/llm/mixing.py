"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks (DataFrame functions only).

1. ``targets``: each source has a weight; the mix is ``share`` times all words. A target stops at ``cap`` times its
   source's size and the excess goes to the others by weight. Ordered by cap / weight the capped sources come
   first, so running sums give the common level of the others without iterating.
2. ``seats``: blocks of ``block_words`` words go to the highest quotients target / (2k - 1). Rounding by a divisor a
   little too large gives seats that are certain, one a little too small bounds the rest, so only about two
   quotients per source are ranked, whatever the number of blocks.
3. A source's quota is apportioned to its shards (seeded groups of about ``shard_docs`` documents) the same way.
4. A shard is a line of words, its documents in seeded order, cut into equal blocks. All its blocks are taken
   ``quota // blocks`` times and the first ``quota % blocks`` once more: a seeded choice, as the order is.

Only (id, source, size) rows are shuffled, never texts. A hot source spreads over its shards.
Nulls: a null text has 0 words, as an empty one has; a null source is a source of its own and comes last, a null id is an id of its
own. Very long texts are lines of words like others. Equal quotients go to the smaller key, equal places in a shard's order to the
smaller id. Repeated rows count as rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.llm.common import WORD, sized, stored

WEIGHTS = (3, 1, 2)


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits of a seeded digest of some columns: the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(x.cast("string"), F.lit("")) for x in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """src, source_size, n_docs, target from src, size rows: one row per source."""
    every = Window.partitionBy()
    by_name, by_ratio = Window.orderBy("src"), Window.orderBy("ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    found = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    found = found.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    found = found.withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    over = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    found = found.withColumn("level", left / over)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(every)["level"]
    return found.withColumn("target", F.least(F.col("limit"), F.coalesce(level * F.col("weight"), F.col("limit")))).select("src", "source_size", "n_docs", "target")


def seats(claims: DataFrame, key: str, claim: str, total: str, within: list[str]) -> DataFrame:
    """claims with ``quota``: ``total`` seats of each group ``within`` by the highest quotients claim / (2k - 1).

    Equal quotients go to the smaller key. A claim of 0 gets none.
    """
    group = Window.partitionBy(*within)
    claims = claims.withColumn("_sum", F.sum(claim).over(group)).withColumn("_half", F.sum((F.col(claim) > 0).cast("double")).over(group) / 2)
    share = F.when(F.col("_sum") > 0, F.col(claim) / F.col("_sum")).otherwise(F.lit(0.0))
    sure = F.floor(F.greatest(F.col(total) - F.col("_half"), F.lit(0.0)) * share + 0.5)
    most = F.floor((F.col(total) + F.col("_half")) * share + 0.5) + 1
    sure = F.when(F.col(total) > F.col("_half"), sure).otherwise(F.lit(0)).cast("long")
    claims = claims.withColumn("_sure", F.when(F.col(claim) > 0, F.greatest(sure - 1, F.lit(0))).otherwise(F.lit(0)).cast("long"))
    claims = claims.withColumn("_more", F.when(F.col(claim) > 0, F.sequence(F.col("_sure") + 1, F.greatest(most.cast("long"), F.col("_sure") + 1))).otherwise(F.array().cast("array<long>")))
    claims = claims.withColumn("_open", F.col(total) - F.sum("_sure").over(group))
    ranked = claims.select("*", F.explode("_more").alias("_k")).withColumn("_quotient", F.col(claim) / (2 * F.col("_k") - 1))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("_quotient"), key))
    won = ranked.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_open")).groupBy(*within, key).agg(F.count(F.lit(1)).alias("_won"))
    keys = list(dict.fromkeys([*within, key]))
    return claims.join(won, keys, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_sum", "_half", "_sure", "_more", "_open", "_won")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 16, shard_docs: int = 2048, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words the mix takes of each document, repeats counted; and mark, the
    text's digest. Shards go by id, size and digest, so that rows of one id (or without one) spread as others do."""
    mark = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    src = F.when(F.col("source").isNull(), F.lit("z")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))  # null last
    sizes = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), src.alias("src"), n_words(F.col("text")).alias("size"), mark.alias("mark")), "mix-sizes")
    goal = targets(sizes, weights, share, cap).withColumn("_all", F.lit(0))
    goal = goal.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    goal = seats(goal, "src", "target", "blocks", ["_all"])
    goal = goal.withColumn("shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
    goal = stored(goal.select("src", "source_size", "target", F.col("quota").alias("source_quota"), "shards"), "mix-goal")

    order = seeded(seed, F.col("doc_id"))
    placed = sizes.join(sized(goal), "src").withColumn("order", order)
    placed = placed.withColumn("shard", F.pmod(seeded(seed + 1, F.col("doc_id"), F.col("size"), F.col("mark")), F.col("shards")))
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = seats(shards.withColumn("claim", F.col("shard_size").cast("double")), "shard", "claim", "source_quota", ["src"])
    blocks = F.ceil(F.col("shard_size") / block_words)
    shards = shards.select("src", "shard", blocks.alias("blocks"), F.least(F.col("quota"), (blocks * int(cap)).cast("long")).alias("quota"))

    line = Window.partitionBy("src", "shard").orderBy("order", F.col("doc_id").asc_nulls_first(), "size", "mark")
    placed = placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    found = placed.join(shards, ["src", "shard"])
    base = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(F.lit(0))
    extra = (F.col("quota") - base * F.col("blocks")) * block_words
    taken = base * F.col("size") + F.greatest(F.lit(0), F.least(F.col("end"), extra) - (F.col("end") - F.col("size")))
    return found.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "mark")


_DEFAULTS = {"weights": WEIGHTS, "share": 1.5, "cap": 2.0, "block_words": 16, "shard_docs": 2048, "seed": 17}


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as often as it is taken whole, and, at the border of a
    shard's last block, once more with its first words only (its words joined by one space).

    Rows equal in doc_id, source and text share what is taken of them evenly; what is left over is given to a row more for all of
    them, whose other columns are those of one of them. So all words the mix takes are there.
    """
    settings = [settings.get(k, v) for k, v in _DEFAULTS.items()]
    keys = ["id", "src", "mark"]
    took = mix(docs, *settings).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("src"), "mark", "size").agg(F.sum("taken").alias("total"), F.count(F.lit(1)).alias("rows"))
    took = stored(took.filter("total > 0").select(*keys, "size", F.floor(F.col("total") / F.col("rows")).alias("taken"), (F.col("total") % F.col("rows")).alias("over")), "mix-taken")
    # rows travel as one struct: what their columns are called meets no name of the join
    own = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.col("source").cast("string").alias("own_src"), own.alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_src").eqNullSafe(F.col("src")) & (F.col("own_mark") == F.col("mark"))
    kept = ["row", *keys, "size", "taken"]
    even = packed.join(sized(took.filter("taken > 0").drop("over"), took.count()), same).select(*kept)
    over = took.filter("over > 0").drop("taken").withColumnRenamed("over", "taken")
    more = packed.join(sized(over), same).groupBy(*keys, "size", "taken").agg(F.first("row").alias("row")).select(*kept)
    joined = even.union(more)
    text, rest = F.col("row")["text"], F.col("taken") % F.col("size")
    cut = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, rest.cast("int")), " ")
    whole = F.array_repeat(F.lit(True), F.floor(F.col("taken") / F.col("size")).cast("int"))
    rows = joined.withColumn("whole", F.explode(F.concat(whole, F.when(rest > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))))
    said = F.when(F.col("whole"), text).otherwise(cut)
    of = lambda c: F.col("row")[c]
    replaced = {"text": said, "n_chars": F.when(F.col("whole"), of("n_chars")).otherwise(F.char_length(said)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": said}
    return rows.select(*[replaced.get(c, of(c)).alias(c) for c in docs.columns])
