"""Mixing sources to target shares of all tokens.

The mix is the largest one in which every source meets its share without any document being used more than its source's
`max_repeats` times: T = min over sources of max_repeats * tokens / share. A source then needs c = T * share / tokens copies of each
document, on average; systematic sampling adds up the copies along the source's documents, shifts by one random offset, and uses a
document once per whole number crossed. As c <= max_repeats, no document exceeds it, and the copies of any stretch of documents are
within one of their expectation.

Documents are taken in order of size class (a quarter of a doubling), so that every class is sampled in proportion and the tokens drawn
scatter little. The running sums are formed in blocks of about `block_rows` documents of a size class (by a hash of their id), so a hot source
spreads over tasks: block totals are summed over the blocks, and within a block only its own rows are sorted.

Defined cases: documents of null or unlisted sources, of sources with share 0 (or null or NaN) or max_repeats below 1, and documents
without tokens (null and empty texts) aren't used; listed sources without usable tokens contribute nothing and the other shares
are met among themselves (`target_share` is reported as given, `reachable_share` as used); repeated rows count as documents of their
own; of a source listed twice the larger share counts; empty tables give an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import token_counts
from tidemark.session import cut


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", *, path: str | None = None) -> DataFrame:
    """(key, source, n_tokens) of every document, kept in the checkpoint folder as it is used more than once."""
    return cut(token_counts(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")), ["key", "source"], path=path))


def plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: tokens, reachable share, expected copies of each document. As small as the list."""
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.when(~F.isnan("target_share"), F.col("target_share"))).alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sized.where((F.col("n_tokens") > 0) & F.col("source").isNotNull()).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))
    p = t.join(have, "source", "left").fillna(0, ["tokens", "documents"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)
    p = p.withColumn("usable", F.coalesce(usable, F.lit(False)))
    everything = Window.partitionBy(F.lit(1))
    p = p.withColumn("reachable_share", F.when(F.col("usable"), F.col("target_share") / F.sum(F.when(F.col("usable"), F.col("target_share"))).over(everything)).otherwise(0.0))
    size = F.min(F.when(F.col("usable"), F.col("max_repeats") * F.col("tokens") / F.when(F.col("reachable_share") > 0, F.col("reachable_share")))).over(everything)
    p = p.withColumn("mix_tokens", size)
    return p.withColumn("copies", F.when(F.col("usable"), F.least(F.col("mix_tokens") * F.col("reachable_share") / F.when(F.col("tokens") > 0, F.col("tokens")), F.col("max_repeats").cast("double"))).otherwise(0.0))


def draw(sized: DataFrame, planned: DataFrame, *, seed: int = 7, block_rows: int = 16_384) -> DataFrame:
    """(key, source, n_tokens, repeats) of the documents used."""
    # one offset in [0, 1) per source, the same however the rows are spread
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("source")), F.lit(1 << 30)) / float(1 << 30)
    use = planned.where("usable").select("source", "copies", offset.alias("u"), F.ceil(F.col("documents") / block_rows).alias("parts"))
    d = sized.where(F.col("n_tokens") > 0).join(use, "source")
    block = F.floor(4 * F.log2("n_tokens")) * F.col("parts") + F.pmod(F.xxhash64(F.lit(seed), F.col("key")), F.col("parts"))
    d = d.withColumn("block", block).drop("parts")
    per = d.groupBy("source", "block").agg(F.sum("copies").alias("in_block"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("block")
    start = per.select(F.col("source").alias("s"), F.col("block").alias("b"), (F.sum("n").over(upto) - F.col("n")).alias("before"))
    w = Window.partitionBy("source", "block").orderBy("n_tokens", "key")
    d = d.withColumn("i", F.row_number().over(w)).join(start, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
    # all documents of a source expect the same copies, so the running sum is rank times copies, without rounding that adds up
    last = (F.col("before") + F.col("i")) * F.col("copies") + F.col("u")
    first = (F.col("before") + F.col("i") - 1) * F.col("copies") + F.col("u")
    d = d.withColumn("repeats", (F.floor(last) - F.floor(first)).cast("int"))
    return d.where(F.col("repeats") > 0).select("key", "source", "n_tokens", "repeats")


def report(drawn: DataFrame, planned: DataFrame) -> DataFrame:
    """Per listed source what was wanted and what came out."""
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.sum("repeats").alias("used_documents"), F.max("repeats").alias("most_repeats"))
    r = planned.join(got, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_repeats"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return r.select("source", "target_share", "reachable_share", (F.col("used_tokens") / F.when(total > 0, total)).alias("actual_share"), "max_repeats", "most_repeats", "tokens", "documents", "used_tokens", "used_documents")
