"""Mixing sources to target weights.

Tokens are summed per source; with them each source's repetition rate follows, and each document is emitted floor(rate)
times, plus once more where the uniform number made of its id, the mix and the seed is below the fraction.

The size of a mix is the most that all its caps allow with exact shares, but no more than its sources hold in all: T =
min(sum of the sources' tokens, cap x tokens / share of each capped source); rate = share x T / tokens <= cap. So every
source has its share of the tokens in expectation, and no document comes more often than its cap. A mix may be given a size in
tokens instead: then every source gives what it can of its share, a capped one no more than cap x tokens, and `shortfall` says
how many of the tokens meant for a source its cap withholds; the others keep their sizes, so that their shares rise.

Weights are taken relative to the sum of those that can be met: a source without tokens, with a weight that is null or not
above 0, or a cap of 0 or less has no share. Several rows of a source in one mix add up, under the smallest cap. Sources
are named the same if they agree after white space, case and separators are normalised; documents of null or blank source
belong to none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from penduline.llm.tokenizer import VOCABULARY, count_tokens
from penduline.session import broadcast_if_small, materialize

SEED = 20_240_501


def source_key(source: Column) -> Column:
    """' Run-Reports ' -> run_reports; null for a blank one."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(bare != "", bare)


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) with the source's key; written once, as it is used twice."""
    return materialize(count_tokens(documents.withColumn("source", source_key(F.col("source"))).where("source IS NOT NULL"), ["doc_id", "source"], vocabulary=vocabulary))


def rates(sizes: DataFrame, targets: DataFrame, tokens: int | None = None) -> DataFrame:
    """(mix_id, source, target_weight, max_repeats, n_docs, source_tokens, target_share, rate, shortfall) of every named source.
    tokens: the size of each mix; None for the most that all caps allow with exact shares."""
    held = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("bigint").alias("source_tokens"))
    named = targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_weight", "max_repeats").groupBy("mix_id", "source").agg(
        F.sum("target_weight").alias("target_weight"), F.min("max_repeats").alias("max_repeats"))
    mix = Window.partitionBy("mix_id")
    usable = F.col("source_tokens") > 0
    usable = usable & (F.col("target_weight") > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    both = named.join(held, "source", "left").na.fill(0, ["n_docs", "source_tokens"]).withColumn("weight", F.when(usable, F.col("target_weight")).otherwise(0.0))
    shares = both.withColumn("target_share", F.coalesce(F.try_divide("weight", F.sum("weight").over(mix)), F.lit(0.0)))
    bound = F.when(F.col("weight") > 0, F.try_divide(F.col("max_repeats") * F.col("source_tokens"), F.col("target_share")))
    total = F.least(F.min(bound).over(mix), F.sum(F.when(F.col("weight") > 0, F.col("source_tokens"))).over(mix).cast("double"))
    wanted = F.col("target_share") * (total if tokens is None else F.lit(float(tokens)))
    rate = F.coalesce(F.try_divide(wanted, F.col("source_tokens")), F.lit(0.0))
    held_back = F.least(rate, F.coalesce(F.col("max_repeats").cast("double"), rate))
    short = F.greatest(F.lit(0), F.round((rate - held_back) * F.col("source_tokens"))).cast("bigint")
    return shares.withColumn("rate", held_back).withColumn("shortfall", F.when(F.col("weight") > 0, short).otherwise(F.lit(0).cast("bigint"))).select(
        "mix_id", "source", "target_weight", "max_repeats", "n_docs", "source_tokens", "target_share", "rate", "shortfall")


def _copies(sizes: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    whole = F.floor(F.col("rate") + 1e-9)
    drawn = F.shiftrightunsigned(F.xxhash64("doc_id", "mix_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    copies = (whole + F.when(drawn < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return sizes.join(broadcast_if_small(planned.where("rate > 0")), "source").withColumn("copies", copies).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, vocabulary: str = VOCABULARY, tokens: int | None = None) -> DataFrame:
    """(mix_id, doc_id, copy_no, source, n_tokens): one row per copy of a document in a mix."""
    sizes = sized(documents, vocabulary)
    out = _copies(sizes, rates(sizes, targets, tokens), seed)
    return out.select("mix_id", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "source", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, seed: int = SEED, vocabulary: str = VOCABULARY, tokens: int | None = None) -> DataFrame:
    """Target and actual share of every named source of every mix, whether or not it has documents."""
    sizes = sized(documents, vocabulary)
    planned = materialize(rates(sizes, targets, tokens))
    out = _copies(sizes, planned, seed).groupBy("mix_id", "source").agg(
        F.sum("copies").alias("out_docs"), F.sum(F.col("copies") * F.col("n_tokens")).cast("bigint").alias("out_tokens"), F.max("copies").alias("most_copies"))
    every = planned.join(out, ["mix_id", "source"], "left").na.fill(0, ["out_docs", "out_tokens", "most_copies"])
    return every.withColumn("actual_share", F.coalesce(F.try_divide("out_tokens", F.sum("out_tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0)))
