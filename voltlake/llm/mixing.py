"""Mixing sources to target weights by nested hash thresholds, without sorting.

Sizes are summed by source and hash bucket; the bucket in which a source's budget ends is
split again until one hash value remains. Documents whose hash lies below a source's
threshold are taken once more than the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.runtime import materialize, row_count_up_to

#: A public tokenizer's ranks; the path is a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The hash has 60 bits, taken 12 at a time.
LEVEL_BITS, LEVELS = 12, 5


def source_name(column):
    """Spelling variants of a source are one source: lower case, no blanks around."""
    return F.lower(F.trim(column))


def token_counts(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds ``tokens``: the number of tokens of the whole text; null and empty have none.
    The tokenizer's file is read by the driver and sent to the executors."""
    schema = docs.select(*keep)
    with open(tokenizer, "rb") as file:  # a vocabulary file of at most a few MB
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            out = batch[keep].copy()
            out["tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch[text]]
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.schema.fields)
    return docs.select(*keep, text).mapInPandas(count, f"{fields}, tokens long")


def mixture(
    sized: DataFrame,
    targets: DataFrame,
    key: str = "doc_id",
    total: int | None = None,
    level_bits: int = LEVEL_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares) from documents (key, source, tokens) and targets (source,
    target_share, max_repeats).

    Each source is given ``target_share`` of ``total`` tokens (default: all tokens there
    are). A source supplies every document as often as whole rounds fit its budget, at
    most ``max_repeats`` times, and once more those below its hash threshold, so that the
    sum never exceeds the budget. ``selection``: (key, source, tokens, copies) of the
    documents used; ``shares``: per target the budget, the tokens supplied, the actual
    share of the mixture and whether the target was met within one document.

    Sources without a target supply nothing; targets without documents stay unmet.
    Documents given twice count once; documents without tokens are never used. Null
    sources belong to no target.
    """
    once = sized.groupBy(key).agg(F.min(source_name(F.col("source"))).alias("source"), F.min("tokens").alias("tokens"))
    bits = level_bits * LEVELS
    docs = once.where(F.col("tokens") > 0).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - bits))
    plan = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    plan = F.broadcast(plan.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")))  # one row per source of the mixture
    docs = materialize(docs.join(plan.select("source"), "source", "left_semi"), "mix")
    bucket = F.shiftright("h", bits - level_bits)
    level = materialize(docs.groupBy("source", bucket.alias("b")).agg(F.sum("tokens").alias("t"), F.max("tokens").alias("big")), "buckets")
    supply = level.groupBy("source").agg(F.sum("t").alias("supply"), F.max("big").alias("largest"))
    whole = F.lit(total) if total is not None else F.lit(once.agg(F.sum("tokens")).first()[0] or 0)
    budgets = plan.join(supply, "source", "left").withColumn("budget", F.col("target_share") * whole)
    rounds = F.least(F.floor(F.try_divide("budget", "supply")), F.col("max_repeats").cast("long"))
    budgets = budgets.withColumn("rounds", F.coalesce(rounds, F.lit(0))).withColumn("supply", F.coalesce("supply", F.lit(0)))
    rest = F.when(F.col("rounds") < F.col("max_repeats"), F.col("budget") - F.col("rounds") * F.col("supply")).otherwise(0.0)
    budgets = materialize(budgets.withColumn("rest", rest), "budgets")
    # narrow the bucket in which the rest of the budget ends
    open_ = budgets.where(F.col("rest") > 0).select("source", F.col("rest").alias("left"), F.lit(0).cast("long").alias("at"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("b"))
    found = None
    for n in range(1, LEVELS + 1):
        inside = level.join(F.broadcast(open_), "source")  # open: at most one row per source
        ends = inside.withColumn("cum", upto).where(F.col("cum") > F.col("left")).withColumn("first", F.row_number().over(Window.partitionBy("source").orderBy("b")))
        ends = ends.where(F.col("first") == 1).select("source", F.col("b").alias("at"), (F.col("left") - (F.col("cum") - F.col("t"))).alias("left"))
        ends = materialize(ends, "ends")
        found = ends
        if n == LEVELS or not row_count_up_to(ends, 0):
            break
        shift = bits - (n + 1) * level_bits
        level = (
            docs.join(F.broadcast(ends.select("source", "at")), "source")
            .where(F.shiftright("h", bits - n * level_bits) == F.col("at"))
            .groupBy("source", F.shiftright("h", shift).alias("b"))
            .agg(F.sum("tokens").alias("t"))
        )
        open_ = ends
    cuts = budgets.join(found.select("source", F.col("at").alias("threshold")), "source", "left")
    # a source whose rest never ends within its documents (only at a full round) is taken whole
    extra = F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.when(F.col("threshold").isNull() | (F.col("h") < F.col("threshold")), 1).otherwise(0))
    used = docs.join(F.broadcast(cuts.select("source", "rounds", "rest", "threshold")), "source")
    selection = used.withColumn("copies", (F.col("rounds") + extra).cast("int")).where(F.col("copies") > 0).select(key, "source", "tokens", "copies")
    selection = materialize(selection, "selection")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("supplied"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    shares = budgets.join(got, "source", "left").withColumn("supplied", F.coalesce("supplied", F.lit(0)))
    actual = F.try_divide(F.col("supplied"), F.sum("supplied").over(Window.partitionBy()))
    shares = shares.select(
        "source", "target_share", "max_repeats", "budget", "supplied", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), actual.alias("actual_share"),
        (F.col("supplied") >= F.col("budget") - F.coalesce("largest", F.lit(0))).alias("met"),
    )
    return selection, shares
