"""Mixing of sources to target shares of the token total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.encode import BYTE_BPE_50K, count_tokens
from brindle.plans.physical import cut_lineage, spread

MIX_SEED = 20
SMALL = 10_000  # target rows that may be broadcast


def source_key(c):
    """Sources differ in case and in white space around them; the same source is meant."""
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = BYTE_BPE_50K, seed: int = MIX_SEED) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: doc_id, source, copy_no (from 0), n_tokens; report: one row per target source.

    A source's rate is target_share x (tokens of all listed sources' documents) / (its own tokens), at
    most max_repeats. Each document occurs floor(rate) times, and once more if a hash of (seed, doc_id),
    uniform in [0, 1), is below the fraction: the choice of a document needs no other row, so nothing is
    sorted or gathered, and it is the same on every run. Tokens are first summed per source (map-side).

    Documents of unlisted or null sources aren't encoded, and those without tokens not used. A listed source
    without documents reports zeros. A target row that is repeated counts once, the largest share and
    cap. Empty tables give an empty mixture. The report is as long as ``targets``.
    """
    listed = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    listed = listed.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    small = listed.count() <= SMALL  # target rows, which are sent to every task only where they are few
    sent = F.broadcast if small else lambda df: df
    wanted = documents.select("doc_id", "text", source_key(F.col("source")).alias("source")).join(sent(listed.select("source")), "source", "left_semi")
    sized = count_tokens(spread(wanted, "doc_id"), "doc_id", "text", vocabulary, "source")
    sized = cut_lineage(sized.select("doc_id", "source", "n_tokens"))  # read twice, encoded once
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    plan = listed.join(sent(have), "source", "left").na.fill(0, ["source_tokens", "source_docs"])
    plan = plan.crossJoin(plan.agg(F.sum("source_tokens").alias("total_tokens")))  # one row
    rate = F.least(F.col("max_repeats").cast("double"), F.try_divide(F.col("target_share") * F.col("total_tokens"), F.col("source_tokens")))
    plan = plan.withColumn("rate", F.when(F.col("source_tokens") > 0, F.greatest(F.lit(0.0), F.coalesce(rate, F.lit(0.0)))).otherwise(0.0))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = sized.where("n_tokens > 0").join(sent(plan.select("source", "rate")), "source")
    picked = picked.withColumn("copies", F.floor("rate").cast("int") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0))
    mixture = picked.where("copies > 0").select("doc_id", "source", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy_no"), "n_tokens")
    used = picked.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.sum("copies").alias("mixed_docs"))
    report = plan.join(sent(used), "source", "left").na.fill(0, ["mixed_tokens", "mixed_docs"])
    report = report.crossJoin(report.agg(F.sum("mixed_tokens").alias("all_mixed")))
    report = report.select(
        "source", "target_share", "max_repeats", "source_docs", "source_tokens", "total_tokens", "rate", "mixed_docs", "mixed_tokens",
        F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("total_tokens")), F.lit(0.0)).alias("share_of_target_total"),
        F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("all_mixed")), F.lit(0.0)).alias("actual_share"),
    )
    return mixture, report
