"""Mixing sources to target shares of the tokens, each document at most a capped number of times.

1. Tokens are counted per document; each source is cut by hash into shards.
2. The size of a mix is the largest at which every source that is there can give its share within its cap. Shares of
   sources that are not there, or have no tokens, go to the others in proportion, and the report says so.
3. The mix is a number of equal blocks of tokens. Sainte-Laguë apportionment gives the blocks to the sources by highest
   quotients (tokens over 1, 3, 5, ...), and each source's blocks to its shards, in the same way: integer quotas.
4. In a shard the documents stand in seeded order, and their tokens in a row are cut into the same equal blocks; a
   document belongs to the block its middle lies in. Blocks are what is drawn: all blocks of the shard as often as they go
   into the quota, then the first of the seeded order for what is left of it, so no document comes more often than the cap.

All of 4 is a running sum in the engine, one for each shard whatever the mixes.

Defined results: documents with a null source, or without tokens, are not drawn; null or negative shares and caps under
one draw nothing; shares that do not sum to one are taken in proportion; a source named twice in a mix is an error;
repeated texts are documents of their own; an empty table gives every mix with zero tokens.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyloom.llm.tokens import TOKENIZERS, token_counts
from storyloom.sources.tables import materialise, spread

SEED = 7
#: Blocks a mix is made of, and about how many tokens a shard may have.
BLOCKS = 10_000
SHARD_TOKENS = 2_000_000
#: Shards of one source at most, as the driver apportions them; beyond, a shard is only longer to sort, and spills.
MOST_SHARDS = 4096


def sainte_lague(votes: list[float], seats: int, caps: list[float] | None = None) -> list[int]:
    """Seats for each by highest quotients votes / 1, 3, 5, ...; ties go to the earlier; ``caps`` bound them.

    Seats are first dealt by whole shares and the rest one by one, so that many seats cost no more than a few.
    """
    caps = caps or [float("inf")] * len(votes)
    total = sum(v for v, c in zip(votes, caps) if v > 0 and c >= 1)
    given = [0] * len(votes)
    if total <= 0:
        return given
    # no party ends more than a share's rounding below its due, so this much is safe to deal at once
    spare = len(votes) + 2
    for k, v in enumerate(votes):
        if v > 0:
            given[k] = int(max(0, min(caps[k], v / total * max(0, seats - spare) - 1)))
    heap = [(-v / (2 * given[k] + 1), k) for k, v in enumerate(votes) if v > 0 and given[k] + 1 <= caps[k]]
    heapq.heapify(heap)
    left = seats - sum(given)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        given[k] += 1
        left -= 1
        if given[k] + 1 <= caps[k]:
            heapq.heappush(heap, (-votes[k] / (2 * given[k] + 1), k))
    return given


def sized(documents: DataFrame, name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens, order) of the documents that can be drawn; order is the seeded place."""
    d = documents.select("doc_id", "source", "text").where("source IS NOT NULL AND length(text) > 0")
    d = spread(d)
    d = d.select("doc_id", "source", token_counts(d, "text", "tokens", name, path))
    return d.withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))


def plan(shards: pd.DataFrame, targets: pd.DataFrame, blocks: int = BLOCKS) -> pd.DataFrame:
    """Quotas (mix_id, source, shard, blocks, block, cap, due) from shards (source, shard, tokens) and the targets.

    ``blocks`` is how many, ``block`` the tokens of one, ``due`` the share that is left to the source of those there are.
    """
    rows = []
    have = shards.groupby("source")["tokens"].sum()
    for mix, t in targets.groupby("mix_id", sort=True):
        if t["source"].duplicated().any():
            raise ValueError(f"mix {mix} names a source twice")
        t = t[(t["target_share"] > 0) & (t["max_repeats"] >= 1) & t["source"].isin(have.index[have > 0])].sort_values("source")
        if t.empty:
            continue
        share = (t["target_share"] / t["target_share"].sum()).tolist()
        room = (t["source"].map(have) * t["max_repeats"]).tolist()
        size = min(r / s for r, s in zip(room, share))
        block = max(1.0, size / blocks)
        seats = sainte_lague(share, int(size // block), [r // block for r in room])
        for source, n, cap, due in zip(t["source"], seats, t["max_repeats"], share):
            own = shards[shards["source"] == source].sort_values("shard")
            votes = own["tokens"].tolist()
            for shard, q in zip(own["shard"], sainte_lague(votes, n, [v * cap / block + 1 for v in votes])):
                rows.append((mix, source, int(shard), int(q), float(block), int(cap), float(due)))
    return pd.DataFrame(rows, columns=["mix_id", "source", "shard", "blocks", "block", "cap", "due"])


def _drawn(documents: DataFrame, targets: DataFrame, name: str, path: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (mix_id, source, doc_id, tokens, times), and the quotas."""
    d = materialise(sized(documents, name, path), "sized")
    totals = d.groupBy("source").agg(F.sum("tokens").alias("all"))
    count = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("all") / SHARD_TOKENS))).cast("int")
    # only sources named in a mix, of which there are as many as rows in the table of targets
    named = targets.select("source").where("source IS NOT NULL").distinct()
    totals = totals.join(F.broadcast(named), "source").withColumn("shards", count).select("source", "shards")
    d = d.where("tokens > 0").join(F.broadcast(totals), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.col("shards")).cast("int"))
    per_shard = d.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"))
    per_shard = materialise(per_shard, "shards")  # at most MOST_SHARDS rows of each source
    quotas = plan(per_shard.toPandas(), targets.dropna().toPandas(), blocks)
    q = documents.sparkSession.createDataFrame(quotas, "mix_id string, source string, shard int, blocks bigint, block double, cap int, due double")
    # where a document's middle lies in its shard, in seeded order
    by = W.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    placed = d.withColumn("middle", F.sum("tokens").over(by) - F.col("tokens") / 2).select("source", "shard", "doc_id", "tokens", "middle")
    own = q.join(per_shard.withColumnRenamed("tokens", "all"), ["source", "shard"])
    held = F.col("all") / F.col("block")  # the shard in blocks
    own = own.withColumn("turns", F.least(F.floor(F.col("blocks") / held), F.col("cap")).cast("int"))
    own = own.withColumn("rest", F.when(F.col("turns") < F.col("cap"), F.col("blocks") - F.col("turns") * held).otherwise(0.0))
    drawn = placed.join(F.broadcast(own.select("mix_id", "source", "shard", "block", "turns", "rest")), ["source", "shard"])
    times = F.col("turns") + (F.col("middle") / F.col("block") < F.col("rest")).cast("int")
    return drawn.withColumn("times", times).where("times > 0").select("mix_id", "source", "doc_id", "tokens", "times"), q


def draw(documents: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", path: str = TOKENIZERS, blocks: int = BLOCKS) -> DataFrame:
    """(mix_id, source, doc_id, tokens, times): the drawn documents of every mix."""
    return _drawn(documents, targets, name, path, blocks)[0]


def shares(documents: DataFrame, targets: DataFrame, name: str = "byte_bpe_50k", path: str = TOKENIZERS, blocks: int = BLOCKS) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, due_share, remark, docs, most_times, tokens, actual_share) of every target.

    ``due_share`` is the target among the sources that can give anything; ``remark`` says why it differs: ``absent`` for a
    source without tokens, ``void`` for a null or unusable target, ``raised`` where others' shares came to it.
    """
    drawn, quotas = _drawn(documents, targets, name, path, blocks)
    used = F.col("tokens") * F.col("times")
    sums = drawn.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("docs"), F.max("times").alias("most_times"), F.sum(used).alias("sum"))
    due = quotas.groupBy("mix_id", "source").agg(F.max("due").alias("due"))
    out = targets.select("mix_id", "source", "target_share", "max_repeats").join(sums, ["mix_id", "source"], "left").join(F.broadcast(due), ["mix_id", "source"], "left")
    out = out.withColumn("whole", F.sum("sum").over(W.partitionBy("mix_id")))  # over the few targets
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    void = F.col("source").isNull() | F.coalesce(F.col("target_share") <= 0, F.lit(True)) | F.coalesce(F.col("max_repeats") < 1, F.lit(True))
    remark = F.when(void, "void").when(F.col("due").isNull(), "absent").when(F.col("due") > F.col("target_share") + 1e-9, "raised").otherwise("")
    return out.select(
        "mix_id", "source", "target_share", "max_repeats", F.round(F.coalesce("due", F.lit(0.0)), 6).alias("due_share"), remark.alias("remark"),
        zero("docs").alias("docs"), zero("most_times").alias("most_times"), zero("sum").alias("tokens"),
        F.round(F.coalesce(F.col("sum") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"),
    )
