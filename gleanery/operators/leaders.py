"""Greedy leader clustering of keys, in blocks, with the result of the one-by-one loop.

In rank order a key joins the lowest-ranked leader it is similar to, or becomes a leader.
A block is the next open keys in rank order: nothing before it covers them, so that loop
goes through them alone.  Later open keys then look for their lowest leader among
the new ones.  What finds one is assigned for good, because all leaders before those were
looked at already, and is compared no more.  So a key meets the leaders up to its own and no
other key, as in the loop.  Blocks grow up to a bound, slowly while their leaders cover many
keys each: there open keys are soon few.

One task goes through a small block.  A larger one is cut into parts in rank order, and the loop
goes through each for itself.  The leaders of the parts are all compared with each other, which
settles who of them leads, if nobody else does, and the others of the block look for the lowest
of those.  The loop's leaders are the only keys of which no two are similar and that cover
all others from before; so if all find one, these are they.  One that finds none, because its
leader was covered itself, is taken to those that may lead, and they are settled anew.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators.similarity import THRESHOLD, nearest, one_by_one, profile, settled, similar_pairs
from gleanery.session import Scratch

FEW = 1024  # keys of the first block
LEAST = 10_000  # keys of a block up to which one task goes through them
MOST = 50_000  # keys of a part of a block at most: one task holds them, whatever the number of keys
PARTS = 16  # of a block at most
DENSE = 8  # mean number of a block's keys that follow one leader from which on the next block grows slowly
SLOW, FAST = 2, 64  # growth of blocks


def rank_keys(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(kid, key, rank): distinct keys, numbered in rank order.

    Equal keys always follow the same leader, so only the first of each goes on.  The
    numbers come from a range-partitioned sort and are fixed by writing them.
    """
    first = keyed.groupBy("key").agg(F.min("rank").alias("rank"))
    return scratch.save(
        first.orderBy("rank").withColumn("kid", F.monotonically_increasing_id()), "keys"
    )


def assign_leaders(keys: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(kid, leader) for every key; a leader is its own."""
    open_keys = scratch.save(profile(keys.select("kid", "key"), threshold), "profile")
    parts = [open_keys.limit(0).select("kid", F.col("kid").alias("leader"))]
    size, wanted = open_keys.count(), max(FEW, 1)
    while size:
        block, later = open_keys, None
        if size > wanted:
            last = open_keys.select("kid").orderBy("kid").limit(wanted).agg(F.max("kid")).first()[0]
            block, later = open_keys.where(F.col("kid") <= last), open_keys.where(F.col("kid") > last)
        decided = _decided(block, min(size, wanted), scratch, threshold)
        parts.append(decided)
        if later is None:
            break
        leading = decided.where(F.col("kid") == F.col("leader")).select("kid")
        leaders = scratch.save(block.join(leading, "kid", "left_semi"), "leaders")
        covered = scratch.save(nearest(later, leaders, threshold), "covered")
        parts.append(covered)
        open_keys = scratch.save(later.join(covered, "kid", "left_anti"), "open")
        growth = SLOW if wanted >= DENSE * leaders.count() else FAST
        wanted = max(min(wanted * growth, MOST * PARTS), 1)
        size = open_keys.count()
    return scratch.save(_union(parts), "assignment")


def _decided(block: DataFrame, size: int, scratch: Scratch, threshold: float) -> DataFrame:
    """(kid, leader) of a block that nothing before it covers."""
    parts = min(math.ceil(size / LEAST), PARTS)
    if parts < 2:
        return scratch.save(one_by_one(block, threshold), "block")
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    ends = block.agg(F.percentile_approx("kid", shares, F.lit(100_000))).first()[0]
    part = F.lit(0)
    for end in ends:
        part = part + (F.col("kid") > end).cast("int")
    alone = scratch.save(one_by_one(block, threshold, part, parts), "alone")
    may_lead = scratch.save(block.join(alone.where(F.col("kid") == F.col("leader")).select("kid"), "kid", "left_semi"), "may_lead")
    others = scratch.save(block.join(may_lead.select("kid"), "kid", "left_anti"), "others")
    pairs = scratch.save(similar_pairs(may_lead.withColumn("is_target", F.lit(True)), may_lead, threshold), "pairs")
    covered = scratch.save(settled(pairs), "settled")
    leaders = scratch.save(may_lead.join(covered, "kid", "left_anti"), "leading")
    found = scratch.save(nearest(others, leaders, threshold), "found")
    while True:
        lost = scratch.save(others.join(found, "kid", "left_anti"), "lost")
        if lost.isEmpty():
            break
        others = scratch.save(others.join(found, "kid", "left_semi"), "others")
        may_lead = scratch.save(may_lead.withColumn("is_target", F.lit(False)).unionByName(lost.withColumn("is_target", F.lit(True))), "may_lead")
        pairs = scratch.save(pairs.unionByName(similar_pairs(may_lead, lost, threshold)), "pairs")
        may_lead = may_lead.drop("is_target")
        covered, before = scratch.save(settled(pairs), "settled"), leaders
        leaders = scratch.save(may_lead.join(covered, "kid", "left_anti"), "leading")
        # a leader that leads still was the lowest of those before: only the new ones can be lower
        kept = found.join(leaders.select(F.col("kid").alias("leader")), "leader", "left_semi").select("kid", "leader")
        loose = scratch.save(others.join(kept.select("kid"), "kid", "left_anti"), "loose")
        new = scratch.save(leaders.join(before.select("kid"), "kid", "left_anti"), "new")
        again = kept.unionByName(nearest(loose, leaders, threshold)).unionByName(nearest(others, new, threshold))
        found = scratch.save(again.groupBy("kid").agg(F.min("leader").alias("leader")), "found")
    leading = leaders.select("kid", F.col("kid").alias("leader"))
    return scratch.save(_union([leading, covered, found]), "block")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
