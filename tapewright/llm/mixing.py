"""Problem 7: sources combined in target shares, by a low-discrepancy schedule over blocks of equal tokens."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.ranks import RUN, running
from tapewright.llm.tokens import RANKS, token_count
from tapewright.operators.stage import Stage

#: Tokens of a block, eight containers of 4,096.
BLOCK = 32_768
#: Slots whose ranks one task counts.
SLOTS = 65_536
GOLDEN = (math.sqrt(5) - 1) / 2
SEED = "mix"


def quotas(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, tuple[int, int]]:
    """Of each source, how many whole passes the largest collection takes and how many tokens of one more.

    The source that first runs out, ``available`` tokens times ``repeats`` for its share, sets the size.
    """
    targets = {s: (Fraction(w), r) for s, (w, r) in targets.items() if w and w > 0}
    whole = sum(w for w, _ in targets.values())
    if not targets:
        return {}
    size = min(Fraction(available.get(s, 0) * max(0, r or 0)) * whole / w for s, (w, r) in targets.items())
    out = {}
    for s, (w, _) in targets.items():
        want = size * w / whole
        have = available.get(s, 0)
        out[s] = (int(want // have), int(want - want // have * have)) if have and size else (0, 0)
    return out


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, tokenizer: str = RANKS, stage: Stage | None = None) -> DataFrame:
    """``key``, ``source``, n_tokens, pass_no, slot: every use of a document, and the slot of the schedule it falls in.

    The collection is the largest in which each source has its ``target_share`` of the tokens (shares are taken relative
    to their sum) and no document is used more than ``max_repeats`` times: whole passes over a source, and of one more
    pass the documents, in shuffled order, whose middle lies within the quota, so each source is within half a document
    of its share. Each pass is shuffled anew by hash, cut into blocks of ``block`` tokens (a document belongs to the block
    in which it starts), and the source's blocks, in order, take its slots: slot i goes to the source in whose interval of
    cumulative shares the fraction of i times the golden ratio falls.

    Documents without tokens (null and empty texts), of null sources, and of sources without a target are not used. If a
    source with a share has no tokens or may not be used, no collection has the shares, and the result is empty. Of
    repeated target rows the shares add up and the smallest ``max_repeats`` holds. Repeated documents count as documents
    each. ``targets`` has a row for each source, a few whatever the size of the collection.
    """
    spark = docs.sparkSession
    stage = stage or Stage(spark, "mix")
    n = token_count(F.col(text), tokenizer)
    sized = stage.put(docs.select(F.col(key).alias("k"), F.col(source).alias("s"), n.alias("n")).filter("s is not null")).filter("n > 0")
    goal = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").alias("w"), F.min("max_repeats").alias("r"))
    have = sized.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = goal.join(have, goal["source"] == have["s"], "left").orderBy("source").collect()
    tokens = {r["source"]: r["tokens"] or 0 for r in plan}
    passes = quotas(tokens, {r["source"]: (r["w"], r["r"]) for r in plan})
    if not any(full or rest for full, rest in passes.values()):
        passes = {}
    number = {r["source"]: r["docs"] or 0 for r in plan}
    rows = [(s, p, tokens[s] if p < full else rest, -(-number[s] // RUN)) for s, (full, rest) in passes.items() for p in range(full + (rest > 0))]
    use = spark.createDataFrame(rows, "s string, pass_no int, quota bigint, runs bigint")
    uses = sized.join(use, "s")  # a few rows of known size: Spark broadcasts them if they are few enough
    uses = stage.put(uses.withColumn("h", F.xxhash64(F.lit(SEED), "pass_no", "k")))
    # runs of equal hash range, so that running totals follow the shuffled order
    run = F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * F.col("runs")).cast("bigint")
    placed = running(uses, ["s", "pass_no"], ["h", "k"], run, F.col("n"), "start")
    placed = placed.filter(2 * F.col("start") + F.col("n") <= 2 * F.col("quota"))
    length = {s: full * tokens[s] + rest for s, (full, rest) in passes.items()}
    first = F.lit(0).cast("bigint")
    for s in length:
        first = F.when(F.col("s") == s, F.lit(tokens[s]).cast("bigint")).otherwise(first)
    placed = placed.withColumn("rank", F.floor((F.col("pass_no") * first + F.col("start")) / block).cast("bigint"))
    out = placed.join(schedule(spark, length, block, stage), ["s", "rank"])
    return out.select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("n_tokens"), "pass_no", "slot")


def schedule(spark, length: dict[str, int], block: int, stage: Stage) -> DataFrame:
    """s, rank, slot: the slot of each source's rank-th block, for sources of so many tokens.

    So many slots are drawn that every source gets its blocks: in any run of m golden-ratio points an interval gets its
    share of m less at most 2 (0.7 ln m + 2). Ranks are counted in chunks of slots, not a source at a time.
    """
    total = sum(length.values())
    if not total:
        return spark.createDataFrame([], "s string, rank bigint, slot bigint")
    least = min(x for x in length.values() if x) / total
    m = -(-total // block)
    m += math.ceil((2 * (0.7 * math.log(2 * m + 100 / least) + 2) + 2) / least)
    u = F.col("id") * F.lit(GOLDEN) + 0.5
    u = u - F.floor(u)
    s, upto = F.lit(None).cast("string"), total
    for name in reversed(list(length)):
        s = F.when(u < upto / total, F.lit(name)).otherwise(s) if length[name] else s
        upto -= length[name]
    slots = stage.put(spark.range(m).select(F.coalesce(s, F.lit(max(length, key=length.get))).alias("s"), F.col("id").alias("slot")))
    ranked = running(slots, ["s"], ["slot"], F.floor(F.col("slot") / SLOTS), F.lit(1), "rank")
    return ranked.select("s", "rank", "slot")


def _inputs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/mix_targets.parquet")


def p7_documents(spark, sf_dir: str) -> DataFrame:
    """The chosen documents, how often each is used, and where in the schedule."""
    stage = Stage(spark, "p7")
    uses = mix(*_inputs(spark, sf_dir), stage=stage)
    out = uses.groupBy("doc_id", "source", "n_tokens").agg(F.count(F.lit(1)).alias("repeats"), F.array_join(F.array_sort(F.collect_list("slot")), ",").alias("slots"))
    return stage.finish(out)


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """Target and reached share of each source, its tokens, documents and most repeats."""
    docs, targets = _inputs(spark, sf_dir)
    stage = Stage(spark, "p7")
    once = mix(docs, targets, stage=stage).groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    by = once.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most_repeats"))
    total = by.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share").join(by, "source", "left").join(F.broadcast(total))
    return stage.finish(out.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("total"), 6).alias("share")))
