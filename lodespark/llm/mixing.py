"""Mixing sources to target shares by temperature, realised as budgeted block permutations.

A source's weight is its share of all tokens to the power of an exponent. Where shares are wanted, every source has its own exponent,
bisected until the power is the target: below 1 a source is weighed up, above 1 down. Where no shares are given, one exponent is
bisected for all until the weights have the target entropy. The size is the largest at which no source would have to be repeated more often
than allowed; if a larger one is wanted, the exponents are moved towards 1 (the shares as they are) by a factor that is bisected to
those repetition limits.

A source's budget is spent in whole passes over its texts and one part of a pass. The part is cut from a permutation (the order
of the texts' md5, salted by the seed) in two levels: blocks, the first digits of the order, are taken whole until one exceeds the
budget; only within that one texts are taken one by one. So no source passes through one task, however large it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.session import cut_lineage

TOKEN = r"\p{L}+|\p{Nd}+|[^\s\p{Z}\p{L}\p{Nd}]"
_BLOCK_DIGITS = 4  #: hex digits of the order that name a block: 65,536 a source
_MAX_SOURCES = 100_000


def source_name(source: Column) -> Column:
    """Sources that are written oddly: case, blanks and dashes do not count."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def token_count(text: Column) -> Column:
    """Runs of letters, runs of digits, and other single non-blank characters."""
    return F.regexp_count(text, F.lit(TOKEN))


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _normal(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total else weights


def _bisect(ok, rounds: int = 60) -> float:
    """The largest exponent in [0, 1] that is ``ok``, if 0 is."""
    if ok(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def temperature_weights(natural: dict[str, float], wanted: float) -> tuple[dict[str, float], float]:
    """Weights ``natural ** t`` with an entropy of ``wanted`` of the largest, and the exponent ``t``; 0 makes all sources equal."""
    natural = {k: v for k, v in natural.items() if v > 0}
    if len(natural) < 2:
        return _normal(natural), 1.0
    at = lambda t: _normal({k: v**t for k, v in natural.items()})
    t = _bisect(lambda x: entropy(at(x)) >= wanted * math.log(len(natural)))
    return at(t), t


def share_exponent(natural: float, target: float) -> float:
    """The exponent by which a share becomes the target share, by bisection; 1 where a share is all, which every exponent leaves alone."""
    if natural >= 1 or target <= 0:
        return 1.0
    high = 1.0
    while natural**high > target:
        high *= 2
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if natural**mid > target else (low, mid)
    return high


def mixture(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], total: float | None = None) -> tuple[dict[str, float], float, dict[str, float]]:
    """``weights, total, exponents`` for sources with targets.

    A source without tokens, or that may not be repeated, gets nothing, and its share falls to the others.
    """
    usable = {s: w for s, w in target.items() if w > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not usable:
        return {}, 0.0, {}
    room = {s: tokens[s] * repeats[s] for s in usable}
    natural, goal = _normal({s: float(tokens[s]) for s in usable}), _normal(usable)
    own = {s: share_exponent(natural[s], goal[s]) for s in usable}
    exponents = lambda t: {s: 1 - t + t * own[s] for s in usable}
    at = lambda t: _normal({s: natural[s] ** e for s, e in exponents(t).items()})
    most = lambda t: min(room[s] / w for s, w in at(t).items())
    t = 1.0 if total is None else _bisect(lambda t: most(t) * (1 + 1e-12) >= total)
    return at(t), most(t) if total is None else min(total, most(t)), exponents(t)


def distinct_texts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """``doc_id, source, tokens, text_hash`` of each distinct text of the given sources, under its least ``doc_id``.

    Texts without tokens, and null texts, ids or sources, are left out. A text that several sources share belongs to the
    source of its least id, so that it can't be used more often than one source may.
    """
    rows = docs.filter("doc_id is not null and text is not null and source is not null").select(
        "doc_id", source_name(F.col("source")).alias("source"), F.md5(F.encode("text", "UTF-8")).alias("text_hash"), token_count(F.col("text")).alias("tokens")
    )
    rows = rows.filter("tokens > 0").join(F.broadcast(sources.select("source").distinct()), "source", "left_semi")  # one row a source, checked by the caller
    once = rows.groupBy("text_hash").agg(F.min(F.struct("doc_id", "source")).alias("x"), F.max("tokens").alias("tokens"))
    return once.select("x.doc_id", "x.source", F.col("tokens").cast("long").alias("tokens"), "text_hash")


def mix_sources(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0, target_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``chosen(doc_id, source, tokens, repeats)`` and ``shares(source, target_share, exponent, budget_tokens, used_tokens, actual_share, available_tokens, n_texts, max_repeats, most_repeats)``.

    ``docs``: ``doc_id, text, source``; ``targets``: ``source, target_share, max_repeats``, one row a source. Other columns are
    ignored. Sources without a target are not used. The shares miss the targets by less than a text a source.

    With ``target_entropy`` (0 to 1, of the largest) no ``target_share`` is needed, and none is read: the weights are those of
    ``temperature_weights`` over all sources of ``targets``, and ``target_share`` of the result holds them.
    Empty tables give empty results.
    """
    if target_entropy is not None and not 0 <= target_entropy <= 1:
        raise ValueError("target_entropy must lie between 0 and 1")
    spark = docs.sparkSession
    goals = targets if target_entropy is None else targets.withColumn("target_share", F.lit(0.0))
    goals = goals.filter("source is not null and target_share is not null").select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"))
    goal_rows = goals.limit(_MAX_SOURCES + 1).collect()
    if len(goal_rows) > _MAX_SOURCES:
        raise ValueError(f"more than {_MAX_SOURCES} sources have targets")
    order = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), "text_hash"), "UTF-8"))
    texts = distinct_texts(docs, spark.createDataFrame([(r["source"],) for r in goal_rows], "source string"))
    texts = cut_lineage(texts.select("doc_id", "source", "tokens", order.alias("order")).withColumn("block", F.substring("order", 1, _BLOCK_DIGITS)))
    blocks = cut_lineage(texts.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")))
    sizes = {r["source"]: r for r in blocks.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()}
    have = {s: r["tokens"] for s, r in sizes.items()}
    limits, wanted = {r["source"]: r["max_repeats"] for r in goal_rows}, {r["source"]: r["target_share"] for r in goal_rows}
    exponent = 1.0
    if target_entropy is not None:
        wanted, exponent = temperature_weights({s: float(n) for s, n in have.items() if limits[s] > 0}, target_entropy)
    weights, size, exponents = mixture(have, wanted, limits, total if target_entropy is None else None)
    if target_entropy is not None:
        size = size if total is None else min(size, total)  # the entropy stays as asked for
        exponents = dict.fromkeys(weights, exponent)
    budget = {s: int(w * size + 1e-6) for s, w in weights.items()}
    plan = F.broadcast(spark.createDataFrame([(s, n // have[s], n % have[s]) for s, n in budget.items()], "source string, passes long, part long"))  # one row a source
    upto = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = blocks.join(plan, "source").withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    # The block in which the part of a pass ends: there is one, as the part is less than the whole.
    edge = ahead.filter("before + tokens > part").groupBy("source", "passes", "part").agg(F.min(F.struct("block", "before")).alias("e"))
    edge = F.broadcast(edge.select("source", "passes", "part", F.col("e.block").alias("edge"), "e.before"))  # one row a source
    placed = texts.join(edge, "source")
    outside = placed.filter("block != edge").select("doc_id", "source", "tokens", (F.col("passes") + (F.col("block") < F.col("edge")).cast("long")).alias("repeats"))
    within = Window.partitionBy("source").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.filter("block = edge").withColumn("upto", F.sum("tokens").over(within) + F.col("before"))
    inside = inside.select("doc_id", "source", "tokens", (F.col("passes") + (F.col("upto") <= F.col("part")).cast("long")).alias("repeats"))
    chosen = outside.unionByName(inside).filter("repeats > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"))
    shown = [(r["source"], float(wanted.get(r["source"], 0.0)), exponents.get(r["source"]), budget.get(r["source"], 0), have.get(r["source"], 0), sizes[r["source"]]["n"] if r["source"] in sizes else 0, r["max_repeats"]) for r in goal_rows]
    facts = spark.createDataFrame(shown, "source string, target_share double, exponent double, budget_tokens long, available_tokens long, n_texts long, max_repeats long")
    everything = Window.partitionBy()  # one row a source
    shares = facts.join(used, "source", "left").withColumn("used_tokens", F.coalesce("used_tokens", F.lit(0).cast("long")))
    actual = F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(everything)), F.lit(0.0))
    shares = shares.select(
        "source", "target_share", "exponent", "budget_tokens", "used_tokens", actual.alias("actual_share"), "available_tokens", "n_texts", "max_repeats", F.coalesce("most_repeats", F.lit(0).cast("long")).alias("most_repeats")
    )
    return chosen, shares
