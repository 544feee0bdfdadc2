"""Mixing documents of several sources so that each source has its target share of all tokens."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import stripped
from larkspan.operators.numbering import dense_numbers, hash_key, prefix_length
from larkspan.session import materialise

#: Cells (source, language, topic) and target sources that fit on the driver; more of either raise an error.
MOST_CELLS = 100_000
ROUNDS = 200
CLOSE = 1e-10


def source_key(source: Column) -> Column:
    """Lower case, no blanks around, each run of blanks or hyphens inside as one underscore."""
    return F.regexp_replace(F.lower(stripped(source)), r"[\s -]+", "_")


def language_key(language: Column, known: tuple[str, ...] = ("en", "de", "fr", "es")) -> Column:
    """The language without case and suffix; `other` if it isn't among the known ones, `unknown` for null, blank or `und`."""
    plain = F.substring_index(F.substring_index(F.lower(stripped(language)), "-", 1), "_", 1)
    return F.when(plain.isin(*known), plain).when(plain.isNull() | plain.isin("", "und"), F.lit("unknown")).otherwise(F.lit("other"))


def scaled_to(target: float, tokens: np.ndarray, weights: np.ndarray, cap: float) -> np.ndarray:
    """Weights in proportion to `weights`, none above `cap`, whose weighted tokens sum to `target`.

    Where even the cap can't reach the target, all weights are the cap.
    """
    if tokens.sum() * cap <= target:
        return np.full(len(tokens), cap)
    scaled, free = np.minimum(weights, cap), np.ones(len(tokens), dtype=bool)
    while True:
        rest = target - (tokens[~free] * cap).sum()
        scaled = np.where(free, weights * rest / max((tokens[free] * weights[free]).sum(), 1e-300), cap)
        over = free & (scaled > cap)
        if not over.any():
            return scaled
        free &= ~over


class Raked(NamedTuple):
    """Weights per cell, the rounds taken, and the largest change of a weight in the last one (relative to the largest weight)."""

    weights: np.ndarray
    rounds: int
    change: float


def rake(cells: list[tuple[str, str, str, int]], shares: dict[str, float], caps: dict[str, int], total: int) -> Raked:
    """Iterative proportional fitting of token weights per cell (source, language, topic, tokens).

    The marginals are the sources' targets (as far as their caps allow), and the languages' and topics'
    shares in the documents at hand. A source's weights never exceed its cap. Each round fits language,
    topic, then source; so the sources' targets hold in the end, the others as nearly as caps allow.
    """
    tokens = np.array([c[3] for c in cells], dtype=np.float64)
    weights = np.ones(len(cells))
    axes = [np.unique([c[i] for c in cells], return_inverse=True) for i in (1, 2)]
    groups = {s: np.array([i for i, c in enumerate(cells) if c[0] == s], dtype=int) for s in shares}
    goal = {s: min(shares[s] * total, caps[s] * tokens[g].sum()) for s, g in groups.items()}
    wanted = sum(goal.values())
    if not len(cells) or wanted <= 0:
        return Raked(np.zeros(len(cells)), 0, 0.0)
    change, rounds = np.inf, 0
    while change >= CLOSE and rounds < ROUNDS:
        before = weights
        for names, at in axes:
            now = np.bincount(at, weights=tokens * weights, minlength=len(names))
            aim = np.bincount(at, weights=tokens, minlength=len(names)) * wanted / tokens.sum()
            weights = weights * np.divide(aim, now, out=np.ones(len(names)), where=now > 0)[at]
        weights = weights.copy()
        for s, g in groups.items():
            if len(g):
                weights[g] = scaled_to(goal[s], tokens[g], weights[g], caps[s]) if goal[s] > 0 else 0.0
        change, rounds = float(np.abs(weights - before).max() / max(1.0, weights.max())), rounds + 1
    return Raked(weights, rounds, change)


class Mixture(NamedTuple):
    """What `mix` returns."""

    uses: DataFrame
    report: DataFrame
    marginals: DataFrame


def mix(documents: DataFrame, targets: DataFrame) -> Mixture:
    """Mix documents (document, source, language, topic, tokens) to targets (source, target_share, max_repeats).

    `uses` has a row per document of a target source: how often it is used, at most `max_repeats` times.
    A source's documents are drawn systematically, each with its cell's weight from `rake`: cell after cell, ordered
    by length, rising in one cell and falling in the next. So documents that meet have like lengths, and the drawn
    tokens of a source differ from the wanted ones by about one document. `report` has a
    row per target source: documents, available, wanted, raked and reached tokens, the share reached, and
    `short` where the raked weights fall short of `target_share` of the tokens of all documents of target
    sources, as the caps then do. `marginals` has a row per axis (source, language, topic) and value: wanted, raked
    and reached tokens, the rounds of raking, and whether it `converged`; where it didn't, the source's
    tokens still are as raked, the languages' and topics' as near as the rounds came. Documents of other
    or null sources take no part. Sources compare as given (see `source_key`); of a repeated target the
    least share counts, a null share is 0, a null `max_repeats` 1. Without documents every share reached
    is null.
    """
    spark = documents.sparkSession
    goals = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(
        F.coalesce(F.min("target_share"), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce(F.min("max_repeats"), F.lit(1)), F.lit(0)).cast("int").alias("max_repeats"),
    )
    goals = materialise(goals)
    wanted = _bounded(goals, "target sources")
    goals = F.broadcast(goals)  # bounded by that
    sized = materialise(documents.select("document", "source", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("topic", F.lit("none")).alias("topic"), "tokens").join(goals, "source", "left_semi"))
    cells = sized.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    known = _bounded(cells, "cells of source, language and topic")
    known.sort(key=lambda r: (r["source"], r["language"], r["topic"]))
    total = sum(r["tokens"] for r in known)
    raked = rake(
        [(r["source"], r["language"], r["topic"], r["tokens"]) for r in known],
        {r["source"]: r["target_share"] for r in wanted}, {r["source"]: r["max_repeats"] for r in wanted}, total,
    )
    planned, before, cells_before = [], {}, {}
    for r, w in zip(known, raked.weights, strict=True):
        source = r["source"]
        start = before.get(source, int(hashlib.sha256(source.encode()).hexdigest()[:8], 16) / 2.0**32)
        falling = cells_before.get(source, 0) % 2 == 1
        planned.append((source, r["language"], r["topic"], float(w), float(w) * r["tokens"], start, falling, r["n"]))
        before[source], cells_before[source] = (start + float(w) * r["n"]) % 1.0, cells_before.get(source, 0) + 1
    drawn = spark.createDataFrame(planned, "_source string, _language string, _topic string, weight double, raked double, start double, falling boolean, cell_size bigint")
    cell = ["source", "language", "topic"]
    # Documents of a length are cut by hash, so that copies of one text don't meet in one task.
    prefix = F.substring("_order", 1, prefix_length(sum(r["n"] for r in known)))
    hashed = sized.withColumn("_order", hash_key(F.col("document"))).withColumn("_prefix", prefix)
    placed = dense_numbers(hashed, cell, ["tokens", "_prefix"], ["_order"], "_number")
    same = (F.col("source") == F.col("_source")) & (F.col("language") == F.col("_language")) & (F.col("topic") == F.col("_topic"))
    place = F.when(F.col("falling"), F.col("cell_size") - 1 - F.col("_number")).otherwise(F.col("_number"))
    upto = lambda n: F.floor(n * F.col("weight") + F.col("start"))
    uses = (
        placed.join(F.broadcast(drawn), same)  # at most MOST_CELLS rows
        .join(goals.select("source", "max_repeats"), "source")
        .select("document", "source", "language", "topic", "tokens", F.least(upto(place + 1) - upto(place), F.col("max_repeats")).cast("int").alias("uses"))
    )
    per_cell = uses.groupBy(*cell).agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("tokens") * F.col("uses")).alias("reached_tokens"))
    told = drawn.select(*[F.col(f"_{c}").alias(c) for c in cell], "raked")
    totals = per_cell.join(F.broadcast(told), cell)
    reached = totals.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum("available_tokens").alias("available_tokens"), F.sum("reached_tokens").alias("reached_tokens"), F.sum("raked").alias("raked_tokens"))
    report = goals.join(reached, "source", "left").na.fill(0, ["documents", "available_tokens", "reached_tokens", "raked_tokens"])
    everything = report.agg(F.sum("reached_tokens").alias("_reached"))  # one row
    aim = F.col("target_share") * F.lit(float(total))
    # The raked tokens tell; an exact comparison settles what lies within their rounding.
    exact = F.col("max_repeats") * F.col("available_tokens") < aim
    short = F.when(F.col("raked_tokens") < aim * (1 - 1e-9), F.lit(True)).otherwise(exact)
    report = report.join(F.broadcast(everything)).select(
        "source", "target_share", "max_repeats", "documents", "available_tokens", aim.alias("target_tokens"), "raked_tokens", "reached_tokens",
        F.when(F.col("_reached") > 0, F.col("reached_tokens") / F.col("_reached")).alias("reached_share"), short.alias("short"),
    )
    axis = F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("value")) for c in cell])).alias("at")
    sides = totals.select(axis, "available_tokens", "raked", "reached_tokens").groupBy("at.axis", "at.value").agg(
        F.sum("available_tokens").alias("available_tokens"), F.sum("raked").alias("raked_tokens"), F.sum("reached_tokens").alias("reached_tokens"))
    aims = goals.select(F.col("source").alias("value"), F.lit("source").alias("axis"), aim.alias("aim"))
    planned_tokens = float(sum(w * r["tokens"] for r, w in zip(known, raked.weights, strict=True)))
    share = F.lit(planned_tokens / total if total else 0.0)
    marginals = sides.join(aims, ["axis", "value"], "left").select(
        "axis", "value", "available_tokens", F.coalesce("aim", share * F.col("available_tokens")).alias("wanted_tokens"), "raked_tokens", "reached_tokens",
        F.lit(raked.rounds).alias("rounds"), F.lit(raked.change < CLOSE).alias("converged"),
    )
    return Mixture(uses, report, marginals)


def _bounded(rows: DataFrame, what: str) -> list:
    found = rows.limit(MOST_CELLS + 1).collect()  # bounded by the check that follows
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} {what}")
    return found
