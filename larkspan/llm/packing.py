"""Filling containers of fixed capacity with texts of varying length."""

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import token_count
from larkspan.operators.numbering import dense_numbers, hash_key, prefix_length
from larkspan.session import materialise, small


class OpenBins:
    """Open bins by remaining capacity, under a segment tree of how many ranges each capacity has.

    Bins are kept as ranges of consecutive numbers that have the same remaining capacity, so the number
    of bins doesn't matter. `tightest` finds the least capacity that is large enough in logarithmic time.
    """

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.tree = [0] * (2 * self.leaves)
        self.ranges: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]

    def _add(self, remaining: int, by: int) -> None:
        i = remaining + self.leaves
        while i:
            self.tree[i] += by
            i //= 2

    def put(self, remaining: int, first: int, bins: int, front: bool = False) -> None:
        (self.ranges[remaining].appendleft if front else self.ranges[remaining].append)((first, bins))
        self._add(remaining, 1)

    def take(self, remaining: int) -> tuple[int, int]:
        self._add(remaining, -1)
        return self.ranges[remaining].popleft()

    def tightest(self, size: int) -> int | None:
        i = size + self.leaves
        if self.tree[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The best-fit-decreasing packing of `counts[size]` items per size, as rules.

    A rule (size, first, items, first_bin, per_bin) puts the items of that size with the numbers first to
    first + items - 1 into consecutive bins, per_bin into each. After an item went into the tightest bin,
    that bin is the tightest for the next item of the size for as long as it fits, so whole ranges of
    equally full bins are filled at once; the rules' number depends on the capacity, not on the items.
    """
    bins, rules, opened = OpenBins(capacity), [], 0
    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        if not 0 < size <= capacity:
            raise ValueError("sizes must lie between 1 and the capacity")
        left, item = counts[size], 0
        while left:
            remaining = bins.tightest(size)
            if remaining is None:
                remaining = capacity
                fits = capacity // size
                first, there = opened, -(-left // fits)
                opened += there
            else:
                fits = remaining // size
                first, there = bins.take(remaining)
            full = min(there, left // fits)
            if full:
                rules.append((size, item, full * fits, first, fits))
                bins.put(remaining - fits * size, first, full)
                item, left, first, there = item + full * fits, left - full * fits, first + full, there - full
            if there and left and left < fits:
                rules.append((size, item, left, first, left))
                bins.put(remaining - left * size, first, 1)
                item, left, first, there = item + left, 0, first + 1, there - 1
            if there:
                bins.put(remaining, first, there, front=True)
    return rules


def pieces(documents: DataFrame, document: str, size: Column, capacity: int) -> DataFrame:
    """Rows (document, piece_no, first_token, tokens): a text larger than the capacity is cut, no other.

    Its pieces are full containers but for the last. A text without tokens (or of null or negative size)
    is one piece of 0 tokens. Other columns are dropped.
    """
    sized = documents.select(F.col(document).alias(document), F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("bigint").alias("_size"))
    last = F.greatest(F.ceil(F.col("_size") / F.lit(float(capacity))) - 1, F.lit(0)).cast("bigint")
    cut = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece_no") * capacity
    return cut.select(document, "piece_no", start.alias("first_token"), F.least(F.col("_size") - start, F.lit(capacity)).alias("tokens"))


def pack(documents: DataFrame, document: str, size: Column, capacity: int, per_bucket: int | None = None) -> DataFrame:
    """Put every text into containers by best-fit decreasing: `pieces` plus `container`.

    The packing of all documents depends only on how many pieces have each size, a table of at most
    `capacity` rows. The driver packs that table and sends the rules back; each piece finds its container
    from its number among the pieces of its size, in an order by hash. Pieces of 0 tokens need no
    container and have null. The result is the same for every partitioning. Repeated rows and null ids
    are packed like others. An empty input gives an empty table.
    """
    spark = documents.sparkSession
    cut = materialise(pieces(documents, document, size, capacity))
    counts = {r["tokens"]: r["n"] for r in cut.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rules = spark.createDataFrame(best_fit_decreasing(counts, capacity), "_size bigint, _first bigint, _items bigint, _bin bigint, _per bigint")
    hashed = cut.withColumn("_order", hash_key(F.col(document), F.col("piece_no")))
    bucket = F.substring("_order", 1, prefix_length(max(counts.values(), default=0), **({"per_bucket": per_bucket} if per_bucket else {})))
    numbered = dense_numbers(hashed.filter("tokens > 0").withColumn("_bucket", bucket), ["tokens"], ["_bucket"], ["_order"], "_number")
    here = (F.col("tokens") == F.col("_size")) & (F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_first") + F.col("_items"))
    placed = numbered.join(small(rules), here).withColumn("container", (F.col("_bin") + F.floor((F.col("_number") - F.col("_first")) / F.col("_per"))).cast("bigint"))
    columns = [document, "piece_no", "first_token", "tokens", "container"]
    empty = cut.filter("tokens = 0").withColumn("container", F.lit(None).cast("bigint"))
    return placed.select(*columns).unionByName(empty.select(*columns))


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: pieces, tokens, containers, the least number that could do, and the share of space used."""
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    totals = per.agg(
        F.coalesce(F.sum("pieces"), F.lit(0)).alias("pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count("container").alias("containers"), F.coalesce(F.max(F.when(F.col("container").isNotNull(), F.col("tokens"))), F.lit(0)).alias("fullest"),
    )
    least = F.ceil(F.col("tokens") / F.lit(float(capacity)))
    return totals.select("pieces", "tokens", "containers", least.alias("least_containers"), "fullest", (F.col("tokens") / (F.col("containers") * capacity)).alias("used_share"))


def own_size(text: Column) -> Column:
    """Tokens of the project's own tokenizer."""
    return token_count(text)


def public_size(path: str):
    """A function from a text column to its length under a public tokenizer's JSON file at `path`."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for texts in batches:
            sizes = [len(e.ids) for e in tokenizer.encode_batch(texts.fillna("").tolist(), add_special_tokens=False)]
            yield pd.Series(sizes, dtype="int64")

    return count
