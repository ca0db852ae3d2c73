"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are dealt to parts by a hash of their values. How many rows each part sends to
each block of each shard is drawn beforehand, so that it has the law of a uniform
shuffle and the shards get exactly their sizes: row by row of the matrix, a multivariate
hypergeometric draw from what the blocks still lack. Each part then permutes its rows
and sends runs of them, and each block permutes what it gets. Only the matrix, whose
size is bounded, passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

SHARDS = 16
#: Rows of a part and of a block to aim at, and how many of either there may be.
ROWS, PARTS, BLOCKS = 1_000_000, (32, 4096), 64
#: Bits of a hash whose ranges a part or block is ordered in where it has more rows than that.
SPLIT_BITS = 12


def _stirling_error(n: int) -> float:
    """ln n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _deviance(x: float, mean: float) -> float:
    """x ln(x / mean) + mean - x, exact also where x is close to a large mean."""
    v = (x - mean) / (x + mean)
    if abs(v) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, j = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        more = total + term / (2 * j + 1)
        if more == total:
            return total
        total, j = more, j + 1


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """ln of the probability of x successes among n by the saddle-point form, which keeps its precision for any n."""
    if x == 0 or x == n:
        return n * math.log1p(-p if x == 0 else -q) if n else 0.0
    errors = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
    return errors - _deviance(x, n * p) - _deviance(n - x, n * q) - 0.5 * math.log(2 * math.pi * x * (n - x) / n)


def log_hypergeometric(k: int, good: int, bad: int, n: int) -> float:
    """ln of the probability that k of n rows drawn from good + bad are good, but for a constant; 0 < n < good + bad."""
    p, q = n / (good + bad), (good + bad - n) / (good + bad)
    return _log_binomial(k, good, p, q) + _log_binomial(n - k, bad, p, q)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good, by the exact law at any size.

    Rejection by the ratio of uniforms under Stadlober's universal hat: the number of
    tries doesn't grow with the counts.
    """
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    if low == high:
        return low
    share = good / total
    mean = n * share
    spread = mean * (1 - share) * (total - n) / (total - 1)
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    top = log_hypergeometric((n + 1) * (good + 1) // (total + 2), good, bad, n)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_hypergeometric(k, good, bad, n) - top:
            return k


def _draw(rng: np.random.Generator, lacking: list[int], n: int) -> list[int]:
    """Counts of n rows over cells that lack so many: multivariate hypergeometric, cell by cell."""
    out, total = [], sum(lacking)
    for good in lacking:
        total -= good
        out.append(hypergeometric(rng, good, total, n))
        n -= out[-1]
    return out


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows part p sends to cell c, for parts of counts rows and cells of sizes rows."""
    rng = np.random.default_rng(seed)
    lacking = [int(x) for x in sizes]
    rows = []
    for n in counts:
        rows.append(_draw(rng, lacking, int(n)))
        lacking = [a - b for a, b in zip(lacking, rows[-1], strict=True)]
    return np.array(rows, np.int64).reshape(len(counts), len(sizes))


def split(n: int, ways: int) -> list[int]:
    return [n // ways + (k < n % ways) for k in range(ways)]


def _ranked(rows: DataFrame, keys: tuple[str, ...], seed: int, each: int) -> DataFrame:
    """rows (row, number, ...) with rank, from 0 within keys, in the order of a hash.

    Where keys have each rows, more than a task should order, ranges of the hash are
    counted and then ordered one by one.
    """
    bits = min((max(1, -(-each // ROWS)) - 1).bit_length(), SPLIT_BITS)
    rows = rows.withColumn("turn", F.xxhash64(F.lit(seed), "row", "number"))
    if not bits:
        order = Window.partitionBy(*keys).orderBy("turn", "number")
        return rows.withColumn("rank", F.row_number().over(order) - 1).drop("turn")
    rows = rows.withColumn("range", F.shiftrightunsigned("turn", 64 - bits).cast("int"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "range").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    order = Window.partitionBy(*keys, "range").orderBy("turn", "number")
    return rows.join(counts, [*keys, "range"]).withColumn("rank", F.col("earlier") + F.row_number().over(order) - 1).drop("turn", "range", "earlier")


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 1, parts: int | None = None, blocks: int | None = None) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    Shard sizes differ by one row at most; every assignment is as likely as any other up
    to the hash that orders the rows. Rows are told apart by their values and their place
    in what is written first, so that equal rows, however many, are dealt like any others. An empty df gives an empty result. Columns
    named shard or slot are replaced; all others pass through. df is written to the
    shared folder once, so that a lost executor can't change what was counted.
    """
    own = [c for c in df.columns if c not in ("shard", "slot")]
    #: One struct, so that no name of a column meets one of ours.
    df = stage_table(df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), F.monotonically_increasing_id().alias("number")), "rows")
    total = df.count()
    parts = parts or min(max(-(-total // ROWS), PARTS[0]), PARTS[1])
    blocks = blocks or min(max(-(-total // (ROWS * shards)), 1), BLOCKS)
    dealt = df.withColumn("part", F.pmod(F.xxhash64(F.lit(seed), "row", "number"), F.lit(parts)).cast("int"))
    counts = [0] * parts
    for r in dealt.groupBy("part").count().collect():
        counts[r["part"]] = r["count"]
    sizes = [b for s in split(total, shards) for b in split(s, blocks)]
    ends = np.cumsum(communication_matrix(counts, sizes, seed), axis=1)
    bounds = df.sparkSession.createDataFrame([(p, e.tolist()) for p, e in enumerate(ends)], "part int, ends array<long>")
    sent = _ranked(dealt, ("part",), seed + 1, -(-total // parts)).join(bounds, "part")
    sent = sent.withColumn("cell", F.size(F.filter("ends", lambda e: e <= F.col("rank"))))
    sent = sent.withColumn("shard", F.floor(F.col("cell") / blocks).cast("int")).withColumn("block", F.col("cell") % blocks)
    arrived = _ranked(sent.select("row", "number", "shard", "block"), ("shard", "block"), seed + 2, -(-total // (shards * blocks)))
    size = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    base = F.col("block") * F.floor(size / blocks) + F.least(F.col("block").cast("long"), size % blocks)
    return arrived.select("row", "shard", (base + F.col("rank")).cast("long").alias("slot")).select("row.*", "shard", "slot")
