"""Scoring texts by context-tree weighting over bytes, and by word frequencies.

A byte is coded as eight binary decisions. Each decision has a tree of contexts, the 0
to DEPTH bytes before; a context holds how often the decision fell either way in the
training texts. With the Krichevsky-Trofimov estimate at a context and the product of
what its longer contexts give, the weighted probability is the mean of the two, from the
longest contexts up to the empty one. A text is scored with the mixture that results
from training: at each context the estimate and the longer context's answer are mixed
by their posterior weights. A context that training never saw has no answer, and the
longest seen one answers alone. A text ends with a byte that UTF-8 never has, so that
probabilities add up to one over all texts.

The tree is whole at any size. A gram is a byte with the DEPTH bytes before it. Counted
grams are dealt by their SPLIT nearest context bytes, so that every longer context's
part of the tree lies in one task, which works in runs of bounded size. The contexts
shorter than that, 256 ** (SPLIT - 1) at most, are joined on the driver and sent back.
So every gram that occurs gets its exact score. The most frequent ones go to the tasks
in two tables of fixed size; texts hand out those of their grams and words that are not
there, and these are joined with the whole tables of scores and counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, stage_table, text_buffers, word_hashes

DEPTH, SPLIT = 5, 3
#: Words and grams that are sent to the tasks at most, and slots of each of the two tables of grams.
WORDS, GRAMS, SLOTS = 1 << 18, 1 << 20, 1 << 20
#: Grams that a run has, unless one short context has more.
RUN = 500_000
_END = 0xFF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_KEY = np.int64(-1)


def byte_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the lower-cased texts and of their ends with the DEPTH bytes before it, and where texts begin.

    A gram is one number: the nearest byte before first, the byte itself last.
    """
    n, sizes = len(offsets) - 1, np.diff(offsets)
    padded = np.zeros(len(data) + n * (DEPTH + 1), np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(n) * (DEPTH + 1) + DEPTH, sizes)] = _LOWER[data]
    padded[np.cumsum(sizes + DEPTH + 1) - 1] = _END
    wide = padded.astype(np.int64)
    grams = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        grams |= wide[DEPTH - k : len(wide) - k] << (8 * (DEPTH + 1 - k))
    starts = np.append(0, np.cumsum(sizes + 1))
    return grams[np.arange(starts[-1]) + np.repeat(np.arange(n) * DEPTH, sizes + 1)], starts


class _Counter:
    """Counts of numbers in bounded memory: merged whenever many have come together."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(np.unique(keys, return_counts=True))
        self.held += len(self.parts[-1][0])
        if self.held > 4_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        counts = np.concatenate([p[1] for p in self.parts]) if self.parts else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.parts = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]
        self.held = len(first)
        return self.parts[0]


#: Kinds of counted keys.
_WORD, _GRAM, _TEXTS = 0, 1, 2
_COUNTED = "kind int, key long, n long, other long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and grams of (text, learn): n counts those to learn from, other the rest."""
    words, grams, texts = _Counter(), (_Counter(), _Counter()), 0
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            learn = batch.column(1).to_numpy(zero_copy_only=False)
            texts += int(learn.sum())
            for lo, hi in slices(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                found, starts = byte_grams(part, own)
                learned = np.repeat(learn[lo:hi], np.diff(starts))
                grams[0].add(found[learned])
                grams[1].add(found[~learned])
                hashes, counts = word_hashes(part, own)
                words.add(hashes[np.repeat(learn[lo:hi], counts)].view(np.int64))
    for kind, column, (keys, counts) in ((_WORD, 0, words.merge()), (_GRAM, 0, grams[0].merge()), (_GRAM, 1, grams[1].merge()), (_TEXTS, 0, (np.zeros(1, np.int64), np.array([texts])))):
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            both = [np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)]
            both[column] = counts[k : k + 100_000].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), *map(pa.array, both)], ["kind", "key", "n", "other"])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1/2: Stirling's series at x + 6."""
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


class Level:
    """One decision's contexts of one depth: keys (the context, then the bits decided before), counts, weights."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, longer: np.ndarray | None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        own = estimate(zeros, ones)
        self.one = (ones + 0.5) / (zeros + ones + 1)
        if longer is None:
            self.weighted, self.stay = own, np.ones(len(keys))
        else:
            self.weighted = np.logaddexp(own, longer) - math.log(2)
            self.stay = 1 / (1 + np.exp(np.clip(longer - own, -700, 700)))

    def shorter(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, zeros, ones and the longer contexts' weighted probability one byte shorter; self.up tells each key's place there."""
        keys, self.up = np.unique((self.keys >> (bit + 8)) << bit | self.keys & ((1 << bit) - 1), return_inverse=True)
        return keys, *(np.bincount(self.up, x, len(keys)) for x in (self.zeros, self.ones, self.weighted))

    def answer(self, before: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """before is what shorter contexts give, mass what they leave; sets the probability of a one where this is the longest."""
        self.longest = before + mass * self.one
        return before + mass * self.stay * self.one, mass * (1 - self.stay)


def _deepest(grams: np.ndarray, n: np.ndarray, bit: int) -> Level:
    """The longest contexts' level from sorted grams."""
    keys = grams >> (8 - bit)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    one = (grams >> (7 - bit)) & 1
    return Level(keys[first], np.add.reduceat(n * (1 - one), first).astype(np.float64), np.add.reduceat(n * one, first).astype(np.float64), None)


def _climb(grams: np.ndarray, n: np.ndarray, bit: int) -> tuple[list[Level], tuple]:
    """Levels from DEPTH to SPLIT of grams that have all of their contexts of SPLIT bytes, and what goes to the next."""
    levels = [_deepest(grams, n, bit)]
    while True:
        up = levels[-1].shorter(bit)
        if len(levels) == DEPTH - SPLIT + 1:
            return levels, up
        levels.append(Level(*up))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted grams in runs of whole contexts of SPLIT bytes."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(h[0]) for h in held) >= RUN:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            end = int(np.searchsorted(columns[0], columns[0][-1] >> (8 * (DEPTH + 1 - SPLIT)) << (8 * (DEPTH + 1 - SPLIT))))
            held = [[c[end:] for c in columns]]
            if end:
                yield tuple(c[:end] for c in columns)
    if held and sum(len(h[0]) for h in held):
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, zeros, ones, longer) of the contexts one byte shorter than SPLIT; node is the context and the decision."""
    for grams, n, _ in _runs(batches):
        learned = n > 0
        grams, n = grams[learned], n[learned]
        for bit in range(8 if len(grams) else 0):
            keys, zeros, ones, longer = _climb(grams, n, bit)[1]
            node = (keys >> bit) << 8 | 1 << bit | keys & ((1 << bit) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (node, zeros, ones, longer)], ["node", "zeros", "ones", "longer"])


def _crown(nodes: pa.Table) -> list[list[tuple[np.ndarray, ...]]]:
    """For each decision the levels 0 to SPLIT - 1: keys, the answer where they are the longest, and what they hand on."""
    node, zeros, ones, longer = (nodes[c].to_numpy() for c in ("node", "zeros", "ones", "longer"))
    out = []
    for bit in range(8):
        own = np.flatnonzero((node & 255) >> bit == 1)
        keys = (node[own] >> 8) << bit | node[own] & ((1 << bit) - 1)
        own = own[np.argsort(keys)]
        levels = [Level(np.sort(keys), zeros[own], ones[own], longer[own])]
        for _ in range(SPLIT - 1):
            levels.append(Level(*levels[-1].shorter(bit)))
        before, mass = np.zeros(len(levels[-1].keys)), np.ones(len(levels[-1].keys))
        found = []
        for k in range(SPLIT - 1, -1, -1):
            before, mass = levels[k].answer(before, mass)
            found.append((levels[k].keys, levels[k].longest, before, mass))
            if k:
                before, mass = before[levels[k - 1].up], mass[levels[k - 1].up]
        out.append(found)
    return out


def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted keys are among sorted ones, and whether they are."""
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _answer(batches: Iterator[pa.RecordBatch], crown: list[list[tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """(key, total, score): the log10 probability of each gram's last byte after the bytes before it."""
    for grams, n, total in _runs(batches):
        learned = np.flatnonzero(n > 0)
        score = np.zeros(len(grams))
        for bit in range(8):
            one = np.full(len(grams), 0.5)
            prefix = (grams & 255) >> (8 - bit)
            for depth, (keys, longest, _, _) in enumerate(crown[bit]):
                at, seen = _look(keys, (grams >> (8 * (DEPTH + 1 - depth))) << bit | prefix)
                one[seen] = longest[at[seen]]
            if len(learned):
                levels, up = _climb(grams[learned], n[learned], bit)
                keys, _, before, mass = crown[bit][-1]
                at, _ = _look(keys, up[0])
                before, mass = before[at][levels[-1].up], mass[at][levels[-1].up]
                for k in range(len(levels) - 1, -1, -1):
                    before, mass = levels[k].answer(before, mass)
                    at, seen = _look(levels[k].keys, (grams >> (8 * (k + 1))) << bit | prefix)
                    one[seen] = levels[k].longest[at[seen]]
                    if k:
                        before, mass = before[levels[k - 1].up], mass[levels[k - 1].up]
            score += np.log10(np.where((grams >> (7 - bit)) & 1, one, 1 - one))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (grams, total, score)], ["key", "total", "score"])


def score_grams(grams: DataFrame) -> DataFrame:
    """(key, total, score) of grams (key, n, total), each key once; n counts what the tree learns from.

    Rows with n = 0 are scored only. Without any n above 0 every decision is even.
    """
    dealt = grams.select("key", "n", "total").repartition(F.shiftright("key", 8 * (DEPTH + 1 - SPLIT))).sortWithinPartitions("key")
    nodes = dealt.mapInArrow(_fold, "node long, zeros double, ones double, longer double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "longer")))
    shared = grams.sparkSession.sparkContext.broadcast(_crown(nodes.toArrow()))
    return dealt.mapInArrow(lambda batches: _answer(batches, shared.value), "key long, total long, score double")


def _most(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows with the largest counts, limit at most: those from the least count on that so many have."""
    step = F.floor(8 * F.log2(column)).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in counts.where(F.col(column) > 0).groupBy(step.alias("step")).count().collect()), reverse=True)
    taken, least = 0, None
    for at, n in sizes:
        if taken + n > limit:
            break
        taken, least = taken + n, at
    return counts.where(F.col(column) > 0).where(step >= least) if least is not None else counts.where("false")


def _slot(keys: np.ndarray, turn: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64) + np.uint64(turn)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _tables(keys: np.ndarray, totals: np.ndarray, scores: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two tables (key, score) by slot; what meets a more frequent gram in one goes to the next."""
    out = []
    order = np.argsort(totals, kind="stable")
    keys, scores = keys[order], scores[order]
    with np.errstate(over="ignore"):
        for turn in range(2):
            slot, held, value = _slot(keys, turn), np.full(SLOTS, _NO_KEY), np.zeros(SLOTS)
            held[slot], value[slot] = keys, scores
            left = held[slot] != keys
            keys, scores = keys[left], scores[left]
            out.append((held, value))
    return out


def _score(batches: Iterator[pa.RecordBatch], tables: list, words: np.ndarray, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 33
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for lo, hi in slices(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                grams, starts = byte_grams(part, own)
                slot = _slot(grams, 0)
                value = tables[0][1][slot]
                missing = np.flatnonzero(tables[0][0][slot] != grams)
                slot = _slot(grams[missing], 1)
                found = tables[1][0][slot] == grams[missing]
                value[missing] = np.where(found, tables[1][1][slot], 0.0)
                score = np.add.reduceat(value, starts[:-1])
                missing = missing[~found]
                rare_grams = pa.ListArray.from_arrays(pa.array(np.searchsorted(missing, starts).astype(np.int32)), pa.array(grams[missing]))
                hashes, n = word_hashes(part, own)
                at, frequent = _look(words, hashes)
                ends = np.append(0, np.cumsum(n))
                sums, filled = np.zeros(hi - lo), n > 0
                if len(words) and filled.any():
                    sums[filled] = np.add.reduceat(np.where(frequent, logs[at], 0.0), ends[:-1][filled])
                hits = np.append(0, np.cumsum(frequent))
                rare_ends = np.append(0, np.cumsum(~frequent))[ends].astype(np.int32)
                rare_words = pa.ListArray.from_arrays(pa.array(rare_ends), pa.array(hashes[~frequent].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), pa.array(n + 1), pa.array(hits[ends[1:]] - hits[ends[:-1]]), pa.array(sums), pa.array(score), pa.array(np.diff(starts)), rare_words, rare_grams],
                    ["row", "doc_id", "n_tokens", "n_frequent", "base", "score", "bytes", "rare_words", "rare_grams"],
                )
                row += hi - lo


def score(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row of docs.

    train tells the rows to learn from. A null text is empty; its tokens are the end
    alone. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over words and the end,
    by 64-bit hashes of the words; score is the tree's log10 probability of the whole
    lower-cased (A-Z) text and its end. Without training rows every count is 0. Repeated
    rows count each; a null doc_id is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("learn"))
    counted = stage_table(texts.mapInArrow(_count, _COUNTED).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("other").alias("other")), "counts")
    words = counted.where(F.col("kind") == _WORD).select("key", "n")
    grams = counted.where(F.col("kind") == _GRAM).select("key", "n", (F.col("n") + F.col("other")).alias("total"))
    scores = stage_table(score_grams(grams), "scores")
    facts = counted.where(F.col("kind") != _GRAM).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    facts = {r["kind"]: (r["n"], r["v"]) for r in facts}
    ended, (total, kinds) = facts.get(_TEXTS, (0, 0))[0], facts.get(_WORD, (0, 0))
    total, kinds = total + ended, kinds + (ended > 0)
    unit = total + 0.5 * (kinds + 1)
    frequent = _most(words, "n", WORDS).toArrow()
    keys = frequent["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    logs = np.log10((frequent["n"].to_numpy() + 0.5) / unit)
    most = _most(scores, "total", GRAMS).toArrow()
    tables = _tables(*(most[c].to_numpy() for c in ("key", "total", "score")))
    shared = spark.sparkContext.broadcast((tables, keys[order], logs[order]))
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}["doc_id"]
    schema = f"row long, doc_id {kind}, n_tokens long, n_frequent long, base double, score double, bytes long, rare_words array<long>, rare_grams array<long>"
    scored = stage_table(docs.select("doc_id", "text").mapInArrow(lambda batches: _score(batches, *shared.value), schema), "scored")
    rare = scored.select("row", F.explode("rare_words").alias("key")).join(words, "key", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / unit)).alias("rare_base"), F.count("n").alias("rare_known"))
    more = scored.select("row", F.explode("rare_grams").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times")).join(scores, "key")
    more = more.groupBy("row").agg(F.sum(F.col("times") * F.col("score")).alias("rare_score"))
    end = math.log10((ended + 0.5) / unit)
    out = scored.drop("rare_words", "rare_grams").join(rare, "row", "left").join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("rare_score", F.lit(0.0)))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0)) + int(ended > 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("bytes")).alias("bits_per_byte"),
    )
