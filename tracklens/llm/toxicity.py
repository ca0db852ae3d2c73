"""Toxicity by a convolutional text classifier over hashed word embeddings, in numpy.

A word's embedding is the sum of the embeddings of its hashed features: the word and
its first bytes, which inflected forms share. Filters of several widths slide over the
words of a whole text, each keeps its largest answer, and a logistic unit reads these.
The model is fitted on the driver from a bounded sample of labelled rows and sent to
the tasks; its size is bounded by the sample's. Thresholds are calibrated by language
on all labelled rows that the fit leaves out, at the corpus's own share of toxic rows.
Language, source and id are never read by a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SLICE_BYTES, _seeded, mix64, slices, stage_table, text_buffers

WIDTHS, FILTERS, DIMENSIONS = (1, 2, 3), 8, 16
PREFIXES = (4, 5, 6)
FEATURE_BITS = 21
#: Labelled rows of either class that the fit may take, and bytes of all their texts together.
SAMPLE, SAMPLE_BYTES = 1500, 32 << 20
STEPS, BATCH = 700, 32
#: Share of words that a step leaves out, so that a text's other words are learned as well.
DROPPED = 0.3
#: Toxic rows that a language's own threshold takes; languages with fewer cut at 0.5.
CALIBRATED = 15
#: Step of a logit in which rows are counted for the cuts.
LOGIT_STEP = 1 / 64
#: A feature has an embedding if this many of the sample's texts hold it.
HOLDERS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CODES = np.where(_LETTER, _seeded(23, 256)[_LOWER], 0).astype(np.uint64)


@dataclass
class Words:
    """The words of some texts: indices into distinct words, where each text begins, and the words' features."""

    words: np.ndarray
    starts: np.ndarray
    features: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are runs of ASCII letters and digits and of bytes from 128; each text is followed by a gap.

    A gap is as many entries of the first, featureless word as the widest filter has, so
    that an empty text has one too. features has -1 where a word is too short.
    """
    gap, n = max(WIDTHS), len(offsets) - 1
    letter = _LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = letter[edges]
    starts = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(starts, offsets)) if len(data) else np.zeros(n, np.int64)
    begins = np.append(0, np.cumsum(counts + gap))
    out = np.zeros(begins[-1], np.int64)
    if len(starts) == 0:
        return Words(out, begins, np.full((1, 1 + len(PREFIXES)), -1, np.int64))
    with np.errstate(over="ignore"):
        place = np.arange(len(data), dtype=np.int64)
        place[: starts[0]] = 0
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
        powers = np.full(int(place.max()) + 1, 0xD6E8FEB86659FD93, np.uint64)
        powers[0] = 1
        parts = _CODES[data] * np.multiply.accumulate(powers)[place]
        keys, where, inverse = np.unique(np.add.reduceat(parts, starts), return_index=True, return_inverse=True)
        lengths = np.add.reduceat(letter, starts, dtype=np.int64)[where]
        begin = starts[where]
        sums = np.append(np.uint64(0), np.cumsum(parts))
        rows = [mix64(keys)]
        for p in PREFIXES:
            rows.append(mix64(sums[np.minimum(begin + p, len(data))] - sums[begin] + np.uint64(p)))
        features = (np.stack(rows, axis=1) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
        for k, p in enumerate(PREFIXES):
            features[lengths < p, k + 1] = -1
    out[np.arange(len(starts)) + np.repeat(np.arange(n) * gap, counts)] = inverse + 1
    return Words(out, begins, np.vstack([np.full((1, features.shape[1]), -1, np.int64), features]))


def read_texts(texts: list[bytes]) -> Words:
    """The words of many texts, read a slice at a time."""
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    words, counts, features, base = [], [], [], 0
    for lo, hi in slices(offsets, 1 << 18):
        part = read_words(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), offsets[lo : hi + 1] - offsets[lo])
        words.append(part.words + base)
        counts.append(np.diff(part.starts))
        features.append(part.features)
        base += len(part.features)
    return Words(np.concatenate(words), np.append(0, np.cumsum(np.concatenate(counts))), np.concatenate(features))


def slide(vectors: np.ndarray, words: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A width's filters at every word; minus infinity where a filter would see the next text."""
    answers = (vectors @ weights[0])[words]
    for j in range(1, len(weights)):
        answers[:-j] += (vectors @ weights[j])[words[j:]]
    for j in range(1, len(weights)):
        answers[starts[1:] - j] = -np.inf
    return answers


@dataclass
class Model:
    """features: the hashed features that training saw, sorted; their embeddings follow a row of zeros."""

    features: np.ndarray
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, features: np.ndarray) -> np.ndarray:
        rows = np.searchsorted(self.features, features.ravel())
        rows = np.minimum(rows, len(self.features) - 1)
        rows = np.where(self.features[rows] == features.ravel(), rows + 1, 0).reshape(features.shape)
        return self.embeddings[rows].sum(axis=1)

    def pooled(self, text: Words) -> np.ndarray:
        vectors = self.vectors(text.features)
        out = []
        for weights in self.filters:
            out.append(np.maximum.reduceat(slide(vectors, text.words, text.starts, weights), text.starts[:-1], axis=0))
        return np.concatenate(out, axis=1) + self.bias

    def logits(self, text: Words) -> np.ndarray:
        return np.maximum(self.pooled(text), 0) @ self.output + self.offset


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _subset(text: Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [text.words[text.starts[r] : text.starts[r + 1]] for r in rows]
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on whole texts; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    if not texts:
        texts, labels = [b""], np.zeros(1, np.int64)
    text = read_texts(texts)
    holders = np.zeros(1 << FEATURE_BITS, np.int32)
    for a, b in zip(text.starts[:-1], text.starts[1:], strict=True):
        own = np.unique(text.features[np.unique(text.words[a:b])])
        holders[own[own >= 0]] += 1
    ids = np.flatnonzero(holders >= HOLDERS)
    place = np.zeros(1 << FEATURE_BITS, np.int64)
    place[ids] = np.arange(1, len(ids) + 1)
    rows = np.where(text.features >= 0, place[text.features], 0)
    if len(ids) == 0:
        ids = np.zeros(1, np.int64)
    model = Model(
        ids, np.vstack([np.zeros((1, DIMENSIONS)), rng.normal(0, 0.05, (len(ids), DIMENSIONS))]).astype(np.float32),
        [rng.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )
    classes = [np.flatnonzero(labels == c) for c in (0, 1)]
    if not all(len(c) for c in classes):
        model.embeddings[:] = 0
        model.offset = 8.0 if len(classes[1]) else -8.0
        return model
    squares = np.full(len(ids) + 1, 1e-3, np.float32)
    dense = [*model.filters, model.bias, model.output]
    moments = [np.full(x.shape, 1e-3, np.float32) for x in dense]
    for step in range(STEPS):
        rate = 0.15 * (1 - step / STEPS) + 0.005
        chosen = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        y = labels[chosen].astype(np.float32)
        words, starts = _subset(text, chosen)
        words = np.where(rng.random(len(words)) < DROPPED, 0, words)
        local, words = np.unique(words, return_inverse=True)
        vectors = model.embeddings[rows[local]].sum(axis=1)
        held, best = [], []
        for weights in model.filters:
            answers = slide(vectors, words, starts, weights)
            top = np.stack([answers[a:b].argmax(axis=0) + a for a, b in zip(starts[:-1], starts[1:], strict=True)])
            best.append(top)
            held.append(np.take_along_axis(answers, top, axis=0))
        pooled = np.concatenate(held, axis=1) + model.bias
        hidden = np.maximum(pooled, 0)
        error = (sigmoid(hidden @ model.output + model.offset) - y) / len(y)
        back = error[:, None] * model.output * (pooled > 0)
        into = np.zeros_like(vectors)
        grads = []
        for k, (width, weights) in enumerate(zip(WIDTHS, model.filters, strict=True)):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.zeros_like(weights)
            for j in range(width):
                word = words[np.minimum(best[k] + j, len(words) - 1)]
                seen = vectors[word]
                grad[j] = np.einsum("bf,bfd->df", part, seen)
                np.add.at(into, word, part[:, :, None] * weights[j].T[None])
            grads.append(grad)
        grads += [back.sum(axis=0), hidden.T @ error + 1e-4 * model.output]
        model.offset -= rate * float(error.sum())
        for x, g, m in zip(dense, grads, moments, strict=True):
            m += g * g
            x -= 0.3 * rate * g / np.sqrt(m)
        touched = np.flatnonzero(np.abs(into).sum(axis=1) > 0)
        change = np.zeros((0, DIMENSIONS), np.float32)
        spots = rows[local[touched]]
        change = np.repeat(into[touched], spots.shape[1], axis=0)
        spots = spots.ravel()
        some, spots = np.unique(spots, return_inverse=True)
        total = np.zeros((len(some), DIMENSIONS), np.float32)
        np.add.at(total, spots, change)
        squares[some] += (total**2).mean(axis=1)
        model.embeddings[some] -= rate * total / np.sqrt(squares[some])[:, None]
        model.embeddings[0] = 0
    return model


def _best_cut(steps: np.ndarray, clean: np.ndarray, toxic: np.ndarray, at: float = 0.0) -> tuple[float, float, float]:
    """(cut, F1 there, F1 at at) of counted logits: the middle of the gap between steps where cutting gives the best F1."""
    order = np.argsort(-steps, kind="stable")
    s, n, y = (steps[order] + 0.5) * LOGIT_STEP, (clean + toxic)[order], toxic[order]
    f1 = 2 * np.cumsum(y) / (np.cumsum(n) + max(y.sum(), 1))
    above = s >= at
    plain = 2 * y[above].sum() / max(n[above].sum() + y.sum(), 1)
    k = int(f1.argmax())
    return float(s[k] - LOGIT_STEP / 2 if k + 1 == len(s) else (s[k] + s[k + 1]) / 2), float(f1[k]), float(plain)


def calibrate(model: Model, raw: DataFrame, known: DataFrame, fitted: tuple[int, int]) -> None:
    """Set the model's cuts from the logits of all rows whose id known has with a label.

    raw (doc_id, lang, logit, told) are the logits of all rows, told where there is a
    text. They are counted by step, label and, where a language has toxic rows enough for
    a cut of its own, language, so that the driver sees counts only. fitted has the clean
    and toxic rows that the fit took; those left stand for these as well, so that cuts are
    chosen at the corpus's share of toxic rows. The logit is shifted so that 0.5 is the
    best cut over all, then each language gets its own threshold where that is better.
    Without clean rows, or with fewer toxic ones than a threshold takes, nothing moves.
    """
    scored = raw.where("told").select("doc_id", "lang", F.floor(F.col("logit") / LOGIT_STEP).cast("int").alias("step")).join(known.select("doc_id", "toxic").distinct(), "doc_id")
    scored = stage_table(scored.groupBy("lang", "step", "toxic").agg(F.count("*").alias("n")), "steps")
    own_cut = scored.where("lang is not null and toxic = 1").groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= CALIBRATED).select("lang")
    counts = scored.groupBy("step", "toxic").agg(F.sum("n").alias("n")).toPandas()
    toxic = counts["toxic"] == 1
    if counts["n"][toxic].sum() < CALIBRATED or toxic.all():
        return
    weights = {label: 1 + taken / max(counts["n"][counts["toxic"] == label].sum(), 1) for label, taken in enumerate(fitted)}

    def best(own, at: float) -> tuple[float, float, float]:
        own = own.assign(weight=own["n"] * own["toxic"].map(weights))
        held = own.groupby(["step", "toxic"])["weight"].sum().unstack(fill_value=0.0).reindex(columns=[0, 1], fill_value=0.0)
        return _best_cut(held.index.to_numpy(), held[0].to_numpy(), held[1].to_numpy(), at)

    cut = best(counts, 0.0)[0]
    for language, own in scored.join(own_cut, "lang").toPandas().groupby("lang"):
        better, most, plain = best(own, cut)
        model.thresholds[language] = float(sigmoid(np.float64(better - cut))) if most > plain else 0.5
    model.offset -= cut


def fit_sample(docs: DataFrame, labels: DataFrame, held_out_of: int = 5) -> tuple[Model, DataFrame, tuple[int, int]]:
    """(model without cuts, labelled rows that calibrate it, clean and toxic rows fitted) from a bounded sample.

    At most SAMPLE rows of either class outside the held-out fold are fitted, those first
    by a hash of their id, of any length as long as all their texts together have
    SAMPLE_BYTES bytes at most; a quarter of the ids, by another hash, is left to
    calibrate, unless that has too few toxic rows. All labelled rows that are not fitted
    calibrate. An id with several texts or labels is fitted with the first of them by
    order. Rows without a label, id or text take no part.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(fold != 0).where("toxic in (0, 1)")
    order = F.xxhash64("doc_id", F.lit(5))
    enough = known.where("toxic = 1").select("doc_id").distinct().count() >= 4 * CALIBRATED
    taken = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) != 0 if enough else F.lit(True)
    ids = [known.where(F.col("toxic") == c).where(taken).select("doc_id", "toxic").distinct().orderBy(order, "doc_id").limit(SAMPLE) for c in (0, 1)]
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    rows = stage_table(rows.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("one")).select("doc_id", "one.toxic", "one.text", order.alias("turn")), "sample")
    chosen, held = [], 0
    for r in sorted(rows.select("doc_id", "turn", F.octet_length("text").alias("n")).collect(), key=lambda r: (r["turn"], r["doc_id"])):
        if held + r["n"] <= SAMPLE_BYTES:
            chosen.append((r["doc_id"],))
            held += r["n"]
    fitted = docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)
    rows = rows.join(F.broadcast(fitted), "doc_id", "left_semi").select("doc_id", "toxic", "text").toPandas().sort_values("doc_id")
    rows = rows.sample(frac=1, random_state=3)
    y = rows["toxic"].to_numpy()
    model = fit([t.encode() for t in rows["text"]], y)
    return model, known.join(F.broadcast(fitted), "doc_id", "left_anti"), (int((y == 0).sum()), int((y == 1).sum()))


def train(docs: DataFrame, labels: DataFrame, held_out_of: int = 5) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold, calibrate on all others of that part."""
    model, known, fitted = fit_sample(docs, labels, held_out_of)
    calibrate(model, _logits(docs, model, ("lang",), named=True).select("doc_id", "lang", "logit", "told"), known, fitted)
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, with_text: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.num_columns - 1))
        logits = np.zeros(batch.num_rows)
        for lo, hi in slices(offsets, SLICE_BYTES // 4):
            text = read_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            logits[lo:hi] = model.logits(text)
        kept = batch.num_columns if with_text else batch.num_columns - 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(logits)], [*batch.schema.names[:kept], "logit"])


def _logits(docs: DataFrame, model: Model, keep: tuple[str, ...], with_text: bool = False, named: bool = False) -> DataFrame:
    """(row, lang, told, doc_id where named, text where asked for, logit): row is the struct of the columns keep."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    asked = docs.select(row, F.col("lang").alias("lang"), F.col("text").isNotNull().alias("told"), *[F.col("doc_id").alias("doc_id")][:named], F.col("text").alias("text"))
    schema = StructType([*asked.schema.fields[: 3 + named + with_text], StructField("logit", DoubleType())])
    return asked.mapInArrow(lambda batches: _score(batches, Model(**shared.value), with_text), schema)


def _judged(raw: DataFrame, model: Model, shift: float, with_text: bool) -> DataFrame:
    """The kept columns with score, threshold and rejected; shift is what calibration moved the logit by."""
    limit = F.lit(0.5)
    if model.thresholds:
        table = F.create_map(*[F.lit(x) for pair in sorted(model.thresholds.items()) for x in pair])
        limit = F.coalesce(F.try_element_at(table, F.coalesce("lang", F.lit(""))), F.lit(0.5))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("logit") + F.lit(shift))))
    found = raw.withColumn("score", score)
    return found.select("row.*", *["text"][:with_text], "score", limit.alias("threshold"), (F.col("score") >= limit).alias("rejected"))


def _kept(keep: tuple[str, ...], with_text: bool) -> tuple[str, ...]:
    return tuple(c for c in keep if c not in ("score", "threshold", "rejected") and not (with_text and c == "text"))


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id", "lang"), with_text: bool = False) -> DataFrame:
    """The columns keep, the score of each row's whole text, its threshold, and whether it is rejected.

    Null and empty texts get the score of a text without words. A row is rejected if its
    score reaches its language's threshold; 0.5 where the language is null or unknown.
    Repeated rows stay. Columns of keep with the names of the added ones are replaced;
    other columns of docs are not read. with_text adds the text itself, which then needs
    no copy of its own in keep.
    """
    return _judged(_logits(docs, model, _kept(keep, with_text), with_text), model, 0.0, with_text)


def score_corpus(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), with_text: bool = False, held_out_of: int = 5) -> DataFrame:
    """What score_documents gives for a model trained on the same docs; each text is scored once.

    The logits are written to the shared folder, calibrate the model there, and are then
    moved by what calibration found. With with_text the texts are written along with them.
    """
    model, known, fitted = fit_sample(docs, labels, held_out_of)
    raw = stage_table(_logits(docs, model, _kept(keep, with_text), with_text, named=True), "logits")
    before = model.offset
    calibrate(model, raw.select("doc_id", "lang", "logit", "told"), known, fitted)
    return _judged(raw, model, model.offset - before, with_text)
