"""Packing tokenised documents into sequences by harmonic classes.

Every document is cut into whole sequences and a rest; the rest is cut at reciprocals of
the capacity, so that its pieces belong to class k, of which k fill a sequence. A worker
fills the sequences of each class with exactly k pieces and needs nothing from others.
Only when a worker's input ends are pieces of unfilled classes, a bounded number of
tokens, laid end to end and cut anew; what then remains is cut into powers of two.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import IS_SPACE, SLICE_BYTES, slices, text_buffers, word_hashes

CAPACITY = 4096
#: Rests are cut at reciprocals up to this class; smaller ones stay whole.
CLASSES = 32
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Words of a generation that a worker remembers; the generation before is kept as well.
REMEMBERED = 600_000
#: Beyond so many, the parts of words that a worker remembers are forgotten.
PARTS = 150_000
#: What texts with special tokens hold; these are encoded whole.
SPECIAL = b"<|"
#: Words encoded at once, and the character between those that aren't plain letters.
TOGETHER, MARK = 256, "\x01"
#: ASCII punctuation that is cut from the end of a word; an apostrophe may belong to it.
_TAIL = b".,;:!?*#$%&()\"+-/<=>@[]^_`{|}~\\"
#: Lead bytes from here on may begin letters whose class or case differs between libraries.
_LATIN = 0xC4


def gather(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at begins, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)]


class WordTable:
    """Ids by word hash, as sorted arrays: a tenth of a dict's memory."""

    def __init__(self):
        self.keys, self.begins, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where keys are in the table, -1 for those it lacks."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        keys = np.append(self.keys, keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.begins, self.sizes = keys[order], np.append(self.begins, begins)[order], np.append(self.sizes, sizes)[order]
        self.flat = np.append(self.flat, ids)


def _worker_state() -> dict:
    """A dict that stays with this Python worker, so that later tasks find what earlier ones have read."""
    return sys.modules.setdefault("_tracklens_packing_state", types.ModuleType("_tracklens_packing_state")).__dict__


class WordTokens:
    """Token ids of texts, word by word; a word between ASCII white space is encoded once.

    Holds for tokenizers that fold case and drop white space, whose tokens never span it,
    that split letters from punctuation, and whose last token of a word ends with
    END_OF_WORD. Words are told apart by 64-bit hashes.
    """

    END_OF_WORD = "</w>"

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        held = _worker_state()
        if name not in held:
            tokenizer = tokenizers.Tokenizer.from_file(name)
            mark = tokenizer.encode(MARK, add_special_tokens=False).ids
            ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
            ends[[k for w, k in tokenizer.get_vocab().items() if w.endswith(self.END_OF_WORD)]] = True
            held[name] = {"tokenizer": tokenizer, "mark": mark[0] if len(mark) == 1 else None, "ends": ends, "table": WordTable(), "before": WordTable(), "parts": {}}
        self.held = held[name]
        self.tokenizer, self.mark, self.ends = (self.held[k] for k in ("tokenizer", "mark", "ends"))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit words."""
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        return self.encode_rows(np.frombuffer(b"".join(texts), np.uint8), offsets)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """encode for the rows of data that begin at offsets."""
        raw = data.tobytes()
        with np.errstate(over="ignore"):
            hashes, counts, starts = word_hashes(data, offsets, places=True)
        found, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = np.add.reduceat(~IS_SPACE[data], starts, dtype=np.int64)[where] if len(starts) else where
        table, at = self._ids(found, starts[where], lengths, raw)
        many = table.sizes[at][inverse]
        ids = gather(table.flat, table.begins[at][inverse], many).tobytes()
        ends = np.append(0, np.cumsum(many))
        edges = (4 * ends[np.append(0, np.cumsum(counts))]).tolist()
        out = [ids[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        if SPECIAL in raw:
            for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if SPECIAL in raw[lo:hi]:
                    out[k] = np.array(self.tokenizer.encode(raw[lo:hi].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _ids(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, raw: bytes) -> tuple[WordTable, np.ndarray]:
        """A table that has all keys and their places in it; a word of the last two generations is known."""
        held = self.held
        if len(held["table"].keys) > REMEMBERED:
            held["before"], held["table"], held["parts"] = held["table"], WordTable(), {}
        table, before = held["table"], held["before"]
        missing = np.flatnonzero(table.find(keys) < 0)
        if len(missing):
            old = before.find(keys[missing])
            known = old[old >= 0]
            new = missing[old < 0]
            words = [raw[lo : lo + n].lower() for lo, n in zip(starts[new].tolist(), lengths[new].tolist(), strict=True)]
            values = self._learn(words)
            sizes = np.append(before.sizes[known], np.array([len(v) for v in values], np.int64) // 4)
            ids = np.append(gather(before.flat, before.begins[known], before.sizes[known]), np.frombuffer(b"".join(values), "<u4"))
            table.add(np.append(keys[missing[old >= 0]], keys[new]), sizes, ids)
        return table, table.find(keys)

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: of letters and the punctuation behind them apart, as the tokenizer splits them."""
        if len(self.held["parts"]) > PARTS:
            self.held["parts"] = {}
        parts = self.held["parts"]
        split, letters, other = [], set(), set()
        for w in words:
            core = w.rstrip(_TAIL)
            if core.isalpha() or (core and max(core) < _LATIN and core.decode().isalpha()):
                tail = w[len(core) :]
                if core not in parts:
                    letters.add(core)
            else:
                core, tail = b"", w
            if tail not in parts:
                other.add(tail)
            split.append((core, tail))
        parts[b""] = b""
        self._encode(list(letters), None)
        other.discard(b"")
        self._encode([w for w in other if self.mark is not None and MARK.encode() not in w], self.mark)
        rest = [w for w in other if self.mark is None or MARK.encode() in w]
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False) if rest else [], strict=True):
            parts[w] = np.array(e.ids, "<u4").tobytes()
        return [parts[core] + parts[tail] for core, tail in split]

    def _encode(self, words: list[bytes], mark: int | None) -> None:
        """Encode words, many at once: told apart by the mark between them, or, of letters alone, by their last tokens."""
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            text = (b" " if mark is None else b" \x01 ").join(some).decode()
            found = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            if mark is None:
                stops = np.flatnonzero(self.ends[found]) + 1
                starts = np.append(0, stops[:-1])
            else:
                at = np.flatnonzero(found == mark)
                starts, stops = np.append(0, at + 1), np.append(at, len(found))
            if len(stops) != len(some):
                raise ValueError("the tokenizer merges words over white space")
            raw = found.tobytes()
            for w, lo, hi in zip(some, (4 * starts).tolist(), (4 * stops).tolist(), strict=True):
                self.held["parts"][w] = raw[lo:hi]


def cut(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int, int]]:
    """(start, length, class) of a document's pieces."""
    out = [(k * capacity, capacity, 1) for k in range(tokens // capacity)]
    at, rest = len(out) * capacity, tokens % capacity
    while rest:
        k = -(-capacity // rest)
        length = capacity // k if k <= classes else rest
        out.append((at, length, k if k <= classes else capacity // rest))
        at, rest = at + length, rest - length
    return out


def _pack(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int) -> Iterator[pa.RecordBatch]:
    tokens = WordTokens(tokenizer)
    base = TaskContext.get().partitionId() << 33
    open_: dict[int, list[tuple]] = {}
    sequence, rows = 0, []
    kind = None

    def fill(pieces: list[tuple], k: int) -> None:
        nonlocal sequence
        offset = 0
        for doc, total, start, ids in pieces:
            n = len(ids) // 4
            rows.append((doc, start, n, ids, total, base + sequence, offset, k))
            offset += n
        sequence += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 8
        rows.clear()
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "class"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        kind = batch.schema.field(0).type
        data, offsets = text_buffers(batch.column(1))
        docs = batch.column(0).to_pylist()
        for lo, hi in slices(offsets, SLICE_BYTES // 2):
            for doc, ids in zip(docs[lo:hi], tokens.encode_rows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), strict=True):
                ids += end
                total = len(ids) // 4
                for start, length, k in cut(total, capacity):
                    waiting = open_.setdefault(k, [])
                    waiting.append((doc, total, start, ids[4 * start : 4 * (start + length)]))
                    if len(waiting) == k:
                        fill(waiting, k)
                        waiting.clear()
            if rows:
                yield flush()
    pieces = [p for k in sorted(open_) for p in open_[k]]
    left = sum(len(p[3]) for p in pieces) // 4
    lengths = [capacity] * (left // capacity) + [1 << b for b in reversed(range(capacity.bit_length())) if left % capacity >> b & 1]
    for length in lengths:
        taken = []
        while length:
            doc, total, start, ids = pieces.pop(0)
            n = min(len(ids) // 4, length)
            taken.append((doc, total, start, ids[: 4 * n]))
            if 4 * n < len(ids):
                pieces.insert(0, (doc, total, start + n, ids[4 * n :]))
            length -= n
        fill(taken, 0)
    if rows:
        yield flush()


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset, class.

    A document is its text's ids and one END; a null or empty text has the END alone.
    ids are little-endian unsigned 32-bit words. Each id lies in exactly one piece. A
    sequence of class k holds k pieces of that class; class 0 holds what workers had
    left. Sequences below the capacity are padded to it, but for powers of two. A null
    doc_id is kept, repeated rows are packed each, an empty table gives no rows, other
    columns are not read.
    """
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, class int"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _pack(batches, tokenizer, capacity), schema)
