"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

Texts are cut into words; the distinct words of a batch that aren't known yet are encoded together.
Their symbols stand in one flat array. A round looks up every adjacent pair by binary search among
the sorted pair keys, takes for each word the pair of lowest rank, and merges it wherever it occurs
in that word, from the left. Words without a known pair are done and leave the array.

The vocabulary file is read on the driver and sent with the tasks: its size is that of the file.
Known words are kept up to ``KNOWN_WORDS`` a task, then forgotten; that changes no result.

Defined cases: a null text counts as empty and has no tokens. Special tokens of the file are matched in
the text first, as the tokenizers library does by default; post-processing isn't applied. Unknown ids
are an error. Repeated rows are fine. Other columns are kept by ``with_tokens`` and not read by the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import by_value, map_batches

KNOWN_WORDS = 300_000
# The public split pattern of this vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = np.iinfo(np.int64).max


def _byte_characters() -> list[str]:
    """The character that stands for each byte in the file: itself if printable in Latin-1, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """The tables of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        ids, merges = stored["model"]["vocab"], stored["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}
        characters = _byte_characters()
        to_byte = {c: b for b, c in enumerate(characters)}
        self.byte_ids = np.array([ids[c] for c in characters], np.int64)
        self.size = max([*ids.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)[order]
        pieces = [b""] * self.size
        for token, at in ids.items():
            pieces[at] = bytes(to_byte[c] for c in token)
        for token, at in self.special.items():
            pieces[at] = token.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_length = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length


def _broadcast(df: DataFrame, path: str) -> Broadcast:
    """The tables of a file as plain values: an object of a class of this package would need the package on every worker."""
    return df.sparkSession.sparkContext.broadcast(vars(Vocabulary(path)))


def _received(shared: Broadcast) -> Vocabulary:
    vocabulary = object.__new__(Vocabulary)
    vars(vocabulary).update(shared.value)
    return vocabulary


def _slices(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of many slices, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def merge_rounds(words: Sequence[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of many words in one flat array, and how many each has."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    symbols = vocabulary.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), length)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        inside = owner[1:] == owner[:-1]
        keys = symbols[:-1] * vocabulary.size + symbols[1:]
        found = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
        known = inside & (vocabulary.keys[found] == keys)
        rank = np.full(len(symbols), _NONE)
        rank[:-1][known] = vocabulary.ranks[found[known]]
        first = np.flatnonzero(np.concatenate(([True], ~inside)))
        lowest = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(symbols)))
        best = (rank == np.repeat(lowest, size)) & (rank != _NONE)
        # Of overlapping places of one pair (a run of equal symbols) take every second, from the left.
        place = np.arange(len(symbols))
        run = np.maximum.accumulate(np.where(best & ~np.concatenate(([False], best[:-1])), place, 0))
        best &= (place - run) % 2 == 0
        at = np.flatnonzero(best)
        symbols[at] = vocabulary.merged[found[at]]
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        ended = np.repeat(lowest == _NONE, size)
        if ended.any():
            done.append((owner[ended], symbols[ended]))
            stays &= ~ended
        symbols, owner = symbols[stays], owner[stays]
    if not done:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    owner = np.concatenate([d[0] for d in done])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([d[1] for d in done])[order], np.bincount(owner, minlength=len(words))


class Encoder:
    """Encodes batches of texts; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary, known_words: int = KNOWN_WORDS) -> None:
        self.vocabulary, self.known_words = vocabulary, known_words
        self.split = regex.compile(SPLIT).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) or r"(?!)")
        self._forget()

    def _forget(self) -> None:
        special = list(self.vocabulary.special.items())
        # Special tokens have the keys (token,), which no word equals.
        self.index = {(token,): i for i, (token, _) in enumerate(special)}
        self.flat = np.array([i for _, i in special], np.int64)
        self.length = np.ones(len(special), np.int64)

    def _words(self, text: str) -> list:
        if not self.special.search(text):
            return self.split(text)
        words, at = [], 0
        for match in self.special.finditer(text):
            words += [*self.split(text[at:match.start()]), (match.group(),)]
            at = match.end()
        return words + self.split(text[at:])

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        cut = [self._words(t) for t in texts]
        fresh = {w for words in cut for w in words if w not in self.index}
        if len(self.index) + len(fresh) > self.known_words:
            self._forget()
            fresh = {w for words in cut for w in words if w not in self.index}
        fresh = sorted(fresh)
        ids, length = merge_rounds([w.encode() for w in fresh], self.vocabulary)
        self.index.update(zip(fresh, range(len(self.length), len(self.length) + len(fresh))))
        self.flat, self.length = np.concatenate((self.flat, ids)), np.concatenate((self.length, length))
        start = np.cumsum(self.length) - self.length
        found = []
        for words in cut:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            found.append(self.flat[_slices(start[at], self.length[at])].astype(np.int32))
        return found


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocabulary.size:
        raise ValueError("a token id is outside the vocabulary")
    return vocabulary.piece_bytes[_slices(vocabulary.piece_start[ids], vocabulary.piece_length[ids])].tobytes().decode("utf-8", "replace")


_PART_CHARACTERS = 1 << 20


def _parts(texts: list[str]) -> Iterable[list[str]]:
    """Some texts at a time, so that memory follows the longest text and not the batch."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size > _PART_CHARACTERS:
            yield part
            part, size = [], 0
    yield part


def _once(state: dict[str, Encoder], vocabulary: Broadcast) -> Encoder:
    """The encoder of this task."""
    if "encoder" not in state:
        state["encoder"] = Encoder(_received(vocabulary))
    return state["encoder"]


def _texts(df: DataFrame, text_column: str) -> Column:
    return F.coalesce(df[text_column], F.lit(""))


def _digest(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    return hashlib.sha256(decode_ids(ids, vocabulary).encode()).hexdigest()


def with_tokens(docs: DataFrame, path: str, text_column: str = "text", tokens_column: str = "tokens", decoded_column: str | None = None) -> DataFrame:
    """Adds a column with the token ids of each whole text and, if named, one with the SHA-256 of the text that the ids
    decode to. Columns of these names are replaced."""
    vocabulary = _broadcast(docs, path)
    state: dict[str, Encoder] = {}
    added = [tokens_column] + ([decoded_column] if decoded_column else [])
    kept = [c for c in docs.columns if c not in added]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _once(state, vocabulary)
        ids = [x for part in _parts(batch.column(batch.num_columns - 1).to_pylist()) for x in encoder.encode(part)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        found = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        if decoded_column:
            found.append(pa.array([_digest(x, encoder.vocabulary) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], [*kept, *added])
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"`{tokens_column}` array<int>"]
    if decoded_column:
        kinds.append(f"`{decoded_column}` string")
    unused = max(kept, key=len, default="") + "_text"  # longer than any name of the input
    return map_batches(docs.select(*[docs[f"`{c}`"] for c in kept], _texts(docs, text_column).alias(unused)), run, ", ".join(kinds))


def decoded(df: DataFrame, path: str, id_column: str = "doc_id", tokens_column: str = "tokens") -> DataFrame:
    """The id and the text of each row's tokens; null tokens give an empty text."""
    shared = _broadcast(df, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = _received(shared)
        texts = [decode_ids(np.array(x or [], np.int64), vocabulary) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_column, "text"])
    return map_batches(df.select(id_column, df[tokens_column].cast("array<int>")), run,
                       f"`{id_column}` {df.schema[id_column].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and returns the digests of both."""
    vocabulary = _broadcast(docs, path)
    state: dict[str, Encoder] = {}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _once(state, vocabulary)
        counts, ids_sha, text_sha = [], [], []
        for part in _parts(batch.column(1).to_pylist()):
            for ids in encoder.encode(part):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_sha.append(_digest(ids, encoder.vocabulary))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            [id_column, "n_tokens", "ids_sha256", "decoded_sha256"])
    kind = docs.schema[id_column].dataType.simpleString()
    return map_batches(docs.select(docs[id_column], _texts(docs, text_column).alias("_text")), run,
                       f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


by_value(__name__)
