"""Byte-level BPE encoding and decoding in numpy.

The words of a batch lie one after the other in one flat array of symbols.  A
round looks up every adjacent pair by binary search over the sorted pair keys
and merges, in each word, all occurrences of its pair of lowest rank; words
without a known pair leave the array.  A merged symbol only takes part in pairs
of higher rank, so a round does what one-at-a-time merging would.

The vocabulary is a file of the ``tokenizers`` library; its path is a parameter
and must be readable on the executors.

Nulls count as empty text and give no tokens; very long texts and words are
encoded whole; an empty table gives an empty one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from eventweir.llm.text import column, fields, text_chunks

#: Fixed value: the word pattern of byte-level vocabularies, white space by its Unicode property.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NEVER = np.iinfo(np.int64).max


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable
    Latin-1 characters for themselves, the other bytes in order from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary as arrays, and the words encoded so far."""

    def __init__(self, path: str, max_words: int = 100_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, of = spec["model"], byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.byte_ids = np.zeros(256, np.int64)
        for character, byte in of.items():
            self.byte_ids[byte] = vocab[character]
        tokens = [b""] * self.size
        for token, i in vocab.items():
            tokens[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_length = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.words = regex.compile(WORDS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.max_words = max_words
        self.forget()

    def forget(self) -> None:
        """Start the table of known words anew, special tokens first."""
        self.index: dict[str | tuple[str], int] = {(s,): i for i, s in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int32)
        self.length = np.ones(len(self.special), np.int64)
        self.start = np.arange(len(self.special), dtype=np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and how many each text has."""
        if len(self.index) > self.max_words:
            self.forget()
        parts = [self._parts(t or "") for t in texts]
        self._learn(parts)
        known = self.index
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64)
        ids, lengths = gather(self.ids, self.start[flat], self.length[flat])
        ends = np.cumsum([0, *map(len, parts)])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return ids, upto[ends[1:]] - upto[ends[:-1]]

    def _parts(self, text: str) -> list[str | tuple[str]]:
        """Words of a text; special tokens as tuples."""
        if self.split is None or not any(s in text for s in self.special):
            return self.words.findall(text)
        out: list[str | tuple[str]] = []
        for piece in self.split.split(text):
            out.extend([(piece,)] if piece in self.special else self.words.findall(piece))
        return out

    def _learn(self, parts: list[list[str | tuple[str]]]) -> None:
        new = list(set().union(*parts) - self.index.keys())
        if not new:
            return
        ids, lengths = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
        first = len(self.length)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over many words (none empty): their ids in one array, and the lengths."""
        count = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        who = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(who):
            first = np.cumsum(count) - count
            last = first + count - 1
            pair = symbols * self.size
            pair[:-1] += symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(self.keys[at] == pair, self.ranks[at], NEVER)
            rank[last] = NEVER
            best = np.minimum.reduceat(rank, first)
            ended = best == NEVER
            hit = np.flatnonzero((rank == np.repeat(best, count)) & (rank != NEVER))
            if len(hit):
                # In a run of overlapping pairs every other one is merged, from the left.
                fresh = np.concatenate([[True], np.diff(hit) != 1])
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
                symbols[hit] = self.merged[at[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            of_ended = np.repeat(ended, count)
            if ended.any():
                done.append((who[ended], symbols[of_ended], count[ended]))
            count = np.add.reduceat(keep.astype(np.int64), first)[~ended]
            symbols, who = symbols[keep & ~of_ended], who[~ended]
        who = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done])
        lengths = np.concatenate([d[2] for d in done])
        order = np.argsort(who, kind="stable")
        return gather(ids, (np.cumsum(lengths) - lengths)[order], lengths[order])

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """Texts of token ids; bytes that are no UTF-8 become U+FFFD."""
        data, sizes = gather(self.token_bytes, self.token_start[ids], self.token_length[ids])
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        cuts = upto[ends].tolist()
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``values[start : start + length]`` one after the other, and their lengths."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - length), length) + np.arange(total)], length


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path)


def release(bpe: Bpe) -> None:
    """At a task's end: the worker process lives on, and serves other operators."""
    bpe.forget()
    pa.default_memory_pool().release_unused()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by its token ids, an array of int; other columns stay.

    A column of ``df`` named as ``ids`` is replaced.  Repeated rows stay."""
    others = [c for c in df.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for chunk in text_chunks(batch, text):
                flat, count = bpe.encode(column(chunk, text).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[column(chunk, c) for c in others], lists], [*others, ids])
        release(bpe)

    schema = ", ".join(filter(None, [fields(df, *others), f"`{ids}` array<int>"]))
    return df.select(*others, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the column ``text`` decoded from token ids; null and empty lists give empty text."""
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            lists = column(batch, ids)
            count = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = pa.array(bpe.decode(flat, count), pa.string())
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in others], texts], [*others, text])
        release(bpe)

    return df.mapInArrow(run, f"{fields(df, *others)}, `{text}` string")


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", max_bytes: int = 1_000_000) -> DataFrame:
    """``encode``, then ``decode``, in one pass: ``ids`` and the decoded ``text`` beside the other columns.

    A column of ``df`` named as ``ids`` is replaced."""
    others = [c for c in df.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for chunk in text_chunks(batch, text, max_bytes):
                flat, count = bpe.encode(column(chunk, text).to_pylist())
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
                texts = pa.array(bpe.decode(flat.astype(np.int64), count), pa.string())
                yield pa.RecordBatch.from_arrays([*[column(chunk, c) for c in others], lists, texts], [*others, ids, text])
        release(bpe)

    schema = ", ".join(filter(None, [fields(df, *others), f"`{ids}` array<int>, `{text}` string"]))
    return df.select(*others, text).mapInArrow(run, schema)
