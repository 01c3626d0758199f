"""Near-duplicate documents by the Jaccard similarity of their word n-grams.

A document is the set of its distinct shingles (``k`` words; with fewer words
the whole sequence is one).  Documents link when ``similarity`` (per cent) holds
exactly.  Equal sets are one class; links are sought between classes.

Candidates come from a partition of the universe of shingles:

* Sizes are cut into bands that double.  Each band hashes the universe into a
  number of segments, so a set falls into as many pieces.  Two sets that link
  differ in at most ``H`` shingles, which follows from their sizes.
* ``p`` of the segments are compared with their one-deletion neighbourhoods: the
  piece and the piece without any one of its shingles.  If none of these finds
  a partner, at least two differences lie in each.
* The other segments are compared exactly.  At most ``H - 2p`` of them can
  differ, so of both sets the ``H - 2p + 1`` first ones in a common order must
  have one in common; only these are indexed.  The order puts the pieces with
  most shingles first, as those are shared by chance least.
* ``p`` is chosen for each band by cost: rows to index and pieces shared by chance.

A set is indexed in its own band, and in the band below if it may have partners there.

Pieces meet by hash.  Of the sets that share a piece every one is paired with
one hub, first within each task, so that what a task sends is one row per piece
even if all its documents share it.  Pairs are verified by intersecting the
sets.  Afterwards only pieces whose sets are not all in one component matter;
further hubs are tried while many pairs would remain, then all pairs that lie
across components are verified, so no link between components is missed.  Before
that, sketches of the sets rule out the pairs that surely differ too much.  Those
pairs are formed in blocks of bounded size, so no task holds a whole crowd.

Shingles are known by 64-bit hashes, classes by 128-bit hashes of their sets.

Null and empty texts, and texts of blanks only, have no shingles and link with
nothing.  Texts are read whole.  Rows without an id stay and get no component
of their own number.  Repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from eventweir.llm.bpe import gather
from eventweir.llm.text import column, text_chunks
from eventweir.operators.joins import BROADCAST_BYTES
from eventweir.session import written_table

U64 = np.uint64

#: Sets that may share a piece before their rarer pieces are indexed.
MANY = 50
#: Counters of shingles for the order of rare ones.
BUCKETS = 1 << 18
#: Rows of a piece that are paired with each other, or with as many others, at once.
BLOCK = 2048
#: Numbers of 64 bits that sketch a set.
SKETCH = 16
SKETCHES = [f"s{i}" for i in range(SKETCH)]
#: Bytes of text hashed at once; the arrays for them take some forty times as much.
CHUNK = 1_000_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
        return h ^ (h >> U64(32))


#: Odd multipliers without any relation, which tell the places in a shingle apart.
PLACES = list(mix(mix(np.arange(1, 65).astype(U64) * U64(0x9E3779B97F4A7C15))) | U64(1))


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """A number for every byte, the same for both cases and 0 for blanks; and which bytes are blank."""
    lower = np.arange(256)
    lower[65:91] += 32
    blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    return np.where(blank, U64(0), mix((lower.astype(U64) + U64(1)) * PLACES[5])), blank


LETTERS, BLANK = letter_tables()


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and how many words each text has.

    A word's hash is the sum of its letters' numbers, each times a number of its place."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins)
    ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
    if not len(starts):
        return np.zeros(0, U64), counts
    data = data[starts[0] :]
    starts = starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))
    with np.errstate(over="ignore"):
        weights = mix(np.arange(1, int(place.max()) + 2).astype(U64) * PLACES[9]) | U64(1)
        return mix(np.add.reduceat(LETTERS[data] * weights[place], starts)), counts


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all texts in one array, and how many each has."""
    words, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    ends = np.cumsum(counts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(int(n.sum()), U64)
    cuts = np.concatenate([[0], np.cumsum(n)])
    with np.errstate(over="ignore"):
        if len(words) >= k:
            last = len(words) - k + 1
            every = sum((words[j : last + j] * PLACES[j] for j in range(k)), U64(k))
        for i, (count, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
            if count >= k:
                out[cuts[i] : cuts[i + 1]] = np.sort(mix(every[end - count : end - k + 1]))
            elif count:
                short = (words[end - count : end] * np.array(PLACES[:count], U64)).sum() + U64(count)
                out[cuts[i]] = mix(np.array([short], U64))[0]
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[cuts[:-1][n > 0]] = True
    upto = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], np.diff(upto[cuts])


@dataclass(frozen=True)
class Join:
    """The parameters of a join: words of a shingle, and a similarity in per cent.

    ``chance`` is the assumed share of a text's shingles that any other text may
    hold, ``verify_rows`` the cost of a false candidate in index rows."""

    k: int = 5
    similarity: int = 80
    chance: float = 0.3
    verify_rows: float = 50.0

    def differences(self, a, b):
        """Largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
        return (a + b) * (100 - self.similarity) // (100 + self.similarity)

    def largest(self, n):
        return n * 100 // self.similarity

    def smallest(self, n):
        return -(-n * self.similarity // 100)

    def fits(self, a: str, b: str) -> Column:
        """Can the sets of two rows link: ``n`` is a set's size, ``rank`` how many
        shingles come before the common one; those the sets share none of."""
        common = F.least(F.col(f"n_{a}") - F.col(f"rank_{a}"), F.col(f"n_{b}") - F.col(f"rank_{b}"))
        return (100 + self.similarity) * common >= self.similarity * (F.col(f"n_{a}") + F.col(f"n_{b}"))

    def alike(self, a: str, b: str) -> Column:
        """Do the sketches of two rows differ in no more bits than linked sets do in shingles."""
        bits = reduce(Column.__add__, (F.bit_count(F.col(f"{s}_{a}").bitwiseXOR(F.col(f"{s}_{b}"))) for s in SKETCHES))
        return (100 + self.similarity) * bits <= (100 - self.similarity) * (F.col(f"n_{a}") + F.col(f"n_{b}"))

    def allocation(self, band: int) -> tuple[int, int]:
        """Segments compared exactly, and with deletions, of sizes ``2**band`` to ``2**(band + 1) - 1``."""
        low, high = 2**band, 2 ** (band + 1) - 1
        most = self.differences(high, self.largest(high))
        best = (np.inf, 0, 0)
        for p in sorted({0, 1, (most + 1) // 2}):
            needed = most - 2 * p + 1
            if needed < 0:
                continue
            exact = -(-needed * 115 // 100)
            if exact + p == 0:
                continue
            piece = (low * high) ** 0.5 / (exact + p)
            rows = needed + p * (piece + 1)
            by_chance = needed * self.chance**piece + p * (piece + 1) * self.chance ** max(piece - 1, 0)
            best = min(best, (rows + self.verify_rows * by_chance, exact, p))
        return best[1], best[2]

    def pieces(self, shingles: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the indexed pieces of some sets, and the place of the set each is of."""
        parts = [self._pieces(*group) for group in self._groups(shingles, sizes)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _groups(self, shingles: np.ndarray, sizes: np.ndarray) -> list[tuple]:
        """The sets in their own band, and those with partners in the band below."""
        band = np.log2(np.maximum(sizes, 1)).astype(np.int64)  # exact for sizes below 2**48
        starts = np.cumsum(sizes) - sizes
        every = np.arange(len(sizes))
        # Sets that link with equal sets only need no index.
        own = every[(self.largest(sizes) > sizes) | (self.smallest(sizes) < sizes)]
        below = every[(sizes > 0) & (self.smallest(sizes) < 2**band)]
        return [
            (shingles, starts[own], sizes[own], band[own], self.differences(sizes[own], self.largest(sizes[own])), own),
            (shingles, starts[below], sizes[below], band[below] - 1, self.differences(sizes[below], 2 ** band[below] - 1), below),
        ]

    def _pieces(self, shingles, starts, sizes, band, differences, of) -> tuple[np.ndarray, np.ndarray]:
        if not len(of):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        table = np.array([self.allocation(b) for b in range(int(band.max()) + 1)], np.int64)
        exact, deleted = table[band, 0], table[band, 1]
        first = np.maximum(differences - 2 * deleted + 1, 0)  # exact pieces to index
        flat, _ = gather(shingles, starts, sizes)
        who = np.repeat(np.arange(len(of)), sizes)
        segments = (exact + deleted).astype(U64)
        with np.errstate(over="ignore"):
            segment = (((flat >> U64(32)) * segments[who]) >> U64(32)).astype(np.int64)  # ascending within a set
            mixed = mix(flat)
            begins = np.concatenate([[True], (who[1:] != who[:-1]) | (segment[1:] != segment[:-1])])
            runs = np.flatnonzero(begins)
            count = np.diff(np.concatenate([runs, [len(flat)]]))
            total = np.add.reduceat(mixed, runs)
            run_who, run_segment = who[runs], segment[runs]
            keys = _key(total, count, band[run_who], run_segment)

            # Exact segments: the first ones by size and hash.
            is_exact = run_segment < exact[run_who]
            e_who, e_keys, e_count = run_who[is_exact], keys[is_exact], count[is_exact]
            order = np.lexsort((e_keys, -e_count, e_who))
            e_who, e_keys = e_who[order], e_keys[order]
            there = np.bincount(e_who, minlength=len(of))
            rank = np.arange(len(e_who)) - np.repeat(np.cumsum(there) - there, there)
            taken = rank < first[e_who]
            out_keys, out_who = [e_keys[taken]], [e_who[taken]]
            # Sets with fewer pieces than that index empty ones too.
            for i in np.flatnonzero(there < first).tolist():
                empty = np.setdiff1d(np.arange(exact[i]), run_segment[is_exact & (run_who == i)])
                empty_keys = np.sort(_key(np.zeros(len(empty), U64), 0, band[i], empty))
                out_keys.append(empty_keys[: first[i] - there[i]])
                out_who.append(np.full(len(out_keys[-1]), i))

            # Segments with deletions: the piece, and the piece without each of its shingles.
            out_keys.append(keys[~is_exact])
            out_who.append(run_who[~is_exact])
            of_run = np.repeat(np.arange(len(runs)), count)
            inside = ~is_exact[of_run]
            run = of_run[inside]
            out_keys.append(_key(total[run] - mixed[inside], count[run] - 1, band[run_who[run]], run_segment[run]))
            out_who.append(run_who[run])
            there = np.bincount(run_who[~is_exact], minlength=len(of))
            for i in np.flatnonzero(there < deleted).tolist():
                empty = np.setdiff1d(np.arange(exact[i], exact[i] + deleted[i]), run_segment[~is_exact & (run_who == i)])
                out_keys.append(_key(np.zeros(len(empty), U64), 0, band[i], empty))
                out_who.append(np.full(len(empty), i))
        return np.concatenate(out_keys), of[np.concatenate(out_who)]


def _key(total: np.ndarray, count, band, segment) -> np.ndarray:
    """Hash of a piece from the sum of its mixed shingles, its size and its place."""
    with np.errstate(over="ignore"):
        place = np.asarray(band).astype(U64) * U64(1 << 40) + np.asarray(segment).astype(U64)
        return mix(total + np.asarray(count).astype(U64) * PLACES[7] + mix(place * PLACES[11] + PLACES[13]))


def class_hashes(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every set."""
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    data = flat.astype("<u8").tobytes()
    digests = [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def sketches(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``SKETCH`` numbers for every set: a bit tells whether an odd number of its
    shingles falls on it, so two sets differ in as many shingles as bits at least."""
    width = 64 * SKETCH
    place = np.repeat(np.arange(len(sizes)), sizes) * width + (mix(flat) % U64(width)).astype(np.int64)
    odd = (np.bincount(place, minlength=len(sizes) * width) & 1).astype(np.uint8)
    numbers = np.packbits(odd, bitorder="little").view("<i8").reshape(len(sizes), SKETCH)
    return [numbers[:, i].copy() for i in range(SKETCH)]


DOC = pa.struct([("id", pa.int64()), ("n", pa.int64()), ("c2", pa.int64())])


def no_docs(n: int) -> pa.Array:
    return pa.nulls(n, DOC)


def sliced(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """A large batch as small ones, which the JVM takes one at a time."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def indexed(docs: DataFrame, join: Join, max_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``id, text`` as ``key, cls, hub, doc``, of three kinds:

    * the smallest class of a task that holds a piece, under the piece's key;
    * the task's other classes with the piece, each with that one as ``hub``;
    * every document, with its set's size and class.
    """

    def flushed(keys: list[np.ndarray], classes: list[np.ndarray]) -> pa.RecordBatch:
        k, c = np.concatenate(keys).view(np.int64), np.concatenate(classes)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        fresh_key = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        fresh = fresh_key.copy()
        fresh[1:] |= c[1:] != c[:-1]
        pair = fresh & ~fresh_key
        pairs = np.stack([c[fresh_key][np.cumsum(fresh_key) - 1][pair], c[pair]])
        pairs = np.unique(pairs, axis=1) if pair.any() else pairs
        hubs = pa.concat_arrays([pa.nulls(int(fresh_key.sum()), pa.int64()), pa.array(pairs[0])])
        k, c = np.concatenate([k[fresh_key], pairs[0] ^ pairs[1]]), np.concatenate([c[fresh_key], pairs[1]])
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), hubs, no_docs(len(k))], ["key", "cls", "hub", "doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, waiting = [], [], 0
        for batch in batches:
            for chunk in text_chunks(batch, "text", CHUNK):
                flat, sizes = shingle_sets(column(chunk, "text").to_pylist(), join.k)
                c1, c2 = class_hashes(flat, sizes)
                doc = pa.StructArray.from_arrays([column(chunk, "id"), pa.array(sizes), pa.array(c2)], fields=list(DOC))
                none = pa.nulls(len(sizes), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c1 ^ c2 ^ np.arange(len(c1))), pa.array(c1), none, doc], ["key", "cls", "hub", "doc"])
                found, of = join.pieces(flat, sizes)
                keys.append(found)
                classes.append(c1[of])
                waiting += len(found)
                if waiting > max_rows:
                    yield from sliced(flushed(keys, classes))
                    keys, classes, waiting = [], [], 0
        if waiting:
            yield from sliced(flushed(keys, classes))

    return docs.mapInArrow(run, "key bigint, cls bigint, hub bigint, doc struct<id: bigint, n: bigint, c2: bigint>")


def paired(rows: DataFrame) -> DataFrame:
    """``cls, hub, n, doc``: classes that share ``n`` pieces with a hub, and the documents.

    A task holds all rows of a key, which are one for each task before at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes, pairs = [], [], [np.zeros((2, 0), np.int64)]
        for batch in batches:
            doc, hub = column(batch, "doc"), column(batch, "hub")
            is_doc = pa.compute.is_valid(doc)
            docs = batch.filter(is_doc)
            if docs.num_rows:
                none = pa.nulls(docs.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([column(docs, "cls"), none, none, column(docs, "doc")], ["cls", "hub", "n", "doc"])
            is_pair = pa.compute.is_valid(hub).to_numpy(zero_copy_only=False)
            single = ~is_pair & ~is_doc.to_numpy(zero_copy_only=False)
            k, c = column(batch, "key").to_numpy(), column(batch, "cls").to_numpy()
            keys.append(k[single])
            classes.append(c[single])
            pairs.append(np.stack([hub.drop_null().to_numpy(), c[is_pair]]))
        if not keys:
            return
        k, c = np.concatenate(keys), np.concatenate(classes)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        fresh = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        hub = c[fresh][np.cumsum(fresh) - 1] if len(k) else c
        pairs.append(np.stack([hub[hub != c], c[hub != c]]))
        both, n = np.unique(np.concatenate(pairs, axis=1), axis=1, return_counts=True)
        yield from sliced(pa.RecordBatch.from_arrays([pa.array(both[1]), pa.array(both[0]), pa.array(n), no_docs(len(n))], ["cls", "hub", "n", "doc"]))

    return rows.repartition("key").mapInArrow(run, "cls bigint, hub bigint, n bigint, doc struct<id: bigint, n: bigint, c2: bigint>")


def sets_of(docs: DataFrame, join: Join) -> DataFrame:
    """``cls, n, shingles`` of rows of ``id, text``, and their sketches; the shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text", CHUNK):
                flat, sizes = shingle_sets(column(chunk, "text").to_pylist(), join.k)
                data = pa.py_buffer(flat.tobytes())
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32).tobytes())
                shingles = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets, data])
                numbers = [pa.array(c) for c in (class_hashes(flat, sizes)[0], sizes, *sketches(flat, sizes))]
                yield pa.RecordBatch.from_arrays([*numbers[:2], shingles, *numbers[2:]], names)

    names = ["cls", "n", "shingles", *SKETCHES]
    return docs.mapInArrow(run, "cls bigint, n bigint, shingles binary, " + ", ".join(f"{s} bigint" for s in SKETCHES))


def pieces_of(sets: DataFrame, join: Join) -> DataFrame:
    """``key, cls, n, rank`` for every indexed piece of distinct sets, each once; the rank says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = np.frombuffer(b"".join(column(batch, "shingles").to_pylist()), U64), column(batch, "n")
            keys, of = join.pieces(flat, n.to_numpy())
            order = np.lexsort((keys, of))
            keys, of = keys[order], of[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
            keys, of = keys[fresh], pa.array(of[fresh])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), column(batch, "cls").take(of), n.take(of)], ["key", "cls", "n"])

    return sets.select("cls", "n", "shingles").mapInArrow(run, "key bigint, cls bigint, n bigint").withColumn("rank", F.lit(0))


@dataclass(frozen=True)
class Buckets:
    """Per bucket of shingles: how many there are, and the smallest and largest
    component of their sets."""

    used: np.ndarray
    low: np.ndarray
    high: np.ndarray


#: Rows that a task's buckets take, each an array of neighbouring ones.
BUCKET_PARTS = 64


def shingle_buckets(sets: DataFrame) -> Buckets:
    """The buckets of all shingles of some sets with their ``label``.

    Tasks count into arrays and send them, as bytes, in ``BUCKET_PARTS`` rows,
    which are added up by part."""
    low_end, high_end = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    width = BUCKETS // BUCKET_PARTS
    names = ["part", "bucket", "used", "low", "high"]
    schema = "part int, bucket binary, used binary, low binary, high binary"

    def row(part: int, *counted: np.ndarray) -> pa.RecordBatch:
        found = np.flatnonzero(counted[0])
        packed = [pa.array([values.astype("<i8").tobytes()]) for values in (found, *(c[found] for c in counted))]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *packed], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, low, high = np.zeros(BUCKETS, np.int64), np.full(BUCKETS, low_end), np.full(BUCKETS, high_end)
        for batch in batches:
            sizes, label = column(batch, "n").to_numpy(), column(batch, "label").to_numpy()
            bucket = np.frombuffer(b"".join(column(batch, "shingles").to_pylist()), U64) % U64(BUCKETS)
            bucket, label = bucket.astype(np.int64), np.repeat(label, sizes)
            used += np.bincount(bucket, minlength=BUCKETS)
            np.minimum.at(low, bucket, label)
            np.maximum.at(high, bucket, label)
        for part in range(BUCKET_PARTS):
            own = slice(part * width, (part + 1) * width)
            if used[own].any():
                yield row(part, used[own], low[own], high[own])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, *packed in zip(*(column(batch, name).to_pylist() for name in names), strict=True):
                bucket, used, low, high = (np.frombuffer(p, "<i8") for p in packed)
                sums = total.setdefault(part, (np.zeros(width, np.int64), np.full(width, low_end), np.full(width, high_end)))
                sums[0][bucket] += used
                sums[1][bucket] = np.minimum(sums[1][bucket], low)
                sums[2][bucket] = np.maximum(sums[2][bucket], high)
        for part, sums in total.items():
            yield row(part, *sums)

    counted = sets.select("n", "shingles", "label").mapInArrow(count, schema)
    counted = in_tasks(counted.repartition("part"), BUCKET_PARTS).mapInArrow(add, schema)
    out = Buckets(np.zeros(BUCKETS, np.int64), np.full(BUCKETS, low_end), np.full(BUCKETS, high_end))
    for part, *packed in counted.collect():  # BUCKET_PARTS rows with BUCKETS entries at most
        bucket, used, low, high = (np.frombuffer(p, "<i8") for p in packed)
        at = part * width + bucket
        out.used[at], out.low[at], out.high[at] = used, low, high
    return out


def rare_shingles_of(sets: DataFrame, join: Join) -> DataFrame:
    """``key, cls, n, rank`` for the shingles of each set that come first in a
    common order, those in rarely used buckets.

    This is the finest partition: each segment holds one shingle.  Any common
    order finds all links, rare shingles first finds few others.  A shingle's
    rank bounds what two sets can share if it is the first they share.  Shingles
    whose bucket holds sets of one component only can't link components."""
    buckets = sets.sparkSession.sparkContext.broadcast(shingle_buckets(sets))  # three numbers for each of BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = buckets.value
        for batch in batches:
            keys, of, ranks = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, shingles in enumerate(column(batch, "shingles")):
                own = np.frombuffer(shingles.as_buffer(), U64)
                bucket = (own % U64(BUCKETS)).astype(np.int64)
                first = np.lexsort((own, b.used[bucket]))[: len(own) - join.smallest(len(own)) + 1]
                rank = np.flatnonzero(b.low[bucket[first]] != b.high[bucket[first]])
                keys.append(own[first[rank]])
                of.append(np.full(len(rank), i))
                ranks.append(rank)
            keys, of, ranks = np.concatenate(keys), pa.array(np.concatenate(of)), np.concatenate(ranks)
            columns = [pa.array(keys.view(np.int64)), column(batch, "cls").take(of), column(batch, "n").take(of), pa.array(ranks)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "cls", "n", "rank"])

    return sets.select("cls", "n", "shingles").mapInArrow(run, "key bigint, cls bigint, n bigint, rank bigint")


def verified(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs ``a, b`` with ``linked``: are their sets similar enough.  Pairs
    whose sketches tell that they aren't are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(column(batch, "set_a"), column(batch, "set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[at] == small).sum())
                linked.append(100 * common >= join.similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    def of(side: str) -> DataFrame:
        named = {"n": f"n_{side}", "shingles": f"set_{side}", **{s: f"{s}_{side}" for s in SKETCHES}}
        return sets.select(F.col("cls").alias(side), *[F.col(c).alias(name) for c, name in named.items()])

    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").where(join.alike("a", "b"))
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a bigint, b bigint, linked boolean")


def cells(pieces: DataFrame, counted: DataFrame, block: int) -> DataFrame:
    """Pieces with ``part``, ``i`` and ``j``, so that every two rows of a key meet.

    The rows of a key in ``counted``, with its ``n_rows``, are dealt out to parts
    of about ``block`` rows, and every two parts meet in a cell ``i, j``."""
    parts = F.coalesce(F.ceil(F.col("n_rows") / block), F.lit(1)).cast("int")
    rows = pieces.join(counted, "key", "left").withColumn("parts", parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cls"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.drop("parts", "n_rows").withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")


def near_pairs(pieces: DataFrame, join: Join, most: int = 200_000, waiting: int = 20_000) -> DataFrame:
    """``a, b``: the pairs of rows of a cell that lie in different components and
    can link by their sizes, ranks and sketches; a pair may come from several keys.

    A task goes through its cells in order and holds ``waiting`` rows, or
    those of a cell if these are more, and ``most`` pairs at once, or those of a row."""
    names = ["key", "i", "j", "part", "cls", "n", "rank", "label", *SKETCHES]

    def pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
        key, i, j, part, cls, n, rank, label = rows[:8]
        fresh = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        ends = np.concatenate([fresh, [len(key)]])
        partners = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(key)) - 1
        upto = np.cumsum(partners)
        start = 0
        while start < len(key):
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + most, "right")))
            count = partners[start:stop]
            x = np.repeat(np.arange(start, stop), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            start = stop
            common = np.minimum(n[x] - rank[x], n[y] - rank[y])
            may = (100 + join.similarity) * common >= join.similarity * (n[x] + n[y])
            may &= (label[x] != label[y]) & ((i[x] == j[x]) | (part[x] != part[y]))
            x, y = x[may], y[may]
            bits = sum(np.bitwise_count(s[x] ^ s[y]).astype(np.int64) for s in rows[8:].view(U64))
            alike = (100 + join.similarity) * bits <= (100 - join.similarity) * (n[x] + n[y])
            a, b = cls[x[alike]], cls[y[alike]]
            yield np.stack([np.minimum(a, b), np.maximum(a, b)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held, least = 0, waiting

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            both = np.concatenate([np.zeros((2, 0), np.int64), *pairs(rows)], axis=1)
            if both.size:
                both = np.unique(both, axis=1)
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"]))

        for batch in batches:
            held.append(np.stack([column(batch, name).to_numpy() for name in names]))
            n_held += batch.num_rows
            if n_held >= least:
                rows = np.concatenate(held, axis=1)
                # The last cell may go on in the next batch.
                last = int(np.flatnonzero((rows[:3] != rows[:3, -1:]).any(axis=0)).max(initial=-1)) + 1
                yield from found(rows[:, :last])
                held, n_held = [rows[:, last:]], n_held - last
                least = max(waiting, 2 * n_held)
        if n_held:
            yield from found(np.concatenate(held, axis=1))

    rows = pieces.select(*[F.col(name).cast("bigint").alias(name) for name in names])
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a bigint, b bigint")


def _nearby(rows: int, width: int = 64) -> Callable[[DataFrame], DataFrame]:
    """Broadcasts tables of so many counted rows of ``width`` bytes, a few numbers, if these are few."""
    return F.broadcast if rows * width <= BROADCAST_BYTES // 4 else lambda df: df


#: Rows of a few numbers for which another task is worth its start.
TASK_ROWS = 50_000


def in_tasks(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """A result of so many counted rows, at most, in as many tasks and files as
    they are worth, but no fewer than use all cores."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)))


def counted_table(df: DataFrame, name: str, which: Column | None = None) -> tuple[DataFrame, int]:
    """A table that is written and read back, and how many of its rows, or of those
    ``which`` holds for, were written; another job to count them costs the driver memory."""
    counted = Observation()
    table = written_table(df.observe(counted, F.count_if(F.lit(True) if which is None else which).alias("n")), name)
    return table, counted.get["n"]


def merge_labels(labels: DataFrame, links: DataFrame, n_sets: int, n_links: int | None = None) -> tuple[DataFrame, int]:
    """``cls, label`` after joining the components that links connect, and how
    many classes got another label.

    Every label that has a link to a smaller one is hung below the smallest
    such, and moves up two steps at once; again, until no link leads from one
    label to another.  Few links go to the labels, which then aren't shuffled."""
    n_links = links.count() if n_links is None else n_links
    if not n_links:
        return labels, 0
    near = _nearby(n_links)
    of_a = labels.select(F.col("cls").alias("a"), F.col("label").alias("la"))
    of_b = labels.select(F.col("cls").alias("b"), F.col("label").alias("lb"))
    pairs, moves = of_b.join(near(of_a.join(near(links), "a")), "b"), 0
    while True:
        # Links between the same labels act as one, and those within a label are done with.
        pairs = pairs.where("la != lb").select(F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")).distinct()
        pairs, n_pairs = counted_table(in_tasks(pairs, n_links), "label-pairs")
        if not n_pairs:
            return labels, moves
        parents = in_tasks(pairs.groupBy(F.col("lb").alias("label")).agg(F.min("la").alias("parent")), n_links)
        above = parents.select(F.col("label").alias("parent"), F.col("parent").alias("further"))
        parents = parents.join(near(above), "parent", "left").select("label", F.coalesce("further", "parent").alias("parent"))
        parents = written_table(in_tasks(parents, n_links), "parents")
        moved = labels.join(near(parents), "label", "left")
        moved = moved.select("cls", F.coalesce("parent", "label").alias("label"), F.col("parent").isNotNull().alias("moved"))
        moved, n_moved = counted_table(in_tasks(moved, n_sets), "labels", F.col("moved"))
        labels, moves = moved.select("cls", "label"), moves + n_moved
        for end in ("la", "lb"):
            up = parents.select(F.col("label").alias(end), F.col("parent").alias("up"))
            pairs = pairs.join(near(up), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")


@dataclass
class Search:
    """Links between components, found piece by piece."""

    join: Join
    sets: DataFrame
    labels: DataFrame
    n_sets: int

    def labelled(self, pieces: DataFrame) -> DataFrame:
        """Pieces with the labels of their sets; few labels go to the pieces."""
        return pieces.join(_nearby(self.n_sets)(self.labels), "cls")

    def mixed(self, pieces: DataFrame, n_pieces: int) -> tuple[DataFrame, int]:
        """The stored and counted pieces that lie in more than one component, stored and counted."""
        labelled = self.labelled(pieces)
        mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
        mixed, n_mixed = counted_table(in_tasks(mixed.select("key"), n_pieces), "mixed-keys")
        return counted_table(join_by_size(pieces, mixed, n_mixed, "key", max_bytes=BROADCAST_BYTES // 4), "mixed-pieces")

    def test(self, pairs: DataFrame, most: int) -> int:
        """Verify pairs ``a, b``, ``most`` at most; how many sets changed their component."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs, n_pairs = counted_table(in_tasks(pairs, most), "tested")
        if not n_pairs:
            return 0
        sets = self.sets
        if n_pairs * 64 <= BROADCAST_BYTES:  # else the semi join would move all sets once more
            ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
            sets = sets.join(F.broadcast(ids), "cls", "left_semi")
        found, n_links = counted_table(in_tasks(verified(pairs, sets, self.join), n_pairs, 5_000), "verified", F.col("linked"))
        self.labels, moves = merge_labels(self.labels, found.where("linked").select("a", "b"), self.n_sets, n_links)
        return moves

    def hubs(self, pieces: DataFrame, n_pieces: int, each: int = 4, least: float = 0.01) -> tuple[DataFrame, int]:
        """The stored and counted pieces that are mixed, after pairing their sets with hubs.

        While there would be more than ``each`` pairs across components for
        every row, each set is paired with a hub of one of its pieces, as long
        as that moves at least a share of ``least`` of the sets (once less, if any)."""
        pieces, n_pieces = self.mixed(pieces, n_pieces)
        turn, near = 0, _nearby(self.n_sets)
        while True:
            labelled = self.labelled(pieces)
            row = F.struct(*[F.col(c).alias(f"{c}_a") for c in ("cls", "n", "rank", "label")])
            some = F.min_by(row, F.xxhash64("cls", F.lit(turn))).alias("hub")
            # Stored, as it is read twice.
            per_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), some)
            per_label = written_table(in_tasks(per_label, n_pieces), "per-label")
            per_key = per_label.groupBy("key").agg(
                F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("labels")
            )
            per_key = in_tasks(per_key, n_pieces).where("labels > 1").withColumn("pairs", (F.col("n") * F.col("n") - F.col("within")) / 2)
            rows, pairs = per_key.agg(F.sum("n"), F.sum("pairs")).first()
            if not rows or pairs <= each * rows:
                return pieces, n_pieces
            turn += 1
            # Every set is paired by one of its pieces, with a set of the piece's
            # largest component, other ones every time.
            one = labelled.groupBy("cls").agg(F.max_by(F.struct("key", "n", "rank", "label"), F.xxhash64("key", F.lit(turn))).alias("p"))
            one = near(in_tasks(one.select("cls", "p.*"), self.n_sets))
            hub = per_label.groupBy("key").agg(F.max_by("hub", F.struct("n", "label")).alias("hub")).select("key", "hub.*")
            found = _named(one, "b").join(hub, "key").where((F.col("label_a") != F.col("label_b")) & self.join.fits("a", "b"))
            moves = self.test(found.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")), self.n_sets)
            if not moves or moves <= least * self.n_sets and turn >= 2:
                return pieces, n_pieces

    def across(self, pieces: DataFrame, n_pieces: int) -> None:
        """Verify all pairs that share a piece, lie in different components and can link.

        In a crowd that has much in common but hardly links, most pairs share
        pieces; the sketches rule out those that differ too much before they
        become rows.  Crowds are paired in blocks."""
        counted = in_tasks(pieces.groupBy("key").agg(F.count("*").alias("n_rows")), n_pieces).where(F.col("n_rows") > BLOCK)
        counted = _nearby(n_pieces // BLOCK)(counted)
        sketches = _nearby(self.n_sets, 64 + 8 * SKETCH)(self.sets.select("cls", *SKETCHES))
        rows = cells(self.labelled(pieces).join(sketches, "cls"), counted, BLOCK)
        self.test(*counted_table(near_pairs(rows, self.join), "near-pairs"))


def _named(pieces: DataFrame, side: str) -> DataFrame:
    return pieces.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "n", "rank", "label")])


def components(docs: DataFrame, join: Join = Join(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``id, n_shingles, component_id`` (smallest id that links reach)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    found, n_found = counted_table(paired(indexed(rows, join)), "pieces")
    members = found.where("doc is not null").select("doc.id", F.col("doc.n").alias("n_shingles"), F.col("cls").alias("c1"), "doc.c2")
    pairs = found.where("hub is not null").groupBy("cls", "hub").agg(F.sum("n").alias("n"))
    pairs, n_pairs = counted_table(in_tasks(pairs, n_found), "pairs")

    # The sets of all classes that share a piece with another one.
    active = pairs.select(F.col("cls").alias("c1")).union(pairs.select("hub")).distinct()
    active, n_active = counted_table(in_tasks(active, 2 * n_pairs), "active")
    reps = join_by_size(members, active, n_active, "c1").groupBy("c1").agg(F.min("id").alias("id")).select("id")
    reps, n_reps = counted_table(in_tasks(reps, n_active), "representatives")
    sets = sets_of(join_by_size(rows, reps, n_reps, "id"), join).dropDuplicates(["cls"])
    sets, n_sets = counted_table(in_tasks(sets, n_active, 5_000), "sets")

    # Every class with the hub it shares most pieces with, if their sizes allow it.
    search = Search(join, sets, sets.select("cls", F.col("cls").alias("label")), n_sets)
    near = _nearby(n_sets)
    of = lambda name: near(sets.select(F.col("cls").alias(f"cls_{name}"), F.col("n").alias(f"n_{name}"), F.lit(0).alias(f"rank_{name}")))
    first = pairs.select(F.col("cls").alias("cls_b"), F.col("hub").alias("cls_a"), "n").join(of("a"), "cls_a").join(of("b"), "cls_b")
    first = first.where(join.fits("a", "b")).groupBy(F.col("cls_b").alias("b")).agg(F.max_by("cls_a", F.struct("n", "cls_a")).alias("a"))
    search.test(in_tasks(first, n_sets), n_sets)
    pieces, n_pieces = search.hubs(*counted_table(pieces_of(sets, join), "set-pieces"))
    # Pieces that few sets share: all pairs across components.  The sets with
    # other pieces are indexed again, by their rarest ones.
    often = pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("key")
    often, n_often = counted_table(in_tasks(often, n_pieces), "often")
    if n_often:
        search.across(*counted_table(join_by_size(pieces, often, n_often, "key", "left_anti"), "pieces-of-few"))
        crowded = join_by_size(pieces, often, n_often, "key").select("cls").distinct()
        crowded, n_crowded = counted_table(in_tasks(crowded, n_sets), "crowded")
        labelled = written_table(search.labelled(join_by_size(sets, crowded, n_crowded, "cls")), "crowded-sets")
        rare = counted_table(rare_shingles_of(labelled, join), "rare-shingles")
        # Ranks rule most of these pairs out, so more of them are cheaper than another hub.
        search.across(*search.hubs(*rare, each=32))
    else:
        search.across(pieces, n_pieces)
    # Equal sets without any link are a component too.
    of_class = near(search.labels.select(F.col("cls").alias("c1"), "label"))
    grouped = members.join(of_class, "c1", "left").select(
        "id", "n_shingles", F.coalesce("label", "c1").alias("g1"), F.when(F.col("label").isNull(), F.col("c2")).otherwise(0).alias("g2")
    )
    least = grouped.where("n_shingles > 0").groupBy("g1", "g2").agg(F.min("id").alias("least"))
    result = grouped.join(least, ["g1", "g2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least"))
    return in_tasks(result.select("id", "n_shingles", component.alias("component_id")), n_found)


def join_by_size(large: DataFrame, ids: DataFrame, n_ids: int, key: str, how: str = "left_semi", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``large`` whose key is (or with ``left_anti`` is not) in a
    stored table of ``n_ids`` ids; the table is broadcast when its rows take
    less than ``max_bytes``."""
    return large.join(F.broadcast(ids) if n_ids * 64 <= max_bytes else ids, key, how)


def keep_one(docs: DataFrame, join: Join = Join(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.

    Documents without shingles or without an id stay, and rows that repeat the
    smallest id do too."""
    found = components(docs, join, text, doc_id)
    gone = found.where("id != component_id").select(F.col("id").alias(doc_id)).distinct()
    return join_by_size(docs, *counted_table(gone, "copies"), doc_id, "left_anti").select(*docs.columns)
