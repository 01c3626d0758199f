"""Token counts of fields or sections, from one encoding of the whole text.

A text is encoded once, so that no token depends on where sections are cut.
The tokens' spans are joined with the sections' by binary search, and every
token is given to one section:

* ``most``: the one that holds most of the token's bytes, the earlier if two hold as many;
* ``first``: the one that holds its first byte.

So the counts of a text's sections sum up to its tokens.  ``n_shared`` counts
those given tokens of which another section holds a part.

A section ends behind each line end, and at the end of the text.  Empty and
null texts have one empty section; fields may be null or empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventweir.llm.bpe import Bpe, release, vocabulary
from eventweir.llm.text import column, fields, text_chunks

RULES = ("most", "first")


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of every token, and whether other sections hold a part of it.

    Both arrays are ascending ends in bytes, and both cover the same bytes."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    shared = first != last
    if rule == "most":
        for t in np.flatnonzero(shared).tolist():
            cuts = [starts[t], *section_ends[first[t] : last[t]], token_ends[t]]
            first[t] += int(np.argmax(np.diff(cuts)))
    return first, shared


def section_counts(bpe: Bpe, texts: list[str], rule: str) -> dict[str, np.ndarray]:
    """Rows for all sections of some texts: ``doc`` is the text's place."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc_ends = np.cumsum([len(r) for r in raw])
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, doc_ends[doc_ends > 0]]))
    ids, _ = bpe.encode(texts)
    section, shared = allocate(np.cumsum(bpe.token_length[ids]), ends, rule)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    empty = np.flatnonzero(np.diff(np.concatenate([[0], doc_ends])) == 0)
    none = np.zeros(len(empty), np.int64)
    doc = np.concatenate([np.searchsorted(doc_ends, ends - 1, side="right"), empty])
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    place = np.arange(len(doc))
    rows = {
        "n_chars": np.concatenate([chars[ends] - chars[starts], none])[order],
        "n_tokens": np.concatenate([np.bincount(section, minlength=len(ends)), none])[order],
        "n_shared": np.concatenate([np.bincount(section[shared], minlength=len(ends)), none])[order],
    }
    return {"doc": doc, "section": place - np.maximum.accumulate(np.where(fresh, place, 0))} | rows


def count_sections(df: DataFrame, path: str, rule: str = "most", text: str = "text") -> DataFrame:
    """A row per section of every text: the other columns, ``section`` (from 0),
    ``n_chars`` (code points), ``n_tokens`` and ``n_shared``."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    made = ["section", "n_chars", "n_tokens", "n_shared"]
    others = [c for c in df.columns if c != text and c not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for chunk in text_chunks(batch, text):
                rows = section_counts(bpe, [t or "" for t in column(chunk, text).to_pylist()], rule)
                of = pa.array(rows["doc"])
                values = [pa.array(rows[m].astype(np.int64)) for m in made]
                yield pa.RecordBatch.from_arrays([*[column(chunk, c).take(of) for c in others], *values], [*others, *made])
        release(bpe)

    return df.mapInArrow(run, ", ".join(filter(None, [fields(df, *others), *[f"{m} bigint" for m in made]])))


def count_fields(df: DataFrame, path: str, names: list[str], rule: str = "most") -> DataFrame:
    """Token counts of some text columns, encoded as one text with a line end
    behind each: the other columns and ``n_tokens_<name>`` for every name.

    Line ends within a field count to the field."""
    row, lines = F.struct(*[c for c in df.columns if c not in names]).alias("row"), []
    for name in names:
        lines.append(F.concat(F.coalesce(F.col(name), F.lit("")), F.lit("\n")))
    # A field with n line ends of its own takes n + 1 sections.
    n_lines = [F.size(F.split(line, "\n", -1)) - 1 for line in lines]
    whole = df.select(row, F.monotonically_increasing_id().alias("id"), F.array(*n_lines).alias("n_lines"), F.concat(*lines).alias("text"))
    counts = count_sections(whole, path, rule).where("n_tokens > 0 or section = 0")
    sums, upto = [], F.lit(0)
    for i, name in enumerate(names):
        inside = (F.col("section") >= upto) & (F.col("section") < upto + F.col("n_lines")[i])
        sums.append(F.sum(F.when(inside, F.col("n_tokens")).otherwise(0)).alias(f"n_tokens_{name}"))
        upto = upto + F.col("n_lines")[i]
    result = counts.groupBy("id").agg(F.first("row").alias("row"), *sums)
    return result.select("row.*", *[f"n_tokens_{name}" for name in names])
