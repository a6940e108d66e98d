"""Token counts of sections: whole documents are encoded once and their tokens attributed by offset.

Each document is encoded as one text. The byte lengths of its tokens, summed,
give their spans; sections are spans of the same text, and both are sorted, so
the interval join is one binary search of the tokens among the section starts.
A token that crosses a boundary goes to one section by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("most", "start", "end")
MOST_RANKS = 64 << 20

_LOADED: dict[bytes, tuple] = {}


def _encoding(ranks: bytes):
    """The encoding of a rank file and the byte length of each token, kept for the life of a worker."""
    key = ranks[:64] + len(ranks).to_bytes(8, "big")
    if key not in _LOADED:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        length = np.zeros(max(table.values()) + 1, np.int64)
        for piece, i in table.items():
            length[i] = len(piece)
        _LOADED[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), length
    return _LOADED[key]


def attribute(starts: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token.

    Tokens are [starts[i], starts[i + 1]); sections begin at ``cuts`` and end
    where the next begins. A token inside of one section belongs to it. One
    that crosses boundaries goes to the section that holds its first byte
    ("start"), its last byte ("end"), or most of its bytes, the earliest of
    equals ("most").
    """
    first = np.searchsorted(cuts, starts[:-1], side="right") - 1
    last = np.searchsorted(cuts, starts[1:] - 1, side="right") - 1
    if rule == "start":
        return first
    if rule == "end":
        return last
    out = first.copy()
    for i in np.flatnonzero(first != last):
        edges = np.clip(cuts[first[i] : last[i] + 2], starts[i], starts[i + 1])
        if len(edges) < last[i] - first[i] + 2:
            edges = np.append(edges, starts[i + 1])
        out[i] = first[i] + int(np.argmax(np.diff(edges)))
    return out


def _count(ranks, rule: str, separator: bytes):
    schema = pa.schema([("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = _encoding(ranks.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw, at = utf8(batch.column("text"))
                texts = batch.column("text").to_pylist()
                parts: list[list[np.ndarray]] = [[] for _ in schema]
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                breaks = np.flatnonzero(raw == separator[0]) + 1
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    a, b = int(at[i]), int(at[i + 1])
                    ids = encoding.encode_to_numpy(texts[i], disallowed_special=()) if b > a else np.empty(0, np.int64)
                    starts = np.concatenate(([0], np.cumsum(length[ids])))
                    if starts[-1] != b - a:
                        raise ValueError(f"the tokens of document {doc} don't cover its text")
                    inner = breaks[np.searchsorted(breaks, a, side="right") : np.searchsorted(breaks, b)]
                    cuts = np.concatenate(([0], inner - a))
                    where = attribute(starts, cuts, rule)
                    counts = np.bincount(where, minlength=len(cuts))
                    crossing = np.searchsorted(cuts, starts[:-1], side="right") != np.searchsorted(cuts, starts[1:] - 1, side="right")
                    crossed = np.bincount(where[crossing], minlength=len(cuts))
                    ends = np.append(cuts[1:], b - a)
                    base = chars[a]
                    for part, values in zip(
                        parts,
                        (None, np.arange(len(cuts)), chars[a + cuts] - base, chars[a + ends] - base, counts, crossed, np.full(len(cuts), len(ids))),
                        strict=True,
                    ):
                        part.append(pa.array([doc] * len(cuts), pa.int64()) if values is None else values)
                arrays = [pa.concat_arrays(parts[0]) if parts[0] else pa.array([], pa.int64())]
                arrays += [pa.array(np.concatenate(p).astype(np.int64)) if p else pa.array([], pa.int64()) for p in parts[1:]]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def count_tokens(docs: DataFrame, ranks: str = RANKS, rule: str = "most", separator: str = "\n") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing, doc_tokens): one row for each section of ``docs(doc_id, text)``.

    A section ends after each ``separator`` (one ASCII character) and at the
    end of the text; ``start`` and ``end`` count code points. ``n_tokens`` are
    the tokens that ``rule`` gives to the section ("most", "start" or "end",
    see ``attribute``), ``n_crossing`` those of them that cross a boundary, and
    the ``n_tokens`` of a document add up to ``doc_tokens``, the tokens of its
    whole text.

    Null and empty texts have one empty section without tokens. A null doc_id
    stays null; repeated rows are counted as often as they occur; other columns
    are ignored; an empty table gives an empty result. ``ranks`` is read on the
    driver, at most ``MOST_RANKS`` bytes, and broadcast.
    """
    if rule not in RULES or len(separator.encode()) != 1:
        raise ValueError("unknown rule, or a separator that is not one ASCII character")
    with open(ranks, "rb") as file:
        data = file.read(MOST_RANKS + 1)
    if len(data) > MOST_RANKS:
        raise ValueError("the rank file is too large to broadcast")
    held = docs.sparkSession.sparkContext.broadcast(data)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_count(held, rule, separator.encode()), "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long")
