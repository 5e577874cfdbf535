"""Quality rules: zstandard ratios in bands that depend on the length.

A text is kept if the ratio (bytes / compressed bytes) of the whole text and of each of its
fixed chunks lies inside the band of that piece's length: above it the text repeats itself,
below it the bytes are noise. Counts of words and repeats come along as base rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import slices, table, words_of

#: (bytes from, least ratio, greatest ratio). Prose gains with its length; frames make short texts look dense.
BANDS = (
    (0, 0.0, 2.0), (64, 0.75, 2.4), (128, 0.95, 2.5), (256, 1.15, 2.7), (512, 1.25, 2.9),
    (1024, 1.3, 3.1), (4096, 1.4, 3.4), (16384, 1.45, 3.8), (65536, 1.5, 4.2),
)
CHUNK_BYTES = 4096
LEVEL = 3
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, worst_low double, worst_high double, base_failed boolean, kept boolean"


def limits(n_bytes: int, bands: Sequence[tuple[int, float, float]] = BANDS) -> tuple[float, float]:
    """The band of a piece of `n_bytes` bytes."""
    return next((low, high) for start, low, high in reversed(bands) if n_bytes >= start)


def ratio_of(packer: zstandard.ZstdCompressor, raw: bytes) -> float:
    return len(raw) / len(packer.compress(raw)) if raw else 0.0


def bands_hold(raw: bytes, packer, bands=BANDS, chunk: int = CHUNK_BYTES) -> tuple[bool, float, float, float]:
    """(inside all bands, whole ratio, least and greatest ratio of a piece relative to its band)."""
    pieces = [raw]
    if len(raw) > chunk:
        pieces += [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    whole, low, high = ratio_of(packer, raw), np.inf, 0.0
    for k, piece in enumerate(pieces):
        got = whole if k == 0 else ratio_of(packer, piece)
        least, most = limits(len(piece), bands)
        low, high = min(low, got / least if least else np.inf), max(high, got / most)
    return low >= 1 and high <= 1, whole, float(min(low, 1e9)), float(high)


def repeated_words(lists: list[list[bytes]], width: int = 5) -> np.ndarray:
    """Per text, the words that stand in a window of `width` words found twice or more in it."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    out = np.zeros(len(lists), dtype=np.int64)
    total = int(sizes.sum())
    if total < width:
        return out
    doc = np.repeat(np.arange(len(lists)), sizes)
    ids = pd.factorize(np.array([w for x in lists for w in x], dtype=object))[0].astype(np.int64)
    # window ids grow by one word at a time, exactly: (id of the first k words, next word) renamed
    key = doc * (ids.max() + 1) + ids
    key = pd.factorize(key)[0].astype(np.int64)
    most = int(ids.max()) + 1
    for k in range(1, width):
        key = pd.factorize(key[: total - k] * most + ids[k:])[0].astype(np.int64)
    inside = doc[: total - width + 1] == doc[width - 1 :]
    seen = np.bincount(key[inside], minlength=int(key.max()) + 1)
    twice = inside & (seen[key] > 1)
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + width, -1)
    np.add.at(out, doc, (np.cumsum(step[:-1]) > 0).astype(np.int64))
    return out


def dup_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").split():
            n += line in seen
            seen.add(line)
    return n


def judge(texts: list[str | None], bands=BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> pd.DataFrame:
    """Counts and verdicts of a list of texts."""
    packer = zstandard.ZstdCompressor(level=level)
    lists = [words_of(t) for t in texts]
    n_words = np.array([len(x) for x in lists], dtype=np.int64)
    bands_of = [bands_hold((t or "").encode("utf-8", "surrogatepass"), packer, bands, chunk) for t in texts]
    chars = [sum(len(p) for p in re.findall(r"[^\x20\x09-\x0D]+", t)) if t else 0 for t in texts]
    repeat = repeated_words(lists)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    return pd.DataFrame({
        "n_words": n_words, "word_chars": np.array(chars, dtype=np.int64),
        "n_symbols": np.array([len(SYMBOLS.findall(t)) if t else 0 for t in texts], dtype=np.int64),
        "n_dup_lines": np.array([dup_lines(t) if t else 0 for t in texts], dtype=np.int64),
        "n_repeat_words": repeat, "ratio": [b[1] for b in bands_of], "worst_low": [b[2] for b in bands_of],
        "worst_high": [b[3] for b in bands_of], "base_failed": failed,
        "kept": ~failed & np.array([b[0] for b in bands_of], dtype=bool),
    })


def compression_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """One row per document: id, counts, ratios, `base_failed`, `kept`.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged
    each; an empty table gives an empty result; other columns are not read.
    """
    chosen = docs.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                got = judge(part.column(1).to_pylist(), bands, chunk, level)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(got[c]) for c in got.columns)], [id_col, *got.columns]
                )

    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk: int = CHUNK_BYTES, level: int = LEVEL) -> DataFrame:
    """The rows of `docs` whose text is kept, all columns unchanged, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                kept = judge(texts, bands, chunk, level)["kept"].to_numpy()
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


@query("op4_compression_quality")
def op4(spark, sf_dir):
    return compression_quality(table(spark, sf_dir, "documents"))
