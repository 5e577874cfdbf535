"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (of words between blanks, lower
case) in order of rank. A document is compared by its own most frequent n-grams: the sum of
the places by which they are out of rank; the closest profile wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icestats.llm.base import query
from icestats.llm.common import slices, table

#: Learned from at most about so many labelled documents of each language, chosen by a hash of id and text.
SAMPLE_PER_LANGUAGE = 2000
PROFILE = 400
DOC_GRAMS = 300


LETTERS = re.compile(r"[^\W\d_]+")
BITS = 21  # of a code point; n-grams up to three fit a signed long and sort in code-point order


def pack(gram: str) -> int:
    codes = [*map(ord, gram), 0, 0, 0][:3]
    return codes[0] << 2 * BITS | codes[1] << BITS | codes[2]


def unpack(code: int) -> str:
    parts = (code >> 2 * BITS, code >> BITS & 0x1FFFFF, code & 0x1FFFFF)
    return "".join(map(chr, filter(None, parts)))


def word_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of one to three characters of marked words: (distinct packed grams in order, id of each, words' borders)."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    one, two, three = text[:-1], text[1:], np.append(text[2:], 32)
    stacked = np.stack([one << 2 * BITS, one << 2 * BITS | two << BITS, one << 2 * BITS | two << BITS | three], axis=1)
    real = np.stack([one != 32, np.ones(len(one), bool), two != 32], axis=1)
    real[-1, 2] = False  # beyond the end
    word = np.cumsum(one == 32) - 1
    width = np.bincount(word, weights=real.sum(axis=1), minlength=len(words)).astype(np.int64)
    known, ids = np.unique(stacked[real], return_inverse=True)
    return known, ids.astype(np.int32), np.concatenate([[0], np.cumsum(width)])


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Distinct packed grams, and (document, gram ids, counts) of each document with a letter, over whole texts."""
    parts = [LETTERS.findall(t.lower()) if t else [] for t in texts]
    words = [w for p in parts for w in p]
    if not words:
        return np.zeros(0, np.int64), iter(())
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    known, flat, border = word_grams(distinct)
    width = np.diff(border)

    def each() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        end = 0
        for k, p in enumerate(parts):
            start, end = end, end + len(p)
            if not p or not any(c.isalpha() for c in texts[k]):
                continue
            code, times = np.unique(codes[start:end], return_counts=True)
            reps = width[code]
            at = np.repeat(border[code] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            if len(at) * 50 > len(known):
                n = np.bincount(flat[at], weights=np.repeat(times, reps), minlength=len(known))
                ids = np.flatnonzero(n)
                yield k, ids, n[ids].astype(np.int64)
            else:
                ids, back = np.unique(flat[at], return_inverse=True)
                yield k, ids, np.bincount(back, weights=np.repeat(times, reps)).astype(np.int64)

    return known, each()


def top(ids: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent ids, ties in order of id."""
    if len(n) > most:
        keep = n >= np.partition(n, len(n) - most)[len(n) - most]
        ids, n = ids[keep], n[keep]
    return ids[np.lexsort((ids, -n))][:most]


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE, profile: int = PROFILE) -> dict[str, list[str]]:
    """Profiles by language, from at most about `sample` labelled documents each (chosen by hash)."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    picked = rows.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                langs = part.column(1).to_pylist()
                known, each = gram_counts(part.column(0).to_pylist())
                total: dict[str, np.ndarray] = {}
                for k, ids, n in each:
                    total.setdefault(langs[k], np.zeros(len(known), np.int64))[ids] += n
                for lang, n in total.items():
                    ids = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(known[ids]), pa.array(n[ids])], ["lang", "gram", "n"])

    best = (
        picked.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(_by_lang()))
        .where(F.col("rank") <= profile)
    )
    out: dict[str, list[str]] = {}
    for r in sorted(best.select("lang", "rank", "gram").collect()):
        out.setdefault(r["lang"], []).append(unpack(r["gram"]))
    return out


def _by_lang():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.desc("n"), "gram")


def nearest(texts: list[str | None], profiles: dict[str, list[str]], doc_grams: int = DOC_GRAMS) -> tuple[list[str], list[float]]:
    """Language and score of each text: 1 - distance / greatest distance; ties go to the first name."""
    langs = sorted(profiles)
    langs_out, scores = ["und"] * len(texts), [0.0] * len(texts)
    known, each = gram_counts(texts)
    if not langs or not len(known):
        return langs_out, scores
    worst = max(len(p) for p in profiles.values())
    rank = np.full((len(langs), len(known)), -1, dtype=np.int64)
    for row, lang in enumerate(langs):
        packed = np.array([pack(g) for g in profiles[lang]], dtype=np.int64)
        at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
        hit = known[at] == packed
        rank[row, at[hit]] = np.flatnonzero(hit)
    for k, ids, n in each:
        best = top(ids, n, doc_grams)
        own = rank[:, best]
        places = np.where(own < 0, worst, np.abs(np.arange(len(best)) - own)).sum(axis=1)
        most = worst * len(best)
        win = int(np.argmin(places))
        langs_out[k], scores[k] = langs[win], float(max(0.0, 1.0 - places[win] / most))
    return langs_out, scores


def identify(docs: DataFrame, profiles: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", doc_grams: int = DOC_GRAMS) -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    Null texts, texts without a letter and an empty profile set give `und` with score 0.
    Repeated rows are judged each; other columns are not read.
    """
    chosen = docs.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                lang, score = nearest(part.column(1).to_pylist(), profiles, doc_grams)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"]
                )

    kind = chosen.schema[id_col].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op2_language_profiles")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.where(~held_out()))
    return identify(docs, profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
