"""Problem 9: evaluation texts leaking into documents, by windowed MinHash containment and exact verification.

An item leaks if a document holds `run` consecutive words of it. A MinHash of whole texts says little about a short item in a long
document, so texts are partitioned into windows of the size asked for: every `run` consecutive words are the set of their
5-word shingles, and a window's signature is its least shingle under each of two hash functions. Equal windows have equal
signatures, so no leak is missed, and a signature stays the same over several neighbouring windows, so a text has fewer of them than
words. Signatures of documents and items are joined by equality (Catalyst broadcasts the items while their measured size is below
its threshold and shuffles both sides beyond), and the document-item pairs that meet are verified on whole texts. Sizes need no
further partition: what must be contained is `run` words of an item, whatever the item's own size, so every window has one size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.runtime import cut, table

SHINGLE, RUN = 5, 12
_WORD = re.compile(r"[^\W_]+")
_WORDS_KEPT = 200_000  # entries of a worker's word cache
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


_HASH = _Words()


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def signatures(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(text index, signature) of every window of `run` words, neighbours with equal signatures once."""
    split = [words(t) for t in texts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    code = np.fromiter((_HASH[w] for ws in split for w in ws), np.uint64, int(lens.sum()))
    if len(code) < run:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    shingles = code[: len(code) - SHINGLE + 1] * _ODD[0]
    for k in range(1, SHINGLE):
        shingles = shingles + _mix(code[k : len(code) - SHINGLE + 1 + k]) * _ODD[k]
    least = []
    for hashed in (_mix(shingles), _mix(shingles * _SECOND + np.uint64(1))):
        least.append(np.lib.stride_tricks.sliding_window_view(hashed, run - SHINGLE + 1).min(axis=1))
    sig = _mix(least[0] ^ (least[1] * _ODD[1]))
    ends = np.cumsum(lens)
    who = np.searchsorted(ends, np.arange(len(sig)), side="right")
    inside = np.arange(len(sig)) + run <= ends[who]
    who, sig = who[inside], sig[inside]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]))) if len(sig) else np.empty(0, bool)
    return who[new], sig[new]


def _signer(run: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, sig = signatures(b.column(1).to_pylist(), run)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who)), pa.array(sig.view(np.int64))], names=["id", "sig"])

    return signed


def runs(text: str, run: int) -> frozenset[tuple[str, ...]]:
    """Every `run` consecutive words of a text."""
    own = words(text)
    return frozenset(tuple(own[i : i + run]) for i in range(len(own) - run + 1))


def _verifier(run: int):
    """Pairs of one document come one after another: its words are read once. Items are few and short, so theirs are kept."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_item = lru_cache(maxsize=4096)(lambda text: runs(text, run))
        last, held = None, frozenset()
        for b in batches:
            good = []
            for doc, item in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if doc != last:
                    last, held = doc, runs(doc, run)
                good.append(not held.isdisjoint(of_item(item)))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["doc", "item"])

    return verified


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "probe_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(doc, item): each document that holds at least `run` consecutive words of an item, with that item.

    Words are runs of letters and digits, compared without case. Rows without id or text, and texts of fewer than `run` words, give
    nothing; repeated rows give one pair; empty tables give an empty result. Other columns are not read. run >= 5.
    """
    if run < SHINGLE:
        raise ValueError(f"run must be at least {SHINGLE}")
    d = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    i = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    asked = cut(i.mapInArrow(_signer(run), "id bigint, sig bigint").distinct()).withColumnRenamed("id", "item")
    offered = d.mapInArrow(_signer(run), "id bigint, sig bigint").withColumnRenamed("id", "doc")
    met = cut(offered.join(asked, "sig").select("doc", "item").distinct())
    with_item = met.join(i.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    with_doc = d.select(F.col("id").alias("doc"), "text").join(with_item, "doc")
    return with_doc.select("doc", "item", "text", "item_text").mapInArrow(_verifier(run), "doc bigint, item bigint").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "probes"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("probe_id"))
