"""Term features as long tables (id, term, ...): counts, TF-IDF over word and character n-grams, chi-squared selection.

A vocabulary is a table; only one cut to `max_terms` is sent to tasks whole (`text_weights`). It is cut to its commonest terms only where the operator says so (max_terms, the
feature of the vectoriser), with ties by term.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from postmill.runtime import cut

# Fixed value: white space as `(?U)\\s` of the JVM has it.
_WORD = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
AT_ONCE = 1 << 18  # n-grams that are sorted at once
HELD = 1 << 20  # characters of distinct words a task holds before it starts anew


def _joined(tokens: Column, n: int):
    return lambda i: F.array_join(F.slice(tokens, i, n), " ")


def _cut(word: Column, n: int):
    return lambda i: F.substr(word, i, F.lit(n))


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """n-grams of an array of tokens, n from low to high, joined by a blank."""
    out = None
    for n in range(low, high + 1):
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, _joined(tokens, n))
        out = grams if out is None else F.concat(out, grams)
    return out


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words, each word padded with a blank on either side; a word shorter than n gives itself once."""
    padded = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\S+"), F.lit(0)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(word: Column) -> Column:
        out = None
        for n in range(low, high + 1):
            starts = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
            own = F.transform(starts, _cut(word, n))
            if n > low:  # a word shorter than n gave itself at its own length
                own = F.when(F.length(word) >= n, own).otherwise(F.array().cast("array<string>"))
            out = own if out is None else F.concat(out, own)
        return out

    return F.flatten(F.transform(padded, grams))


def take_apart(words: list[str], low: int, high: int, terms: list[str] = []) -> tuple[np.ndarray, np.ndarray, str, np.ndarray, np.ndarray]:
    """The n-grams of distinct words as `char_ngrams` has them, numbered: (numbers, one word after the other; where each word's begin, and
    the end; all words as one string; by number, where in it the n-gram stands and its length).

    An n-gram's number is that of the n-gram one shorter at its start and its last character, so numbers are exact in any alphabet.
    `terms` follow the words, each an n-gram as it is.
    """
    whole = len(words)
    words = words + terms
    text = "".join(words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(size) - size
    single = (size < low) | (np.arange(len(words)) >= whole)
    counts = {n: np.where(single, size == n, np.maximum(size - n + 1, 0) if n >= low else 0).astype(np.int64) for n in range(1, high + 1)}
    starts = np.concatenate(([0], np.cumsum(sum(counts.values()), dtype=np.int64)))
    numbers, place = np.empty(starts[-1], np.int64), starts[:-1].copy()
    word, at, rank = np.repeat(np.arange(len(words)), size), np.arange(len(code)), np.zeros(len(code), np.int64)
    named, first, length = 0, [], []
    for n in range(1, high + 1):
        fits = at + n <= (begins + size)[word]
        word, at, rank = word[fits], at[fits], rank[fits]
        keys = rank << 21 | code[at + n - 1]
        order = np.argsort(keys)
        keys = keys[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(new) - 1
        given = counts[n][word] > 0
        if given.any():
            numbers[place[word[given]] + at[given] - begins[word[given]]] = rank[given] + named
            first.append(at[order[new]])
            length.append(np.full(len(first[-1]), n))
            named += len(first[-1])
        place += counts[n]
    return numbers, starts, text, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, length))


class Rows:
    """Lower-case texts as numbers of distinct words, each between two blanks."""

    def __init__(self):
        self.words: dict[str, int] = defaultdict(itertools.count().__next__)
        self.texts, self.met, self.lens, self.size, self.chars, self.own = [], [], [], 0, 0, 0

    def add(self, text: str) -> None:
        found = _WORD.findall(text)
        self.texts.append(text), self.lens.append(len(found))
        self.met.append(np.fromiter(map(self.words.__getitem__, found), np.int64, len(found)))
        self.size += len(text)
        self.chars += sum(map(len, itertools.islice(reversed(self.words), len(self.words) - self.own)))
        self.own = len(self.words)

    def full(self, most: int) -> bool:
        return self.chars >= most or self.size >= 16 * most

    def padded(self) -> list[str]:
        return [f" {w} " for w in self.words]

    def counts(self, numbers: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, number, tf), by row, of a few rows at a time; numbers and starts are those of `take_apart`; a negative number is left out."""
        sizes = np.diff(starts)
        begin = held = 0
        for k, own in enumerate(self.met + [None]):
            if own is not None:
                held += int(sizes[own].sum())
            if own is None or held > AT_ONCE:
                end = min(k + 1, len(self.met))
                words = np.concatenate(self.met[begin:end]) if end > begin else np.zeros(0, np.int64)
                many = sizes[words]
                at = np.repeat(starts[words] - np.cumsum(many) + many, many) + np.arange(many.sum())
                number = numbers[at]
                keys = (np.repeat(np.repeat(np.arange(begin, end) << 32, self.lens[begin:end]), many) | number)[number >= 0]
                keys.sort()
                if len(keys):
                    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    yield keys[first] >> 32, keys[first] & 0xFFFFFFFF, np.diff(np.append(first, len(keys)))
                begin, held = end, 0


def char_counts(df: DataFrame, low: int = 2, high: int = 5, id_col: str = "msg_id", text_col: str = "text") -> DataFrame:
    """(id, term, tf): the n-grams of `char_ngrams`, counted row by row in one pass over Arrow batches, so that only distinct n-grams of a row leave it. Null texts have none."""
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = Rows()
            for text in b.column(1).to_pylist():
                own.add(text)
            numbers, starts, joined, first, length = take_apart(own.padded(), low, high)
            for row, number, tf in own.counts(numbers, starts):
                some, place = np.unique(number, return_inverse=True)
                terms = [joined[i : i + n] for i, n in zip(first[some].tolist(), length[some].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(terms, pa.string()).take(pa.array(place)), pa.array(tf)], names=["id", "term", "tf"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, term string, tf bigint")


def _with_grams(low: int, high: int, most: int):
    """(id, text) -> (chunk, id, text, term, n): the rows, and for each chunk of them its n-grams with the number of its rows that have them. A chunk's low 32 bits are its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, own = TaskContext.get().partitionId(), Rows()

        def out(ids: pa.Array, texts: list[str], terms: list[str], counts: list[int]) -> pa.RecordBatch:
            k, m = len(texts), len(terms)
            columns = [np.full(k + m, chunk), pa.concat_arrays([ids, pa.nulls(m, ids.type)]), texts + [None] * m, [None] * k + terms, [None] * k + counts]
            kinds = [pa.int64(), ids.type, pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) if not isinstance(x, pa.Array) else x for x, kind in zip(columns, kinds)], names=["chunk", "id", "text", "term", "n"])

        def grams(none: pa.Array) -> pa.RecordBatch:
            numbers, starts, joined, first, length = take_apart(own.padded(), low, high)
            n = np.zeros(len(first), np.int64)
            for _, number, _ in own.counts(numbers, starts):
                n += np.bincount(number, minlength=len(n))
            return out(none, [], [joined[i : i + k] for i, k in zip(first.tolist(), length.tolist())], n.tolist())

        none = None
        for b in batches:
            texts, sent, none = b.column(1).to_pylist(), 0, b.column(0)[:0]
            for k, text in enumerate(texts):
                own.add(text)
                if own.full(most):
                    yield out(b.column(0)[sent : k + 1], texts[sent : k + 1], [], [])
                    yield grams(none)
                    chunk, own, sent = chunk + (1 << 32), Rows(), k + 1
            yield out(b.column(0)[sent:], texts[sent:], [], [])
        if own.texts:
            yield grams(none)

    return run


def _lengths(low: int, high: int):
    """(chunk, id, text, term, idf), each chunk's n-grams before its rows -> (id, n_terms, top, total, squares) over the n-grams that have an idf. Holds one chunk."""

    def sums(ids: list[pa.Array], texts: list[str], terms: list[str], idf: list[float]) -> Iterator[pa.RecordBatch]:
        own = Rows()
        for text in texts:
            own.add(text)
        numbers, starts, _, first, _ = take_apart(own.padded(), low, high, terms)
        words, places = len(own.words), pa.chunked_array(ids).combine_chunks() if ids else None
        weights = np.zeros(len(first))
        weights[numbers[starts[words] :]] = idf  # an idf is 1 or more
        numbers[weights[numbers] == 0] = -1
        for row, number, tf in own.counts(numbers, starts[: words + 1]):
            w = (np.log(tf) + 1) * weights[number]
            at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            made = np.diff(np.append(at, len(row))), np.maximum.reduceat(w, at), np.add.reduceat(w, at), np.add.reduceat(w * w, at)
            yield pa.RecordBatch.from_arrays([places.take(pa.array(row[at])), *map(pa.array, made)], names=["id", "n_terms", "top", "total", "squares"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going, ids, texts, terms, idf = None, [], [], [], []
        for b in batches:
            chunks = b.column(0).to_numpy()
            edges = np.flatnonzero(chunks[1:] != chunks[:-1]) + 1
            for a, z in itertools.pairwise([0, *edges.tolist(), len(chunks)] if len(chunks) else []):
                if chunks[a] != going:
                    yield from sums(ids, texts, terms, idf)
                    going, ids, texts, terms, idf = chunks[a], [], [], [], []
                named = (z - a) - b.column(3)[a:z].null_count
                terms += b.column(3)[a : a + named].to_pylist()
                idf += b.column(4)[a : a + named].to_pylist()
                texts += b.column(2)[a + named : z].to_pylist()
                ids.append(b.column(1)[a + named : z])
        yield from sums(ids, texts, terms, idf)

    return run


def char_tfidf_lengths(df: DataFrame, n_rows: DataFrame, min_df: int, low: int = 2, high: int = 5, id_col: str = "msg_id", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(id, n_terms, top, total): number, largest and sum of a row's sublinear TF-IDF weights of length 1 over the n-grams of `char_ngrams` in `min_df` rows or more. Rows without such n-grams are left out.

    A row has hundreds of n-grams, so (id, term, tf) would take many times the disk of the texts. Instead each task counts, chunk by chunk
    of its rows, in how many each n-gram stands; only these counts are shuffled, and each chunk's n-grams come back with their idf to the
    chunk's rows, whose n-grams are counted again. Texts of a repeated id are one row. n_rows: one row with column n;
    held: characters of distinct words that end a chunk.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).filter("text is not null")
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("id").alias("again"))
    if not again.isEmpty():
        same = F.col("id").eqNullSafe(F.col("again"))
        joined = rows.join(again, same).groupBy("id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
        rows = cut(rows.join(again, same, "left_anti").union(joined))
    of = rows.rdd.getNumPartitions()
    chunks = cut(rows.mapInArrow(_with_grams(low, high, held), f"chunk bigint, id {kind}, text string, term string, n bigint"))
    terms = chunks.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df"), F.collect_list("chunk").alias("chunks")).filter(F.col("df") >= min_df)
    idf = terms.crossJoin(F.broadcast(n_rows)).select(F.explode("chunks").alias("chunk"), "term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    idf = idf.select("chunk", F.lit(None).cast(kind).alias("id"), F.lit(None).cast("string").alias("text"), "term", "idf")
    texts = chunks.filter("term is null").select("chunk", "id", "text", "term", F.lit(None).cast("double").alias("idf"))
    met = texts.union(idf).repartitionById(of, F.col("chunk").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).sortWithinPartitions("chunk", F.col("term").isNull())
    sums = met.mapInArrow(_lengths(low, high), f"id {kind}, n_terms bigint, top double, total double, squares double")
    norm = F.sqrt("squares")
    return sums.filter("id is not null").select("id", "n_terms", (F.col("top") / norm).alias("top"), (F.col("total") / norm).alias("total"))


def term_counts(df: DataFrame, terms: Column, id_col: str = "msg_id") -> DataFrame:
    """(id, term, tf)."""
    return df.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """(term, df, total): terms in at least `min_df` rows, the `max_terms` commonest."""
    terms = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    return terms.orderBy(F.desc("total"), "term").limit(max_terms) if max_terms else terms


def tfidf(counts: DataFrame, vocab: DataFrame, n_rows: DataFrame, sublinear: bool = False, normalised: bool = True) -> DataFrame:
    """(id, term, w): tf (or 1 + ln tf) times ln((1 + n) / (1 + df)) + 1, each row's weights of length 1. n_rows: one row with column n."""
    tf = F.log("tf") + 1 if sublinear else F.col("tf").cast("double")
    idf = vocab.crossJoin(F.broadcast(n_rows)).select("term", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    raw = counts.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    if not normalised:
        return raw
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("w"))


def chi_squared(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, chi2) over the weight mass of each class. labels: (id, label); expected mass follows the classes' share of rows."""
    rows = weights.select("id").distinct().join(labels, "id")
    share = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = share.agg(F.sum("n").alias("all_n"))
    share = share.crossJoin(F.broadcast(total)).select("label", (F.col("n") / F.col("all_n")).alias("p"))
    mass = weights.groupBy("term").agg(F.sum("w").alias("mass"))
    seen = weights.join(labels, "id").groupBy("term", "label").agg(F.sum("w").alias("o"))
    cells = mass.crossJoin(F.broadcast(share)).join(seen, ["term", "label"], "left").select("term", (F.col("mass") * F.col("p")).alias("e"), F.coalesce("o", F.lit(0.0)).alias("o"))
    return cells.groupBy("term").agg(F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2"))


def top(scores: DataFrame, by: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(by), "term").limit(k)


def _words_of(tokens: list[str] | None) -> Counter[str]:
    """Words and pairs of neighbours, as `word_ngrams` from 1 to 2."""
    own = Counter(tokens or [])
    own.update(map(" ".join, itertools.pairwise(tokens or [])))
    return own


def totals(rows: DataFrame, low: int = 2, high: int = 5, most: int = HELD) -> DataFrame:
    """(half, term, df, total) of (tokens, text): half 0 the words and pairs of `tokens`, half 1 the n-grams of `char_ngrams` of lower-case `text`, each with its rows and its number. Tasks count before the shuffle."""

    def out(half: int, terms: list[str], df: list[int], total: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([half] * len(terms), pa.int32()), pa.array(terms, pa.string()), pa.array(df, pa.int64()), pa.array(total, pa.int64())], names=["half", "term", "df", "total"])

    def grams(own: Rows) -> pa.RecordBatch:
        numbers, starts, joined, first, length = take_apart(own.padded(), low, high)
        df, total = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for _, number, tf in own.counts(numbers, starts):
            df += np.bincount(number, minlength=len(df))
            total += np.bincount(number, tf, len(total)).astype(np.int64)
        return out(1, [joined[i : i + k] for i, k in zip(first.tolist(), length.tolist())], df.tolist(), total.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, df, total = Rows(), Counter(), Counter()
        for b in itertools.chain(batches, [None]):
            for tokens, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if b is not None else ():
                words = _words_of(tokens)
                df.update(words.keys()), total.update(words)
                own.add(text or "")
                if own.full(most):
                    yield grams(own)
                    own = Rows()
            if b is None or len(df) >= most:
                yield out(0, list(df), list(df.values()), [total[t] for t in df])
                df, total = Counter(), Counter()
        yield grams(own)

    made = rows.select("tokens", F.lower("text").alias("text")).mapInArrow(run, "half int, term string, df bigint, total bigint")
    return made.groupBy("half", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def text_weights(rows: DataFrame, words: tuple[list[str], np.ndarray], grams: tuple[list[str], np.ndarray], low: int = 2, high: int = 5) -> DataFrame:
    """(id, i, w) of (id, tokens, text): indices, words before n-grams, and sublinear TF-IDF weights, each half of length 1, in one pass. words, grams: terms in the order of their index and their idf; every task holds them, as their number is the vectoriser's `max_terms`."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((words, grams))

    def unit(row: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
        w = (np.log(tf) + 1) * idf
        return w / np.sqrt(np.bincount(row, w * w, n))[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (terms, idf), (parts, part_idf) = sent.value
        known = {t: k for k, t in enumerate(terms)}
        for b in batches:
            own, n, found = Rows(), b.num_rows, []
            for k, (tokens, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                found += [(k, i, tf) for t, tf in _words_of(tokens).items() if (i := known.get(t)) is not None]
                own.add(text or "")
            row, i, tf = np.array(found, np.int64).reshape(-1, 3).T
            halves = [(row, i, unit(row, tf, idf[i], n))]
            numbers, starts, _, first, _ = take_apart(own.padded(), low, high, parts)
            column = np.full(len(first), -1)
            column[numbers[starts[len(own.words)] :]] = np.arange(len(parts))
            met = [*own.counts(column[numbers], starts[: len(own.words) + 1])]
            row, i, tf = (np.concatenate([x[k] for x in met]) if met else np.zeros(0, np.int64) for k in range(3))
            halves.append((row, i + len(terms), unit(row, tf, part_idf[i], n)))
            row, i, w = (np.concatenate(x) for x in zip(*halves))
            order = np.argsort(row << 32 | i)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.ListArray.from_arrays(offsets, pa.array(x[order], kind)) for x, kind in ((i, pa.int32()), (w, pa.float64())))], names=["id", "i", "w"])

    return rows.select("id", "tokens", F.lower("text").alias("text")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, i array<int>, w array<double>")


def vectors(weights: DataFrame, size: int) -> DataFrame:
    """(id, features): sparse vectors of (id, i, w) with the indices of a row in order, built in the JVM: a vector is stored as the struct it is read from."""
    from pyspark.ml.linalg import VectorUDT

    stored = weights.select("id", F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("i").alias("indices"), F.col("w").alias("values")).alias("features"))
    kind = StructType([stored.schema["id"], StructField("features", VectorUDT())])
    return cut(stored, schema=kind)
