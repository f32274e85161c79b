"""Problem 2: near-duplicate records with small edits, by a parity-sketch join.

Two texts of one domain are similar if the Jaccard similarity of their 5-character shingle sets (after `normalise`) is at least
`threshold`. Similar texts, directly or through others, form a group. Steps:

1. Each task sketches a text once, however often it comes; texts that normalise alike are one group by their digests, so copies that
   different tasks have sketched are linked without a look at them, and copies that no task has sketched follow their digest.
2. Shingles are hashed; a doc of n shingles lies in the size band floor(log(n) / log(1 / threshold)), so similar docs lie in one band
   or in neighbouring bands, and every doc is sketched for its own band and the next, SKETCHES times for each with independent hashes.
   A sketch splits the hash space into PARTS parts, samples the shingles at a rate that leaves about PER_PART in each part, and XORs
   the hashes of a part: the parity of the part's tokens. A shingle in just one of two docs changes the parity of one part, so the
   number of parts that differ is a lower bound of the symmetric difference; with at most d differences among PARTS parts some part
   agrees (always for d < PARTS, which covers short texts; above that one part agrees with probability exp(-d / PARTS), so the
   sketches are repeated).
3. Docs with equal parts meet in a bucket keyed by domain, band, part and parity. Each task packs its rows by cell, the top bits of the
   bucket, so that a row takes some 8 bytes of the shuffle; a cell is unpacked and sorted where it arrives, and rows of a bucket that is
   large in a task pass in packs of their own, so that no task holds it. All pairs of a bucket of up to FULL rows are
   proposed; the rows of a larger one, in a pseudo-random order that differs from bucket to bucket, each with the first and with the
   one before: a linear number of proposals in one pass. No bucket can hold more than 1 / PARTS of a band's rows, so a campaign of a
   third of all rows is spread over many tasks.
4. Every doc gets a parity bit sketch of 0.9 to 1.8 times as many bits as it has shingles: each shingle turns one bit, so the
   Hamming distance of two sketches is a lower bound of the symmetric difference, and a proposal whose distance exceeds what the
   threshold allows for the two sizes is ruled out, without error and without its texts.
5. What is left is verified exactly on whole texts, the proposal with the least other doc of each doc first; what then already lies in
   one component needs no check; the rest is verified too (texts that no proposal has are not sent, see `_marked`), and `connected_components` (large-star small-star) closes the groups.
6. A bucket whose members then lie in one component is settled. Those of any other are compared by their bit sketches, each with every
   member of another component, in pairs of blocks of BLOCK members, so that no task holds a bucket; pairs that are not ruled out are
   verified and the groups are closed once more. So every two members of a bucket are in one group or were compared.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.operators.components import connected_components
from postmill.runtime import cut, drop_shuffles, release, table

K = 5
SKETCHES, PARTS, PER_PART, LEAST = 5, 20, 5, 5
FULL = 8  # rows of a bucket up to which all its pairs are proposed
BLOCK = 1024  # members of a bucket that are compared with as many others in one task
LEAST_BITS, PER_SHINGLE = 64, 0.9
PACK = 1 << 20  # rows of sketches packed at once, and rows that are unpacked to one batch at most
MARKS = 1 << 28  # most bits of a bitmap of ids, 32 MB
HOT = 1024  # rows of a bucket in one pack from which on they are packed by themselves
AT_ONCE = 1 << 21  # 64-bit words of bit sketches compared at once
CHARS = 1 << 17  # characters of texts that are shingled at once: their arrays stay in a core's cache
SEEN = 500_000  # normalised texts a task remembers, to send each once
CHUNK = 4096  # most docs in one sort: 12 bits of the sort key, the other 52 are the shingle's hash
_DIGIT = re.compile(r"\d")
_ASCII = bytes(48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def normalise(text: str) -> str:
    """Lower case, each digit 0, each run of white space one blank."""
    if text.isascii():
        folded = text.encode().translate(_ASCII).decode()
    else:
        folded = _DIGIT.sub("0", text.lower())
    words = " ".join(folded.split())  # none of the blanks at the ends
    return (" " if folded[:1].isspace() else "") + words + (" " if words and folded[-1:].isspace() else "")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_keys(texts: list[str]) -> np.ndarray:
    """Sorted distinct keys (doc index in the top 12 bits, 52 bits of shingle hash) of at most CHUNK normalised texts.

    A text shorter than K is one shingle, an empty text has none.
    """
    padded = [t if len(t) >= K or not t else t.ljust(K, "\0") for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(code):
        return np.empty(0, np.uint64)
    lens = np.fromiter(map(len, padded), np.int64, len(padded))
    places = np.maximum(lens - K + 1, 0)
    doc = np.repeat(np.arange(len(padded), dtype=np.uint64), places)
    first = np.arange(places.sum()) - np.repeat(np.cumsum(places) - places, places) + np.repeat(np.cumsum(lens) - lens, places)
    whole = len(code) - K + 1
    rolled = code[:whole] * _ODD[0]
    for k in range(1, K):
        rolled += code[k : whole + k] * _ODD[k]
    keys = np.sort((doc << np.uint64(52)) | (_mix(rolled[first]) >> np.uint64(12)))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def band_of(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / math.log(1 / threshold) + 1e-9).astype(np.int64)


def sketch_parts(texts: list[str], salt: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc index, bucket) of every usable part of the sketches of `texts` for their own size band and the next, and the shingles of each doc. salt: a number for each doc's domain."""
    keys = shingle_keys(texts)
    doc = (keys >> np.uint64(52)).astype(np.int64)
    hashed = keys & np.uint64((1 << 52) - 1)
    n = np.bincount(doc, minlength=len(texts))
    own = band_of(n, threshold)
    least = np.repeat(np.clip(np.minimum(n, PARTS * PER_PART) // PARTS, 1, LEAST), PARTS)
    docs, buckets = [], []
    for k in range(2 * SKETCHES):  # even bands have the first SKETCHES hashes, odd ones the others: own band and next have hashes of their own
        odd, turn = divmod(k, SKETCHES)
        if turn == 0:
            band = own + (own % 2 != odd)
            rate = np.minimum(1.0, PARTS * PER_PART / np.power(1 / threshold, band))
            limit = np.repeat((rate * (1 << 21)).astype(np.uint64), n)
        if k % 3 == 0:  # a mixed hash has the draws of three sketches, 21 bits each
            drawn = _mix(hashed + _ODD[2:3] * np.uint64(k // 3 + 1))
        keep = np.flatnonzero(((drawn >> np.uint64(21 * (k % 3))) & np.uint64(0x1FFFFF)) < limit)
        turned = _mix(hashed[keep] + _ODD[4:] * np.uint64(k + 1))
        slot = doc[keep] * PARTS + (turned % np.uint64(PARTS)).astype(np.int64)
        parity = np.zeros(len(texts) * PARTS, np.uint64)
        np.bitwise_xor.at(parity, slot, turned)
        at = np.flatnonzero(np.bincount(slot, minlength=len(parity)) >= least)
        who = at // PARTS
        label = ((band[who] * SKETCHES + turn) * PARTS + at % PARTS).astype(np.uint64) * _ODD[1] ^ salt[who]
        docs.append(who)
        buckets.append(_mix(parity[at] + label))
    return np.concatenate(docs), np.concatenate(buckets), n


def chunks(texts: list[str]) -> Iterator[slice]:
    """Slices of at most CHUNK texts and, unless one text alone is longer, CHARS characters."""
    start = held = 0
    for k, t in enumerate(texts):
        if k > start and (k - start == CHUNK or held + len(t) > CHARS):
            yield slice(start, k)
            start, held = k, 0
        held += len(t)
    if len(texts) > start:
        yield slice(start, len(texts))


def bit_sketches(texts: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """(shingles, parity bits) of each text: bit h mod m turned by each shingle of hash h, m the power of two from PER_SHINGLE times the shingles on."""
    counts, sketches = [], []
    for part in chunks(texts):
        keys = shingle_keys(texts[part])
        doc = (keys >> np.uint64(52)).astype(np.int64)
        n = np.bincount(doc, minlength=part.stop - part.start)
        m = np.maximum(LEAST_BITS, 2 ** np.ceil(np.log2(np.maximum(PER_SHINGLE * n, 1))).astype(np.int64))
        ends = np.cumsum(m)
        at = (ends - m)[doc] + (_mix(keys & np.uint64((1 << 52) - 1)) & (m - 1)[doc].astype(np.uint64)).astype(np.int64)
        packed = np.packbits((np.bincount(at, minlength=int(ends[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
        counts.append(n)
        sketches += [packed[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), m.tolist())]
    return np.concatenate(counts) if counts else np.empty(0, np.int64), sketches


def _words(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width as rows of 64-bit words."""
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """The sketches that the same shingles have in `width` words, a smaller power of two."""
    while words.shape[1] > width:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


def most_apart(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """The largest symmetric difference that texts of n and m shingles may have; -1 where sizes alone rule them out."""
    fits = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
    return np.where(fits, np.floor((1 - threshold) / (1 + threshold) * (n + m) + 1e-9), -1)


def may_be_similar(n: np.ndarray, a: list[bytes], m: np.ndarray, b: list[bytes], threshold: float) -> np.ndarray:
    """For paired texts (shingles, sketch): whether the sketches leave it open that their similarity reaches the threshold."""
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b)], np.int64).reshape(-1, 2)
    apart = np.zeros(len(a), np.int64)
    for wa, wb in np.unique(widths, axis=0):
        at = np.nonzero((widths == (wa, wb)).all(axis=1))[0]
        step = max(1, AT_ONCE * 8 // int(max(wa, wb)))
        for k in range(0, len(at), step):
            some, least = at[k : k + step], int(min(wa, wb)) // 8
            x, y = _folded(_words([a[i] for i in some]), least), _folded(_words([b[i] for i in some]), least)
            apart[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return apart <= most_apart(n, m, threshold)


def _digest(domain: str | None, norm: str) -> bytes:
    return hashlib.md5(f"{domain!r}\0{norm}".encode("utf-8", "surrogatepass")).digest()


def _bit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        norms = [normalise(t) for t in b.column(2).to_pylist()]
        keys = [_digest(d, t) for d, t in zip(b.column(1).to_pylist(), norms)]
        n, bits = bit_sketches(norms)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["id", "key", "n", "bits"])


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """`rows` without most of those whose id is not among the distinct `ids`, before a join by id sends them: by a bitmap of hashed ids.

    The bitmap has 16 to 32 bits for each id, but not more than MARKS; tasks make it in pieces. With far more ids it lets more rows
    pass, which the join then drops.
    """
    count = ids.count()
    width = min(MARKS, max(1 << 12, 1 << (16 * count).bit_length()))
    piece = min(width, 1 << 20)
    at = F.pmod(F.xxhash64("id"), F.lit(width))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            at = b.column(0).to_numpy()
            for k in np.unique(at // piece).tolist():
                made.setdefault(k, np.zeros(piece, bool))[at[at // piece == k] % piece] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(x).tobytes() for x in made.values()], pa.binary())], names=["k", "bits"])

    bitmap = np.zeros(width // 8, np.uint8)
    pieces = ids.select(at.alias("at")).repartition(min(width // piece, 64), F.floor(F.col("at") / piece)).mapInArrow(mark, "k bigint, bits binary")
    for k, bits in pieces.collect():
        bitmap[k * piece // 8 : (k + 1) * piece // 8] = np.frombuffer(bits, np.uint8)
    sent, names = rows.sparkSession.sparkContext.broadcast(bitmap), rows.columns

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(len(names)).to_numpy()
            passes = (sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(passes.astype(bool))) for k in range(len(names))], names=names)

    return rows.withColumn("at", at).mapInArrow(sieve, rows.schema)


def _normal_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normalise(t) for t in b.column(1).to_pylist()], pa.string())], names=["id", "norm"])


def _texts_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, norm) of the rows that stand in a pair."""
    ids = cut(pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct())
    return _marked(rows.select("id", "text"), ids).join(ids, "id", "left_semi").mapInArrow(_normal_batches, "id bigint, norm string")


def _sketcher(threshold: float):
    """(id, domain, text) -> (id, bucket, n). Texts that this task has seen already are left out: copies combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            ids, norms, salts = [], [], []
            for i, domain, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                norm = normalise(text)
                key = _digest(domain, norm)
                if key not in seen:
                    seen.add(key)
                    ids.append(i), norms.append(norm), salts.append(_salt(domain))
            if len(seen) > SEEN:
                seen.clear()
            for part in chunks(norms):
                who, bucket, n = sketch_parts(norms[part], np.array(salts[part], dtype=np.uint64), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids[part], dtype=np.int64)[who]), pa.array(bucket.view(np.int64)), pa.array(n[who].astype(np.int32))], names=["id", "bucket", "n"])

    return run


def _to_bytes(bucket: np.ndarray, ids: np.ndarray, n: np.ndarray) -> bytes:
    """Rows in a pack: count, low halves of the buckets, then ids (each less the one before) and shingles as planes of bytes, compressed."""
    steps = np.diff(ids, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8)
    sizes = n.astype("<i4").view(np.uint8).reshape(-1, 4)
    planes = np.concatenate((steps, sizes), axis=1).T.tobytes()
    return len(ids).to_bytes(4, "little") + bucket.astype("<u4").tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _from_bytes(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low half of the bucket, id, shingles) of the rows of some packs."""
    low, ids, sizes = [], [], []
    for p in packs:
        k = int.from_bytes(p[:4], "little")
        low.append(np.frombuffer(p, "<u4", k, 4))
        planes = np.frombuffer(pa.decompress(memoryview(p)[4 + 4 * k :], 12 * k, "zstd", asbytes=True), np.uint8).reshape(12, k).T
        ids.append(np.cumsum(np.ascontiguousarray(planes[:, :8]).view("<i8").ravel()))
        sizes.append(np.ascontiguousarray(planes[:, 8:]).view("<i4").ravel())
    return np.concatenate(low), np.concatenate(ids), np.concatenate(sizes)


def _packer(sketcher, cells: int):
    """What `sketcher` gives as (cell, hot, rows): a pack for each cell, the top bits of the bucket; rows of a bucket with HOT or more of them are a pack of their own, whose `hot` is the bucket.

    Of a bucket its cell and its low half are kept; that unlike parities meet in one now and then costs a look at their bit sketches.
    """

    def pack(ids: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        top = bucket.view(np.uint64) >> np.uint64(65 - cells.bit_length())
        whole = ((top << np.uint64(32)) | (bucket.view(np.uint64) & np.uint64(0xFFFFFFFF))).astype(np.int64)
        ordered = np.sort(whole)
        last = ordered[HOT - 1 :]
        hot = np.unique(last[last == ordered[: len(last)]])
        own = np.isin(whole, hot) if len(hot) else np.zeros(len(whole), bool)
        cell, marks, packs = [], [], []
        for some, key in ((np.flatnonzero(~own), top.astype(np.uint32 if cells > 1 << 16 else np.uint16)), (np.flatnonzero(own), whole)):
            some = some[np.argsort(key[some], kind="stable")]
            ends = np.flatnonzero(np.diff(key[some])) + 1
            for k in np.split(some, ends) if len(some) else []:
                cell.append(int(top[k[0]]))
                marks.append(int(whole[k[0]]) if own[k[0]] else None)
                packs.append(_to_bytes(whole[k], ids[k], n[k]))
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(marks, pa.int64()), pa.array(packs, pa.binary())], names=["cell", "hot", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in itertools.chain(sketcher(batches), [None]):
            held += [b] if b is not None else []
            if held and (b is None or sum(x.num_rows for x in held) >= PACK):
                yield pack(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("id", "bucket", "n")))
                held = []

    return run


def _sorted_rows(cell: int, packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, id, shingles) sorted by bucket, the rows of a bucket in a pseudo-random order that differs from bucket to bucket."""
    if not packs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    low, ids, n = _from_bytes(packs)
    high = low.astype(np.uint64) << np.uint64(32)
    order = np.argsort(high | (_mix(ids.view(np.uint64) + high * _ODD[1]) >> np.uint64(32)))
    return (np.int64(cell) << np.int64(32)) | low[order].astype(np.int64), ids[order], n[order]


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, id, shingles) sorted by bucket, from packs sorted by cell and hot bucket, null first. Holds one cell without the packs of its hot buckets, which pass one by one."""

    def out(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(rows[0]), PACK):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + PACK]) for x in rows], names=["bucket", "id", "n"])

    at, packs, rest = None, [], None  # rest: rows of the cell that are not given yet, once its first hot bucket is there
    for b in itertools.chain(batches, [None]):
        for cell, hot, rows in zip(*(b.column(k).to_pylist() for k in range(3))) if b is not None else [(None, None, None)]:
            if cell != at:
                if at is not None:
                    yield from out(_sorted_rows(at, packs) if rest is None else rest)
                at, packs, rest = cell, [], None
            if hot is None:
                packs.append(rows)
                continue
            if rest is None:
                rest, packs = _sorted_rows(cell, packs), []
            cut_at = int(np.searchsorted(rest[0], hot, side="right"))
            yield from out(tuple(x[:cut_at] for x in rest))
            rest = tuple(x[cut_at:] for x in rest)
            yield from out(_sorted_rows(cell, [rows]))


@lru_cache(maxsize=10_000)
def _salt(domain: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(repr(domain).encode(), digest_size=8).digest(), "little")


def jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of paired normalised texts (1 for two empty texts)."""
    out = np.empty(len(left))
    for part in chunks([x if len(x) > len(y) else y for x, y in zip(left, right)]):
        a, b = shingle_keys(left[part]), shingle_keys(right[part])
        both = np.sort(np.concatenate((a, b)))
        same = both[1:][both[1:] == both[:-1]]
        na, nb, ni = (np.bincount((x >> np.uint64(52)).astype(np.int64), minlength=part.stop - part.start) for x in (a, b, same))
        total = na + nb - ni
        out[part] = np.where(total > 0, ni / np.maximum(total, 1), 1.0)
    return out


def _verifier(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = jaccard(b.column(2).to_pylist(), b.column(3).to_pylist()) >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good))], names=["lo", "hi"])

    return run


def _sifter(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            open_ = pa.array(may_be_similar(n, b.column(3).to_pylist(), m, b.column(5).to_pylist(), threshold))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(open_) for k in range(2)], names=["lo", "hi"])

    return run


def _sift(pairs: DataFrame, sketched: DataFrame, threshold: float, parts: int) -> DataFrame:
    """The distinct (lo, hi) that bit sketches do not rule out."""
    sketches = sketched.select("id", "n", "bits")
    once = pairs.repartition(parts, "lo").distinct()  # one shuffle for this and the join
    with_a = once.join(sketches.withColumnsRenamed({"id": "lo", "n": "na", "bits": "a"}), "lo")
    with_b = with_a.join(sketches.withColumnsRenamed({"id": "hi", "n": "nb", "bits": "b"}), "hi")
    return with_b.select("lo", "hi", "na", "a", "nb", "b").mapInArrow(_sifter(threshold), "lo bigint, hi bigint")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    with_a = pairs.select("lo", "hi").join(texts.withColumnsRenamed({"id": "lo", "norm": "a"}), "lo")
    with_b = with_a.join(texts.withColumnsRenamed({"id": "hi", "norm": "b"}), "hi")
    return with_b.select("lo", "hi", "a", "b").mapInArrow(_verifier(threshold), "lo bigint, hi bigint")


def _pairing(threshold: float):
    """Rows (bucket, id, shingles) come sorted by bucket and turned id: all pairs of a bucket of up to FULL rows; of a larger one each row with the first and with the one before.

    Pairs that their sizes rule out are left out. A larger bucket, which leaves pairs unproposed, also gives each of its rows once, as
    (null, id, bucket). Holds FULL rows or two between batches, whatever the size of a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = tuple(np.empty(0, kind) for kind in (np.int64, np.int64, np.int32))
        held, going = empty, None  # going: (bucket, id, shingles) of the first and the last row so far of a large bucket whose rows go on
        for b in itertools.chain(batches, [None]):  # None: the rows still held
            rows = held if b is None else tuple(np.concatenate((h, b.column(k).to_numpy())) for k, h in enumerate(held))
            if not len(rows[0]):
                continue
            seen = 0
            if going is not None and going[0][0] == rows[0][0]:
                rows, seen = tuple(np.concatenate(x) for x in zip(going, rows)), 2
            starts = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
            sizes = np.diff(np.append(starts, len(rows[0])))
            large = sizes > FULL
            large[0] |= seen > 0
            ends = [starts[-1], len(rows[0]) - 1]
            going = tuple(x[ends] for x in rows) if large[-1] else None
            keep = starts[-1] if b is not None and not large[-1] else len(rows[0])
            held = tuple(x[keep:] for x in rows)
            of_large, head = np.repeat(large, sizes)[:keep], np.repeat(starts, sizes)[:keep]
            bucket, ids, n = (x[:keep] for x in rows)
            at = np.arange(keep)
            inner = of_large & (at > head) & (at >= seen)
            pairs = [np.stack((at[inner], head[inner])), np.stack((at[inner], at[inner] - 1))]
            for k in range(1, FULL):
                same = at[k:][(bucket[k:] == bucket[:-k]) & ~of_large[k:]]
                pairs.append(np.stack((same, same - k)))
            a, c = np.concatenate(pairs, axis=1)
            fits = (ids[a] != ids[c]) & (np.minimum(n[a], n[c]) >= threshold * np.maximum(n[a], n[c]) - 1e-9)
            a, c, members = ids[a[fits]], ids[c[fits]], of_large & (at >= seen)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(np.minimum(a, c)), pa.nulls(int(members.sum()), pa.int64())]), pa.array(np.concatenate((np.maximum(a, c), ids[members]))), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(bucket[members])])],
                names=["lo", "hi", "bucket"],
            )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of `_pairing`, each pair once as far as PACK of them are held."""
    held, count = [], 0
    for b in itertools.chain(batches, [None]):
        if b is not None:
            pairs = len(b) - b.column(0).null_count  # they come before the members
            held.append(b.slice(0, pairs))
            count += pairs
            yield b.slice(pairs)
        if count >= PACK or b is None and count:
            lo, hi = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            order = np.lexsort((hi, lo))
            lo, hi = lo[order], hi[order]
            new = np.concatenate(([True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(lo[new]), pa.array(hi[new]), pa.nulls(int(new.sum()), pa.int64())], names=["lo", "hi", "bucket"])
            held, count = [], 0


def _proposals(rows: DataFrame, parts: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lo, hi), once for each task whose buckets propose it, and (bucket, id) of the buckets with unproposed pairs, and the table of both, from (id, domain, text): one shuffle of packs by cell, one pass over the sorted rows of each cell."""
    cells = 1 << max(8, (2 * parts - 1).bit_length())
    pairing = _pairing(threshold)
    packs = rows.mapInArrow(_packer(_sketcher(threshold), cells), "cell int, hot bigint, rows binary")
    packs = packs.repartitionById(parts, F.col("cell") % parts).sortWithinPartitions("cell", F.asc_nulls_first("hot"))
    met = cut(packs.mapInArrow(lambda batches: _once(pairing(_unpacked(batches))), "lo bigint, hi bigint, bucket bigint"))
    return met.filter("bucket is null").select("lo", "hi"), met.filter("bucket is not null").select("bucket", F.col("hi").alias("id")), met


def _open_members(crowded: DataFrame, close: DataFrame, parts: int) -> DataFrame:
    """(bucket, rep, component, n) of the buckets whose members lie in several components; of buckets with the same members one."""
    placed = crowded.withColumnRenamed("id", "rep").join(close.withColumnsRenamed({"node": "rep"}), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    placed = placed.repartition(parts, "bucket")  # one shuffle for the groups and the join
    marks = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("x"), F.expr("bit_xor(xxhash64(rep, 1))").alias("y"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    one = marks.filter("least < most").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
    return placed.join(one, "bucket")


def _block_pairs(members: DataFrame) -> DataFrame:
    """(bucket, i, j, slot, rep, component): every member in each pair of blocks that holds its own block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("slot", F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return met.select("bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "slot", "rep", "component")


def close_pairs(left: np.ndarray, right: np.ndarray, n: np.ndarray, sketches: list[bytes], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, index) of each of `left` with each of `right`, as far as their bit sketches leave it open that they are similar."""
    width = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    for wa, wb in itertools.product(np.unique(width[left]), np.unique(width[right])):
        least = int(min(wa, wb))
        some, others = left[width[left] == wa], right[width[right] == wb]
        x, y = _folded(_words([sketches[k] for k in some]), least), _folded(_words([sketches[k] for k in others]), least)
        step = max(1, math.isqrt(AT_ONCE // least))
        for a, b in itertools.product(range(0, len(some), step), range(0, len(others), step)):
            i, j = some[a : a + step], others[b : b + step]
            apart = np.bitwise_count(x[a : a + step, None, :] ^ y[None, b : b + step, :]).sum(axis=2, dtype=np.int64)
            p, q = np.nonzero(apart <= most_apart(n[i][:, None], n[j][None, :], threshold))
            yield i[p], j[q]


def _open_in_blocks(slot_left: np.ndarray, slot_right: np.ndarray, rep: np.ndarray, component: np.ndarray, n: np.ndarray, sketches: list[bytes], threshold: float) -> np.ndarray:
    """Pairs (2, k) of different components in one pair of blocks that bit sketches do not rule out; the flags tell which rows are in the first and the second block."""
    out = [np.empty((2, 0), np.int64)]
    for a, b in close_pairs(np.nonzero(slot_left)[0], np.nonzero(slot_right)[0], n, sketches, threshold):
        unlike = component[a] != component[b]
        x, y = rep[a[unlike]], rep[b[unlike]]
        out.append(np.stack((np.minimum(x, y), np.maximum(x, y))))
    return np.concatenate(out, axis=1)


def _block_scanner(threshold: float):
    """Rows come sorted by bucket and pair of blocks: each such group is compared when its last row is there. Holds one group, two blocks, between batches."""

    def compare(t: pa.Table) -> np.ndarray:
        bucket, i, j, slot, rep, component, n = (t.column(c).to_numpy() for c in ("bucket", "i", "j", "slot", "rep", "component", "n"))
        sketches = t.column("bits").to_pylist()
        new = np.nonzero((np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))[0] + 1
        found = []
        for a, b in itertools.pairwise([0, *new.tolist(), len(bucket)]):
            left, right = slot[a:b] == i[a], slot[a:b] == j[a]
            found.append(_open_in_blocks(left, right, rep[a:b], component[a:b], n[a:b], sketches[a:b], threshold))
        return np.unique(np.concatenate(found, axis=1), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
            other = np.nonzero((keys != keys[:, -1:]).any(axis=0))[0]
            cut_at = int(other[-1]) + 1 if len(other) else 0
            held = t.slice(cut_at)
            if cut_at:
                lo, hi = compare(t.slice(0, cut_at))
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])
        if held is not None and held.num_rows:
            lo, hi = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["lo", "hi"])

    return run


def _bucket_pairs(members: DataFrame, sketched: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(lo, hi) of members of one bucket in different components that bit sketches do not rule out."""
    of_members = _marked(sketched.select("id", "n", "bits"), cut(members.select(F.col("rep").alias("id")).distinct()))
    met = _block_pairs(members).join(of_members.withColumnRenamed("id", "rep"), "rep")
    met = met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return met.select("bucket", "i", "j", "slot", "rep", "component", "n", "bits").mapInArrow(_block_scanner(threshold), "lo bigint, hi bigint").distinct()


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends do not yet lie in one component."""
    a = parts.select(F.col("node").alias("lo"), F.col("component").alias("ca"))
    b = parts.select(F.col("node").alias("hi"), F.col("component").alias("cb"))
    out = pairs.join(a, "lo", "left").join(b, "hi", "left")
    return out.filter("not coalesce(ca, lo) <=> coalesce(cb, hi)").select("lo", "hi")


def near_duplicates(df: DataFrame, id_col: str = "msg_id", text_col: str = "text", by: str = "domain", threshold: float = 0.7) -> DataFrame:
    """(id, class_id) for each row with an id and a text: class_id is the least id of its group of similar texts of one `by` value.

    Rows without id or text have no class and are left out; a null `by` is a value of its own. Empty texts are alike only to empty
    texts; a repeated row comes out as often as it comes in; ids must be non-negative and below 2^62, one text each. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(by).cast("string").alias("domain"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    parts = max(12, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    proposals, crowded, proposed = _proposals(rows, parts, threshold)
    drop_shuffles(df.sparkSession)  # here and below: the largest ones, before the next are written
    sketched = cut(rows.mapInArrow(_bit_batches, "id bigint, key binary, n bigint, bits binary"))
    pairs = cut(_sift(proposals, sketched, threshold, parts))
    drop_shuffles(df.sparkSession)
    texts = cut(_texts_of(pairs, rows))
    drop_shuffles(df.sparkSession)
    met = cut(texts.select("id").distinct().join(sketched.select("id", "key"), "id"))
    least = met.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("key", "lo")
    copies = cut(met.join(least, "key").filter("id > lo").select("lo", F.col("id").alias("hi")).distinct())
    crowded = crowded.join(copies.select(F.col("hi").alias("id")), "id", "left_anti")  # the least copy is in the same buckets
    sides = pairs.select(F.col("lo").alias("id"), F.col("hi").alias("other")).union(pairs.select(F.col("hi").alias("id"), F.col("lo").alias("other")))
    first = sides.groupBy("id").agg(F.min("other").alias("other"))  # few texts are the least of all they are paired with, so these links leave few components
    best = first.select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).distinct()
    links = copies.union(cut(_verify(best, texts, threshold)))
    close = cut(connected_components(links, "lo", "hi"))
    more = cut(_verify(_apart(pairs, close), texts, threshold))
    drop_shuffles(df.sparkSession)
    if not more.isEmpty():
        links = links.union(more)
        close = cut(connected_components(links, "lo", "hi"))
    open_ = cut(_bucket_pairs(cut(_open_members(crowded, close, parts)), sketched, threshold, parts))
    drop_shuffles(df.sparkSession)
    if not open_.isEmpty():
        links = links.union(cut(_verify(open_, cut(_texts_of(open_, rows)), threshold)))
        close = cut(connected_components(links, "lo", "hi"))
    # a text's copies share its digest: digest -> component -> least id; copies that links have put into several components join these
    owned = cut(sketched.select("id", "key").join(close.withColumnsRenamed({"node": "id"}), "id"))
    placed = owned.groupBy("key").agg(F.min("component").alias("component"))
    bridges = cut(owned.select("key", F.col("component").alias("hi")).join(placed.withColumnRenamed("component", "lo"), "key").filter("hi > lo").select("lo", "hi").distinct())
    if not bridges.isEmpty():
        close = cut(connected_components(links.union(bridges), "lo", "hi"))
        placed = sketched.select("id", "key").join(close.withColumnsRenamed({"node": "id"}), "id").groupBy("key").agg(F.min("component").alias("component"))
    keyed = cut(sketched.select("id", "key").join(placed, "key", "left"))
    release(proposed, sketched, texts, met)
    group = [F.when(F.col("component").isNull(), F.col("key")).alias("key"), F.col("component")]
    first = keyed.groupBy(*group).agg(F.min("id").alias("class_id")).alias("f")
    k = keyed.select("id", *group).alias("k")
    return k.join(first, F.expr("k.key <=> f.key and k.component <=> f.component")).select("k.id", "f.class_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "corpus"))
    return found.filter("id <> class_id").select(F.col("class_id").alias("first_id"), F.col("id").alias("msg_id"))
