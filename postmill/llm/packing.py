"""Problem 8: texts packed into containers of fixed token capacity, by bounded-space best fit.

Each task keeps OPEN windows a container size. An item goes into the open window where it leaves the least room; if none has room and
all are in use, the fullest is closed first. An item beyond the capacity is cut into whole windows and a rest, nothing else is cut.
What is left open at the end of the tasks is packed again as items of its own, in fewer and fewer tasks, until one task holds the
rest or nothing merges any more; no task ever holds more than OPEN windows and a batch of MERGE leftovers.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.runtime import cut, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits a text before merging (public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN, MERGE = 64, 20_000
_ID_BITS = 34


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("postmill", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "tokens"])

    return run


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens) for every row with an id and a text. `tokenizer` is a rank file at the same path on every machine."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(_counter(tokenizer, pattern), "id bigint, tokens bigint")


class Packer:
    """Best fit into at most `opened` open windows of `capacity`."""

    def __init__(self, capacity: int, opened: int = OPEN):
        self.capacity, self.opened = capacity, opened
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0

    def place(self, size: int) -> int:
        """The window that takes `size` (at most the capacity)."""
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            left, window = self.room.pop(at)
        else:
            if len(self.room) >= self.opened:
                self.room.pop(0)
            left, window = self.capacity, self.made
            self.made += 1
        if left > size or size == 0:
            insort(self.room, (left - size, window))
        return window

    def whole(self) -> int:
        """A window that one piece fills."""
        self.made += 1
        return self.made - 1


def pieces(size: int, capacity: int) -> list[int]:
    """Sizes of the pieces of an item: itself, or whole windows and a rest."""
    if size <= capacity:
        return [size]
    full, rest = divmod(size, capacity)
    return [capacity] * full + [rest] * (rest > 0)


PACKED = "container string, capacity bigint, window bigint, id bigint, piece int, start bigint, tokens bigint, open boolean"


def _packer(limits: Sequence[tuple[str, int]], opened: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << _ID_BITS
        packers = [(name, capacity, Packer(capacity, opened)) for name, capacity in limits]
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, capacity, packer in packers:
                out: list[tuple] = []
                for i, size in zip(ids, sizes):
                    start = 0
                    for k, n in enumerate(pieces(size, capacity)):
                        window = packer.whole() if n == capacity else packer.place(n)
                        out.append((base + window, i, k, start, n))
                        start += n
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(out)), pa.array([capacity] * len(out), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64()), pa.array([False] * len(out))],
                        names=["container", "capacity", "window", "id", "piece", "start", "tokens", "open"],
                    )
        last = [(name, capacity, base + window) for name, capacity, packer in packers for _, window in packer.room]
        if last:  # which windows stay open
            n = len(last)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in last]), pa.array([x[1] for x in last], pa.int64()), pa.array([x[2] for x in last], pa.int64()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int32()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64()), pa.array([True] * n)],
                names=["container", "capacity", "window", "id", "piece", "start", "tokens", "open"],
            )

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leftover windows (container, capacity, window, fill), largest fill first, packed again: (container, window, into)."""
    packers: dict[str, tuple[Packer, dict[int, int]]] = {}
    for b in batches:
        into = []
        for name, capacity, window, fill in zip(*(b.column(k).to_pylist() for k in range(4))):
            packer, named = packers.setdefault(name, (Packer(capacity, MERGE), {}))
            into.append(named.setdefault(packer.place(min(fill, capacity)), window))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(into, pa.int64())], names=["container", "window", "into"])


def pack(sizes: DataFrame, limits: Sequence[tuple[str, int]], opened: int = OPEN) -> DataFrame:
    """(container, window, id, piece, start, tokens): every item of (id, tokens), once for each (name, capacity) of `limits`.

    Pieces of an item count from 0 and cover its tokens in order; only items beyond the capacity have more than one. Windows are
    named by numbers, unique within a container. Rows without id or size are left out, an item of size 0 goes where an item may go,
    repeated ids are items of their own, an empty table gives an empty result. Capacities must be positive.
    """
    if any(capacity < 1 for _, capacity in limits):
        raise ValueError("capacities must be positive")
    items = sizes.select("id", "tokens").filter("id is not null and tokens is not null")
    first = cut(items.mapInArrow(_packer(list(limits), opened), PACKED))
    rows = first.filter("not open").drop("open")
    left = first.filter("open").select("container", "capacity", "window")
    fill = rows.join(left, ["container", "capacity", "window"]).groupBy("container", "capacity", "window").agg(F.sum("tokens").alias("fill"))
    fill = cut(fill)
    steps: list[DataFrame] = []
    count = fill.count()
    while count > len(limits):
        tasks = max(1, count // MERGE)
        sorted_ = fill.repartition(tasks, F.pmod(F.xxhash64("window"), F.lit(tasks))).sortWithinPartitions("container", F.desc("fill"), "window")
        step = cut(sorted_.select("container", "capacity", "window", "fill").mapInArrow(_merger, "container string, window bigint, into bigint"))
        steps.append(step)
        fill = cut(fill.join(step, ["container", "window"]).groupBy("container", "capacity", F.col("into").alias("window")).agg(F.sum("fill").alias("fill")).select("container", "capacity", "window", "fill"))
        now = fill.count()
        if tasks == 1 or now == count:
            break
        count = now
    if not steps:
        return rows.drop("capacity")
    moved = steps[0]
    for step in steps[1:]:
        nxt = step.withColumnsRenamed({"window": "into", "into": "final"})
        moved = moved.join(nxt, ["container", "into"]).select("container", "window", F.col("final").alias("into"))
    out = rows.join(moved, ["container", "window"], "left")
    return out.select("container", F.coalesce("into", "window").alias("window"), "id", "piece", "start", "tokens")


def limits_of(limits: DataFrame, most: int = 1000) -> list[tuple[str, int]]:
    """The container table, a list of sizes; refused above `most` rows."""
    rows = limits.select("container", "capacity_tokens").filter("container is not null and capacity_tokens > 0").distinct().orderBy("container", "capacity_tokens").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} containers")
    return [(r[0], r[1]) for r in rows]


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = token_counts(table(spark, sf_dir, "documents"))
    packed = pack(sizes, limits_of(table(spark, sf_dir, "pack_limits")))
    return packed.withColumnsRenamed({"window": "window_id", "id": "doc_id"})


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container: windows, tokens and the share of the windows' capacity in use."""
    caps = table(spark, sf_dir, "pack_limits").select("container", "capacity_tokens")
    packed = p8_packed(spark, sf_dir).groupBy("container").agg(F.countDistinct("window_id").alias("windows"), F.sum("tokens").alias("tokens"))
    return packed.join(caps, "container").select("container", "capacity_tokens", "windows", "tokens", (F.col("tokens") / (F.col("windows") * F.col("capacity_tokens"))).alias("fill"))
