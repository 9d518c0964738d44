"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets a stored row of Hamming distances to reference fingerprints (pivots). By the triangle inequality
two fingerprints at distance r differ by at most r in every coordinate, so a pair whose largest coordinate difference exceeds r
is discarded unseen; the bits of the others are compared.

The first coordinates are the distances to the zero fingerprint and to 32 pivots with two neighbouring bits set. The distance
to such a pivot less that to zero is 2, 0 or -2 and depends on these two bits alone, so at most r of the 32 differences tell apart
a pair at distance r. The differences are dealt to r + 2 sections: at least two sections agree in full, and every pair within r meets under
the agreeing differences of one choice of two sections. The other coordinates are distances to fixed pseudo-random fingerprints;
they discard what meets by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import python_ready, read, stored
from themeloom.llm.graph import components
from themeloom.operators.joins import join_heavy

#: Words of a shingle and bits in which near fingerprints may differ.
WIDTH, RADIUS = 3, 3
#: Fingerprints under one key that a task compares at a time; larger groups are dealt to pairs of chunks.
CHUNK = 20_000
#: Pivots of two bits, and pseudo-random pivots.
PAIRS, RANDOM = 32, 16


def pivots() -> np.ndarray:
    """Zero, the pivots of two bits, and fixed pseudo-random fingerprints (a Weyl sequence with mixed bits)."""
    x = np.arange(1, RANDOM + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    pairs = np.uint64(3) << np.arange(0, 64, 2, dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), pairs, x ^ x >> np.uint64(27)])


def distances(fps: np.ndarray) -> np.ndarray:
    """The table of distances, a row for each fingerprint and a column for each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None]).astype(np.uint8)


def meeting_keys(table: np.ndarray, radius: int) -> np.ndarray:
    """The keys under which fingerprints meet, a column for each choice of two of ``radius + 2`` sections."""
    # 0, 1 or 2 for each pivot of two bits
    told = (table[:, 1 : 1 + PAIRS].astype(np.int64) - table[:, :1].astype(np.int64)) // 2 + 1
    sections = np.array_split(np.arange(PAIRS), radius + 2)
    out = []
    for pair in combinations(sections, 2):
        at = np.concatenate(pair)
        out.append(told[:, at] @ 3 ** np.arange(len(at), dtype=np.int64))
    return np.stack(out, axis=1)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 bits of lower-cased word shingles; a bit is set if more than half the shingle hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*[words[i:] for i in range(width)])))
    total = np.zeros(64, np.int64)
    for low in range(0, len(grams), 100_000):
        part = grams[low : low + 100_000]
        hashes = np.array([xxh64_intdigest(g, 42) for g in part], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(grams), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed number). Null and blank texts have fingerprint zero."""
    python_ready(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.simhash import fingerprint

        for batch in batches:
            found = np.array([fingerprint(t or b"", width) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, fp long")


def distance_table(distinct: DataFrame) -> DataFrame:
    """``fp`` and its ``distances``, a byte for each pivot."""
    python_ready(distinct)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.simhash import distances

        for batch in batches:
            table = distances(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in table], pa.binary())], names=["fp", "distances"])

    return distinct.select("fp").mapInArrow(measure, "fp long, distances binary")


def near(a: np.ndarray, b: np.ndarray, da: np.ndarray, db: np.ndarray, radius: int) -> np.ndarray:
    """Which of the paired rows are within ``radius``: largest coordinate difference first, then the bits."""
    ok = np.abs(da - db).max(1) <= radius
    ok[ok] = np.bitwise_count(a[ok] ^ b[ok]) <= radius
    return ok


def group_links(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is reachable within a group, fewer than its members; the search only visits
    fingerprints not yet reached, so a dense group takes a few sweeps."""
    left = np.arange(len(fps))
    out = []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = near(np.broadcast_to(fps[at], len(left)), fps[left], table[at], table[left], radius)
            reached, left = left[hit], left[~hit]
            out += [(int(at), int(r)) for r in reached]
            front += list(reached)
    return out


def bucket_links(keys: list[np.ndarray], fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys of sorted rows."""
    table = table.astype(np.int8)
    change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    starts = np.concatenate([[0], change])
    sizes = np.diff(np.append(starts, len(fps)))
    a, b = [], []
    two = starts[sizes == 2]
    if len(two):
        x, y = fps[two], fps[two + 1]
        ok = near(x, y, table[two], table[two + 1], radius)
        a.append(x[ok])
        b.append(y[ok])
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        found = np.array(group_links(fps[s : s + n], table[s : s + n], radius), np.int64).reshape(-1, 2)
        a.append(fps[s + found[:, 0]])
        b.append(fps[s + found[:, 1]])
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links that join all distinct fingerprints of a distance table within reach of each other.

    Groups that meet under one key are compared in one task up to CHUNK members; a larger group is dealt
    to all pairs of its chunks, so no task holds more than two chunks and no pair is lost.
    """
    python_ready(table)
    choices = (radius + 2) * (radius + 1) // 2

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.simhash import meeting_keys

        for batch in batches:
            raw = batch.column(1).to_pylist()
            found = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            keys = meeting_keys(found, radius)
            rest = [row.tobytes() for row in found[:, 1 + PAIRS :]]
            for t in range(choices):
                columns = [pa.array(np.full(len(raw), t, np.int32)), pa.array(keys[:, t].copy()), batch.column(0), pa.array(rest, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "k", "fp", "d"])

    keyed = table.select("fp", "distances").mapInArrow(meet, "t int, k long, fp long, d binary")
    # counted by the fingerprints alone; groups of one need no comparison
    keyed = stored(keyed, "keyed")
    shared = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    met = keyed.join(shared, ["t", "k"])
    met = met.withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    dealt = met.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("t", "k", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "fp", "d")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.simhash import bucket_links

        held: list[np.ndarray] | None = None

        def found(rows: list[np.ndarray]) -> pa.RecordBatch:
            a, b = bucket_links(rows[:4], rows[4].view(np.uint64), rows[5], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
            rows.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(len(batch), -1))
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            # the last run may go on in the next batch
            other = np.flatnonzero(np.any([k != k[-1] for k in rows[:4]], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = [c[cut:] for c in rows]
            if cut:
                yield found([c[:cut] for c in rows])
        if held is not None:
            yield found(held)

    dealt = dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row a document: ``doc_id``, ``fingerprint`` (16 lower-case hex digits), ``component_id``.

    Copies share a fingerprint and are one point in all comparisons. Null, empty and blank texts have
    fingerprint zero and link with each other. Null doc_ids are documents too, but never name a component
    (its id is null if it has no other). Repeated doc_ids are rows of their own. Whole texts of any length count; columns
    other than the two named play no part. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, key, text, width), "fingerprints")
    points = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "points")
    table = stored(distance_table(points), "distances")
    roots = components(links(table, radius))
    points = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    points = stored(points, "rooted")
    names = points.groupBy("root").agg(F.min("first").alias("component_id"))
    named = points.join(names, "root").select("fp", "n", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return join_heavy(rows, stored(named, "named"), ["fp"]).select("doc_id", hexed.alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
