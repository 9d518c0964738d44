"""Near-duplicate vectors by lattice hashing: E8 points of random projections, in several tables.

A table projects unit vectors to eight dimensions and decodes them to points of a scaled E8 lattice. A vector
is at home in the cell of its point and also visits the neighbouring cells nearest to it. Two vectors
meet in a cell if one of them is at home there; their cosine is then worked out in double precision. A
pair that meets several times counts in one place only, which both can tell from their own cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.common import python_ready, read, stored
from themeloom.llm.graph import components
from themeloom.operators.joins import join_heavy

THRESHOLD = 0.93
#: At a cosine of 0.93 a pair meets in one table with a chance of 0.77, so in eight tables all but 1 in 100,000 do.
TABLES, PROBES, SCALE = 8, 4, 0.2
#: Vectors in one cell that a task compares at a time; larger cells are dealt to pairs of chunks.
CHUNK = 2000


@lru_cache(maxsize=8)
def projections(width: int) -> np.ndarray:
    """Orthonormal random projections to eight dimensions, scaled to the width of 64 that SCALE is chosen for."""
    rng = np.random.default_rng(20 + width)
    made = [np.linalg.qr(rng.normal(size=(width, 8)))[0] for _ in range(TABLES)]
    return np.stack(made) * np.sqrt(width / 64) / SCALE


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, padded to eight dimensions at least; scaled first, so that no square runs over or under."""
    vectors = vectors / np.abs(vectors).max(axis=1)[:, None]
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return np.pad(vectors, ((0, 0), (0, max(0, 8 - vectors.shape[1]))))


def cells(units: np.ndarray) -> np.ndarray:
    """Cell numbers, shape (rows, tables, 1 + probes): home first, then the visited ones."""
    from themeloom.llm.lattice import decode, neighbours

    mix = np.random.default_rng(7).integers(1, 1 << 62, (TABLES, 8)) | 1
    out = np.empty((len(units), TABLES, 1 + PROBES), np.int64)
    for t, p in enumerate(projections(units.shape[1])):
        x = units @ p
        home = decode(x)
        points = np.concatenate([home[:, None], neighbours(x, home, PROBES)], axis=1)
        # a sum of products of odd factors, folded; a clash of two cells only costs comparisons
        code = (points * mix[t]).sum(2)
        out[:, t] = (code ^ (code >> 31)) * 0x5851F42D4C957F2D + width_salt(units.shape[1])
    return out


def width_salt(width: int) -> int:
    return width * 1_000_003


def counts_here(mine: np.ndarray, other: np.ndarray, table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether pairs that meet in this cell count here: the first of their tables, and there the home of
    ``mine`` (the smaller one) if they meet in it, else that of ``other``."""
    at_mine = (other == mine[:, :, :1]).any(2)
    at_other = (mine == other[:, :, :1]).any(2)
    met = at_mine | at_other
    first = met.argmax(1)
    rows = np.arange(len(mine))
    place = np.where(at_mine[rows, first], mine[rows, first, 0], other[rows, first, 0])
    return (first == table) & (place == cell)


def run_links(table: int, cell: int, home: np.ndarray, rid: np.ndarray, copies: np.ndarray, vectors: np.ndarray, chunk: np.ndarray | None = None):
    """For the vectors of one cell: rows with links that count here, how many vectors they link to, and the
    smallest row each reaches through these links. With ``chunk`` only pairs of different chunks count."""
    order = np.lexsort((rid, ~home))
    h = int(home.sum())
    a_parts, b_parts = [], []
    v = vectors[order]
    for low in range(0, h, 512):
        high = min(h, low + 512)
        a, b = np.nonzero(v[low:high] @ v.T >= THRESHOLD)
        a = a + low
        keep = b > a
        a_parts.append(a[keep])
        b_parts.append(b[keep])
    a, b = np.concatenate(a_parts), np.concatenate(b_parts)
    if not len(a):
        return None
    a, b = order[a], order[b]
    if chunk is not None:
        a, b = a[chunk[a] != chunk[b]], b[chunk[a] != chunk[b]]
        if not len(a):
            return None
    swap = rid[a] > rid[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = cells(vectors[used])
    ok = np.concatenate(
        [
            counts_here(own[at[: len(a)][s : s + 20_000]], own[at[len(a) :][s : s + 20_000]], table, cell)
            for s in range(0, len(a), 20_000)
        ]
    )
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    n = np.bincount(a, copies[b], len(rid)) + np.bincount(b, copies[a], len(rid))
    root = rid.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    rows = np.flatnonzero(n)
    return rid[rows], n[rows].astype(np.int64), root[rows]


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine is at least THRESHOLD. Null, empty and
    zero vectors and those with null or non-finite components link with nothing. Equal vectors are one point
    in the search and link with each other. Repeated keys are rows of their own; a null key never names a
    component and its row is not ``kept``. An empty table gives no rows.
    """
    spark = python_ready(vectors)
    kind = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("valid", valid), "vectors")
    points = rows.filter("valid").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    points = stored(points.withColumn("rid", F.monotonically_increasing_id()), "points")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.embedding_dedup import PROBES, TABLES, cells, unit

        for batch in batches:
            widths = np.diff(batch.column("v").offsets.to_numpy())
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                for low in range(0, len(part), 2000):
                    some = part.slice(low, 2000)
                    v = some.column("v").flatten().to_numpy().reshape(-1, width)
                    found = cells(unit(v)).reshape(len(some), -1)
                    each = TABLES * (1 + PROBES)
                    raw = [x.tobytes() for x in v.astype(kind)]
                    many = lambda c: c.take(pa.array(np.repeat(np.arange(len(some)), each)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            many(some.column("label")),
                            pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), len(some))),
                            pa.array(found.ravel()),
                            pa.array(np.tile(np.arange(1 + PROBES) == 0, TABLES * len(some))),
                            many(some.column("rid")),
                            many(some.column("copies")),
                            many(pa.array(raw, pa.binary())),
                        ],
                        names=["label", "t", "cell", "home", "rid", "copies", "v"],
                    )

    kind_of_label = points.schema["label"].dataType.simpleString()
    visits = points.select("label", "v", "rid", "copies").mapInArrow(
        visit, f"label {kind_of_label}, t int, cell long, home boolean, rid long, copies long, v binary"
    )
    crowded = visits.groupBy("label", "t", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
    visits = visits.join(stored(crowded, "crowded"), ["label", "t", "cell"], "left")
    visits = visits.withColumn("chunks", F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("long"))
    visits = visits.withColumn("c", F.pmod(F.xxhash64("rid"), F.col("chunks")))
    dealt = visits.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    # within a pair of different chunks only pairs across them count, so the chunk goes along
    dealt = dealt.select(F.xxhash64("label").alias("l"), "label", "t", "cell", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "c", "home", "rid", "copies", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.embedding_dedup import cell_links

        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not len(table):
                continue
            keys = [table.column(k).to_numpy() for k in ("l", "t", "cell", "i", "j")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            held = table.slice(cut)
            if cut:
                yield from cell_links(table.slice(0, cut), kind)
        if held is not None:
            yield from cell_links(held, kind)

    # the label goes along as text, so that labels of one hash stay apart
    dealt = dealt.repartition("l", "t", "cell", "i", "j").sortWithinPartitions("l", "t", "cell", "i", "j")
    dealt = dealt.withColumn("label", F.col("label").cast("string"))
    links = stored(dealt.mapInArrow(compare, "rid long, n long, root long"), "cell-links")
    counts = links.groupBy("rid").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("rid").alias("a"), F.col("root").alias("b")).filter("a <> b").distinct())
    points = points.join(counts, "rid", "left").join(roots.withColumnRenamed("node", "rid"), "rid", "left")
    points = stored(points.select("label", "v", "copies", "first", "n", F.coalesce("root", "rid").alias("root")), "rooted")
    names = points.groupBy("root").agg(F.min("first").alias("component_id"))
    points = points.join(names, "root").select("label", "v", "copies", "n", "component_id", F.lit(True).alias("valid"))
    named = join_heavy(rows, stored(points.withColumn("n", F.coalesce("n", F.lit(0))).withColumnsRenamed({"n": "links", "copies": "n"}), "named"), ["label", "v", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    links_of = F.when(F.col("valid"), F.col("links") + F.col("n") - 1).otherwise(F.lit(0)).cast("long")
    return named.select("vec_id", links_of.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def cell_links(table: pa.Table, kind: str) -> Iterator[pa.RecordBatch]:
    """Links of every run of equal keys in a sorted table."""
    table = table.combine_chunks()
    keys = [table.column(k).to_numpy() for k in ("l", "t", "cell", "i", "j")]
    starts = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1])
    sizes = np.diff(np.append(starts, len(table)))
    home = table.column("home").to_numpy()
    homes = np.add.reduceat(home.astype(np.int64), starts)
    rids, copies, chunk = (table.column(k).to_numpy() for k in ("rid", "copies", "c"))
    out = []
    for s, n in zip(starts[(sizes > 1) & (homes > 0)].tolist(), sizes[(sizes > 1) & (homes > 0)].tolist(), strict=True):
        at = slice(s, s + n)
        raw = table.column("v").slice(s, n).to_pylist()
        labels = table.column("label").slice(s, n).to_pylist()
        widths = [len(r) for r in raw]
        for label, width in set(zip(labels, widths, strict=True)):
            mine = np.array([x == (label, width) for x in zip(labels, widths, strict=True)])
            v = unit(np.frombuffer(b"".join([r for r, m in zip(raw, mine, strict=True) if m]), kind).astype(np.float64).reshape(int(mine.sum()), -1))
            i, j = int(keys[3][s]), int(keys[4][s])
            across = chunk[at][mine] if i != j else None
            found = run_links(int(keys[1][s]), int(keys[2][s]), home[at][mine], rids[at][mine], copies[at][mine], v, across)
            if found:
                out.append(found)
    if out:
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["rid", "n", "root"])


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
