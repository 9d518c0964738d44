"""Sharding by histogram sort: shards of near equal bytes in the order of (hash of the text, doc_id).

Splitters are found by probing: bytes below a grid of candidate keys are counted exactly over all
partitions, the grid is refined only where a splitter's target still lies inside a cell, until every
splitter is within tolerance. First the hash is refined, so equal texts stay together; a group of copies
larger than the tolerance is cut by doc_id. Rows then move once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm.common import read, stored

#: Bits of a key that one round of probes refines.
BITS = 12
#: How far a shard's bytes below its splitter may be from its share, as a part of a shard.
TOLERANCE = 0.005
#: Bytes that one task sorts, and the most ranges a table is cut to. Beyond 2 TB a range grows with the table: at 100 TB it has
#: 800 MB, which a task still sorts.
RANGE_BYTES, MOST_RANGES = 16 << 20, 1 << 17
#: Cells that one round of probes counts at most, as long as that leaves one bit a round.
COUNTS = 1 << 17
LOW = -(1 << 63)


def splitters(keys: DataFrame, targets: list[int], slack: list[float]) -> list[tuple[int, int]]:
    """For each target the (hash, id) below which nearest to so many bytes lie, by counting rounds.

    ``keys``: h, d, size. The driver holds counts of the cells that contain a target, at most COUNTS of them
    or two for each cell. A target inside rows of one (hash, id) takes the nearer end of them.
    """
    done: list[tuple[int, int] | None] = [None] * len(targets)
    # cells still to refine: (field, first key, bits left, hash or None) -> bytes below it
    cells: dict[tuple, tuple[int, list[int]]] = {("h", LOW, 64, None): (0, list(range(len(targets))))}
    while cells:
        field, _, bits, _ = next(iter(cells))
        groups = [c for c in cells if (c[0], c[2]) == (field, bits)]
        left = max(0, bits - max(1, min(BITS, (COUNTS // len(groups)).bit_length() - 1)))
        step = dict.fromkeys(groups, left)
        # cells are found by a join on the bits that are settled, however many there are; a shift by 64 would be one by 0
        settled = (lambda key: F.shiftright(key, bits)) if bits < 64 else (lambda key: F.lit(0).cast("long"))  # noqa: B023
        rows = [(i, c[1] >> bits if bits < 64 else 0, c[3]) for i, c in enumerate(groups)]
        table = F.broadcast(keys.sparkSession.createDataFrame(rows, "g int, s long, of long"))
        on = settled(F.col(field)) == F.col("s")
        inside = keys.join(table, on & (F.col("h") == F.col("of")) if field == "d" else on)
        cell = F.shiftright(field, left) - F.shiftleft("s", bits - left) if bits < 64 else F.shiftright(field, left) - F.lit(LOW >> left)
        counted = inside.select("g", cell.alias("c"), "size").groupBy("g", "c").agg(F.sum("size").alias("n")).collect()
        by_group: dict[int, list[tuple[int, int]]] = {}
        for r in counted:
            by_group.setdefault(r.g, []).append((r.c, r.n))
        nexts: dict[tuple, tuple[int, list[int]]] = {c: v for c, v in cells.items() if c not in step}
        for i, c in enumerate(groups):
            below, wanted = cells[c]
            found = sorted(by_group.get(i, []))
            for k in wanted:
                edge = below
                for cell, n in found:
                    first = c[1] + (cell << step[c])
                    if edge + n <= targets[k] and (cell, n) != found[-1]:
                        edge += n
                        continue
                    start = (first, LOW) if field == "h" else (c[3], first)
                    end = first + (1 << step[c])
                    after = (end, LOW) if field == "h" else (c[3], end)
                    if abs(edge - targets[k]) <= slack[k]:
                        done[k] = start
                    elif abs(edge + n - targets[k]) <= slack[k]:
                        done[k] = after
                    elif step[c]:
                        nexts.setdefault((field, first, step[c], c[3]), (edge, []))[1].append(k)
                    elif field == "h":
                        nexts.setdefault(("d", LOW, 64, first), (edge, []))[1].append(k)
                    else:
                        done[k] = start if targets[k] - edge <= edge + n - targets[k] else after
                    break
                else:
                    done[k] = (c[1], LOW) if field == "h" else (c[3], c[1])
        cells = nexts
    return done  # type: ignore[return-value]


def shard_by_bytes(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id, text, size, shard, slot``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1. Null doc_ids come first within equal texts;
    null texts form one group. Repeated rows are rows of their own. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns(
        {
            "h": F.xxhash64("text"),
            "d": F.coalesce("doc_id", F.lit(LOW)),
            "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
        }
    )
    keys = stored(rows.select("h", "d", "size"), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES // shards, -(-total // (shards * RANGE_BYTES))))
    parts = shards * ranges
    targets = [total * k // parts for k in range(1, parts)]
    slack = [(TOLERANCE if k % ranges == 0 else 0.1 / ranges) * total / shards for k in range(1, parts)]
    cuts = sorted(splitters(keys, targets, slack)) if total else []
    # which splitters lie below a row is looked up by the first bits of its hash
    top = 64 - BITS
    listed: dict[int, list[tuple[int, int]]] = {}
    for h, d in cuts:
        listed.setdefault(h >> top, []).append((h, d))
    table, before = [], 0
    for cell in range(-(1 << BITS - 1), 1 << BITS - 1):
        table.append((cell, before, listed.get(cell, [])))
        before += len(listed.get(cell, []))
    spark = docs.sparkSession
    # at most 2**BITS rows with MOST_RANGES splitters in all
    table = F.broadcast(spark.createDataFrame(table, "cell long, before int, cuts array<struct<h: long, d: long>>"))

    def ranged(df: DataFrame) -> DataFrame:
        passed = F.filter("cuts", lambda c: (c["h"] < F.col("h")) | ((c["h"] == F.col("h")) & (c["d"] <= F.col("d"))))
        df = df.withColumn("cell", F.shiftright("h", top)).join(table, "cell")
        return df.withColumn("range", F.col("before") + F.size(passed)).drop("cell", "before", "cuts")

    counts = {r.range: r.n for r in ranged(keys).groupBy("range").agg(F.count("*").alias("n")).collect()}
    offsets, slot = [], 0
    for r in range(parts):
        slot = 0 if r % ranges == 0 else slot
        offsets.append((r, slot))
        slot += counts.get(r, 0)
    offsets = F.broadcast(spark.createDataFrame(offsets, "range int, first long"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "d"))
    placed = ranged(rows).withColumn("place", place).join(offsets, "range")
    return placed.select("doc_id", "text", "size", F.expr(f"int(range div {ranges})").alias("shard"), (F.col("first") + F.col("place") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_by_bytes(read(spark, sf_dir, "documents"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return rows.select("doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
