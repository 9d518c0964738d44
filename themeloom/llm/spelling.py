"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Two words one edit apart share the first half or the last half of the shorter one, so they meet in a group of words with that
half in common. In a group the rest of the words is a sorted list. Edit rows, three cells wide, are worked out
for every common prefix of neighbouring words once and reused by all words that share it (adjacent LCPs); where every cell of a
query's row exceeds one edit, it skips the whole range of that prefix. All queries and ranges of a list advance by one
character together, as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import python_ready, read, stored

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a character.
DROP_ONE_IN = 199
#: Characters of words that a task compares at a time; larger groups are dealt to pairs of chunks.
CHUNK = 1 << 18
#: Pairs of a query and a range that advance together.
PAIRS = 1 << 18
#: Distinct words that a task counts before it hands them on; bytes of a text that are cut to runs at a time.
HELD, PORTION = 200_000, 1 << 20

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_END = re.compile(rb"(?![a-z]|\xc3[\x80-\xbf])[\x00-\x7f\xc2-\xf4]")


def runs(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased runs of letters a-z and U+00C0 to U+00FF, in portions cut where no run goes on."""
    text, low = text.lower(), 0
    while low < len(text):
        end = _END.search(text, low + PORTION)
        high = end.start() if end else len(text)
        yield _RUN.findall(text, low, high)
        low = high


def _number(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int | None = DROP_ONE_IN) -> DataFrame:
    """``word``, ``n``: occurrences of the runs in all texts, after the characters that ``drop_one_in`` deletes.

    Counted in tasks, then added. Null and empty texts have no runs; a null key is written as nothing.
    """
    python_ready(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.spelling import HELD, _number, runs

        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: Counter = Counter()
                for portion in runs(text or b""):
                    found.update(portion)
                if drop_one_in:
                    before = zlib.crc32(b"%s:" % (doc or "").encode())
                    hit = [(run, h) for run in found if not (h := zlib.crc32(run, before)) % drop_one_in]
                    cut = [(run, run.decode(), h) for run, h in hit]
                    changed = [((s[: h % len(s)] + s[h % len(s) + 1 :]).encode(), found.pop(run)) for run, s, h in cut]
                    for run, n in changed:
                        found[run] += n
                held.update(found)
                if len(held) > HELD:
                    yield _number(held)
                    held = Counter()
        if held:
            yield _number(held)

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_pairs(words: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of one group at a distance of exactly one edit, each both ways.

    ``words``: bytes of one word a row, filled up with zeros; sorted within each group, where no word repeats.
    """
    longest = words.shape[1]
    found_q, found_w = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # common prefix of each word with the one before it; none with another group's
    differ = words[1:] != words[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), longest)
    lcp = np.concatenate([[-1], np.where(group[1:] == group[:-1], lcp, -1)])
    padded = np.pad(words, ((0, 0), (0, 2)))
    edges: dict[int, np.ndarray] = {}

    def advance(depth: int, q: np.ndarray, lows: np.ndarray, ends: np.ndarray, rows: np.ndarray):
        """From ranges of words with a common prefix of ``depth`` characters to those with one more."""
        if depth not in edges:
            edges[depth] = np.append(np.flatnonzero(lcp <= depth), len(words))
        edge = edges[depth]
        first = np.searchsorted(edge, lows, "right") - 1
        many = np.searchsorted(edge, ends, "left") - first
        pair = np.repeat(np.arange(len(q)), many)
        child = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many) + first[pair]
        q, rows = q[pair], rows[pair]
        low, end = np.maximum(edge[child], lows[pair]), np.minimum(edge[child + 1], ends[pair])
        letter = words[low, depth]
        new = np.full_like(rows, 2)
        for band in range(3):
            # edits to the query's prefix of depth + band characters, the last of which stands at depth + band - 1
            place = depth + band - 1
            if place >= 0:
                new[:, band] = np.minimum(new[:, band], rows[:, band] + (padded[q, place] != letter))
            if band < 2:
                new[:, band] = np.minimum(new[:, band], rows[:, band + 1] + 1)
            if band > 0:
                new[:, band] = np.minimum(new[:, band], new[:, band - 1] + 1)
            new[depth + band > sizes[q], band] = 2
        alive = new.min(1) <= 1
        return q[alive], low[alive], end[alive], new[alive]

    q = np.arange(len(words))
    starts = np.searchsorted(np.flatnonzero(lcp < 0), q, "right") - 1
    bounds = np.append(np.flatnonzero(lcp < 0), len(words))
    rows = np.tile(np.array([2, 0, 1], np.int8), (len(words), 1))
    todo = [(0, q, bounds[starts], bounds[starts + 1], rows)]
    while todo:
        depth, q, lows, ends, rows = todo.pop()
        if len(q) > PAIRS:
            todo += [(depth, q[s : s + PAIRS], lows[s : s + PAIRS], ends[s : s + PAIRS], rows[s : s + PAIRS]) for s in range(0, len(q), PAIRS)]
            continue
        # the first word of a range is the prefix itself if it ends here
        over = sizes[lows] == depth
        at = np.flatnonzero(over)
        lag = sizes[q[at]] - depth
        at, lag = at[np.abs(lag) <= 1], lag[np.abs(lag) <= 1]
        one = at[rows[at, lag + 1] == 1]
        found_q.append(q[one])
        found_w.append(lows[one])
        lows = lows + over
        go = lows < ends
        if depth < longest and go.any():
            todo.append((depth + 1, *advance(depth, q[go], lows[go], ends[go], rows[go])))
    return np.concatenate(found_q), np.concatenate(found_w)


def group_neighbours(words: list[bytes], n: np.ndarray, group: np.ndarray, tail: np.ndarray, chunk: np.ndarray, across: np.ndarray, least: int):
    """Over whole groups of one shorter length ``least``: rows that have near words, how many, and the row of the best one.

    Pairs in which both words are longer count elsewhere, as do pairs of one chunk in a group ``across`` two, and in ``tail`` groups,
    which share the last half, pairs that share the first half too.
    """
    half = least // 2
    sizes = np.array([len(w) for w in words])
    # what lies outside the common half, from it outwards
    rest = [w[: len(w) - (least - half)][::-1] if t else w[half:] for w, t in zip(words, tail.tolist(), strict=True)]
    order = np.array(sorted(range(len(words)), key=list(zip(group.tolist(), rest, strict=True)).__getitem__))
    lengths = np.array([len(rest[i]) for i in order])
    table = np.zeros((len(order), max(1, int(lengths.max()))), np.uint8)
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join([rest[i] for i in order]), np.uint8)
    q, w = near_pairs(table, lengths, group[order])
    q, w = order[q], order[w]
    codes: dict[bytes, int] = {}
    head = np.array([codes.setdefault(x[:half], len(codes)) for x in words])
    ok = (np.minimum(sizes[q], sizes[w]) == least) & ~(across[q] & (chunk[q] == chunk[w])) & ~(tail[q] & (head[q] == head[w]))
    q, w = q[ok], w[ok]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = np.lexsort((rank[w], -n[w], q))
    rows, first, count = np.unique(q[best], return_index=True, return_counts=True)
    return rows, count, w[best][first]


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: of distinct words ``word``, ``n`` of letters up to U+00FF, those that have near words.

    A group that has more than CHUNK characters is dealt to all pairs of its chunks, so no task holds more than two and no pair is lost.
    """
    python_ready(words)
    size = F.char_length("word")
    groups = []
    for least in (size, size - 1):
        half = F.floor(least / 2).cast("int")
        groups.append(F.struct(least.alias("least"), F.lit(False).alias("tail"), F.substring("word", F.lit(1), half).alias("part")))
        rest = least - half
        groups.append(F.struct(least.alias("least"), F.lit(True).alias("tail"), F.substring("word", size - rest + 1, rest).alias("part")))
    keyed = words.select("word", "n", F.explode(F.array(*groups)).alias("g")).filter("g.least > 0").select("g.*", "word", "n")
    large = keyed.groupBy("least", "tail", "part").agg(F.sum(F.char_length("word")).alias("chars"), F.count("*").alias("members")).filter(f"chars > {CHUNK} AND members > 1")
    keyed = keyed.join(stored(large, "large"), ["least", "tail", "part"], "left")
    keyed = keyed.withColumn("chunks", F.coalesce(F.least(F.ceil(F.col("chars") / CHUNK), F.col("members")), F.lit(1)).cast("long"))
    keyed = keyed.withColumn("c", F.pmod(F.xxhash64("word"), F.col("chunks")))
    dealt = keyed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.select("least", "tail", "part", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "c", "word", "n")
    dealt = dealt.repartition("least", "tail", "part", "i", "j").sortWithinPartitions("least", "tail", "part", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.spelling import CHUNK, group_neighbours

        def near(rows: list[tuple], group: list[int]) -> pa.RecordBatch:
            found: tuple = ((), (), ())
            words = [row[6] for row in rows]
            n = np.array([row[7] for row in rows], np.int64)
            if rows:
                tail, i, j, chunk = (np.array([row[k] for row in rows]) for k in (1, 3, 4, 5))
                found = group_neighbours([w.encode("latin-1") for w in words], n, np.array(group), tail, chunk, i != j, rows[0][0])
            columns = [[words[a] for a in found[0]], found[1], [n[b] for b in found[2]], [words[b] for b in found[2]]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

        # whole groups of one shorter length, until they have CHUNK characters; a group of one word has no pairs
        held: list[tuple] = []
        group: list[int] = []
        mine: list[tuple] = []
        last = None

        def close() -> None:
            if len(mine) > 1:
                group.extend([(group[-1] if group else 0) + 1] * len(mine))
                held.extend(mine)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:5] != last:
                    close()
                    if held and (held[0][0] != row[0] or len(held) * (row[0] + 1) > CHUNK):
                        yield near(held, group)
                        held, group = [], []
                    mine, last = [], row[:5]
                mine.append(row)
        close()
        yield near(held, group)

    found = dealt.mapInArrow(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words ``word``, ``n``.

    ``form``: the near word of the largest n (ties: the smallest) if that is at least ``ratio`` times the word's n, else null;
    ``root``: the last of the forms that follow one another from the word on, itself if it has none. Counts rise along
    forms, so they end. An empty table gives no rows.
    """
    words = stored(words, "words")
    near = neighbours(words)
    formed = F.col("best_n") >= F.col("n") * ratio
    rows = words.join(near, "word", "left").select(
        "word",
        F.when(formed, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    )
    rows = stored(rows, "forms")
    # each step doubles the way that is known; only words with a form take part
    steps = stored(rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not steps.filter("moved").limit(1).count():
            break
        steps = steps.drop("moved")
    roots = steps.select("word", "root")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_one_in: int | None = None) -> DataFrame:
    """The variant groups of the words of whole texts: at least LEAST_LENGTH letters and LEAST_COUNT occurrences over all texts.

    Repeated rows count again; null and empty texts have no words; other columns play no part; words of any length are compared.
    """
    words = counted(docs, key, text, drop_one_in).filter((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))
    return group_variants(words)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"), drop_one_in=DROP_ONE_IN)
