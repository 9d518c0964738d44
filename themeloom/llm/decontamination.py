"""Benchmark decontamination: documents are streamed through a suffix automaton of the test items.

Words are lower-cased runs of letters and digits. The longest match with any item is known at every word; a match of
at least ``window`` words, or of a whole shorter item, marks its words. Marked spans are removed, and documents of which
they cover too much are rejected.

The items are dealt to blocks of at most BLOCK_WORDS words. One automaton for each block is built in a task and sent to
all tasks; the documents pass through the blocks in turn, without a shuffle.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import python_ready, read, stored
from themeloom.llm.suffix_automaton import Automaton, Reader

WINDOW = 10
#: Words of items in one automaton, at most (about 50 MB in a task); more items take more automata.
BLOCK_WORDS = 400_000
#: Words of an item in one row; longer items are cut into rows that overlap by a window less one word.
PIECE = 20_000
#: Bytes of a text that are cut to words at a time.
PORTION = 1 << 20
#: A document of which a larger share of words is marked is rejected.
MOST_COVERED = 0.5

#: Byte by byte: A-Z to small letters; digits, letters and bytes of other characters stay, all others part words.
_FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")

FOUND = "struct<n_words:long,n_hit:long,spans:array<struct<first:long,end:long,longest:long>>,items:array<string>>"


def portions(text: bytes) -> Iterator[bytes]:
    """The folded text in portions of about PORTION bytes that end between words."""
    folded, low = text.translate(_FOLD), 0
    while low < len(folded):
        high = folded.find(b" ", low + PORTION)
        high = len(folded) if high < 0 else high
        yield folded[low:high]
        low = high


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def deal(items: DataFrame, window: int, key: str = "item_id", text: str = "text") -> list[DataFrame]:
    """The items as rows of words in blocks of at most BLOCK_WORDS words, one table for each block."""
    python_ready(items)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.decontamination import PIECE, words_of

        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or b"")
                for low in range(0, max(1, len(words) - window + 1) if words else 0, PIECE):
                    piece = words[low : low + PIECE + window - 1]
                    columns = [pa.array([item], pa.string()), pa.array([b" ".join(piece)], pa.binary()), pa.array([len(piece)], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n"])

    rows = items.select(F.col(key).cast("string").alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))
    pieces = stored(rows.mapInArrow(cut, "item_id string, words binary, n long").distinct(), "items")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    blocks = -(-2 * total // BLOCK_WORDS) if total > BLOCK_WORDS else 1
    place = lambda n: F.pmod(F.xxhash64("item_id", "words"), F.lit(n))
    while blocks > 1 and pieces.groupBy(place(blocks).alias("b")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > BLOCK_WORDS:
        blocks += -(-blocks // 4)
    return [pieces.filter(place(blocks) == b) for b in range(blocks)]


def built(block: DataFrame, window: int) -> tuple[Automaton, list[str | None]]:
    """The automaton of a block, made in one task, and the id of every item it holds."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.suffix_automaton import Automaton

        rows = [r for batch in batches for r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if rows:
            rows.sort(key=lambda r: (r[1], r[0] is None, r[0] or ""))
            made = Automaton([words.split() for _, words in rows], window), [item for item, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["made"])

    made = block.select("item_id", "words").coalesce(1).mapInArrow(build, "made binary").collect()
    return pickle.loads(made[0].made) if made else (Automaton([], window), [])


def scan(rows: DataFrame, automaton: Automaton, names: list[str | None], last: bool, clean: bool) -> DataFrame:
    """``row``, ``text``, ``found`` with what this block of items found added; the last block gives the text without
    its marked spans, or null if ``clean`` is false."""
    held = rows.sparkSession.sparkContext.broadcast((automaton, names))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.decontamination import cleaned, merged, portions
        from themeloom.llm.suffix_automaton import Reader

        automaton, names = held.value
        for batch in batches:
            whole = batch.column("text")
            texts, found = whole.to_pylist(), []
            for text, before in zip(texts, batch.column("found").to_pylist(), strict=True):
                reader = Reader(automaton)
                for portion in portions(text or b""):
                    reader.read(portion.split())
                found.append(merged(reader, names, before))
            if last and clean:
                whole = pa.array([cleaned(t, f["spans"]) if f["n_hit"] else t for t, f in zip(texts, found, strict=True)], pa.binary())
            elif last:
                whole = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), whole, pa.array(found, batch.schema.field("found").type)], names=["row", "text", "found"])

    return rows.mapInArrow(find, rows.schema)


def merged(reader: Reader, names: list[str | None], before: dict | None) -> dict:
    """What this block and the blocks before it found in one document."""
    spans = [dict(zip(("first", "end", "longest"), s, strict=True)) for s in reader.spans]
    items = {names[i] for i in reader.items()} - {None}
    if before and before["spans"]:
        items.update(before["items"])
        joined: list[dict] = []
        for span in sorted(spans + before["spans"], key=lambda s: (s["first"], s["end"])):
            if joined and joined[-1]["end"] >= span["first"]:
                joined[-1]["end"] = max(joined[-1]["end"], span["end"])
                joined[-1]["longest"] = max(joined[-1]["longest"], span["longest"])
            else:
                joined.append(dict(span))
        spans = joined
    n_hit = sum(s["end"] - s["first"] for s in spans)
    return {"n_words": reader.n_words, "n_hit": n_hit, "spans": spans, "items": sorted(items)}


def _passed(docs: DataFrame, items: DataFrame, window: int, text: str, item_key: str, item_text: str, row: list[str], clean: bool) -> DataFrame:
    blocks = deal(items, window, item_key, item_text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in row]).alias("row"), F.col(text).cast("string").cast("binary").alias("text"), F.lit(None).cast(FOUND).alias("found"))
    for i, block in enumerate(blocks):
        # the table between two blocks keeps one automaton at a time in a task
        rows = scan(rows if i == 0 else stored(rows, "found"), *built(block, window), i == len(blocks) - 1, clean)
    return rows


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text as a struct ``row``, and ``found``: ``n_words``, ``n_hit`` (marked words), ``spans`` of
    marked words (``first``, ``end``, the ``longest`` match in it) and the ids of the ``items`` whose windows occur, sorted as strings.

    Null and wordless texts and items have no words and match nothing. Rows of ``items`` with one id count as one item; an item
    without an id marks words but is not named. Equal texts and repeated rows are rows of their own. Texts and items of any
    length are read whole. Without items nothing is marked; without documents there are no rows.
    """
    return _passed(docs, items, window, text, item_key, item_text, [c for c in docs.columns if c != text], False).select("row", "found")


def remove_leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = MOST_COVERED, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """All columns of ``docs`` as a struct ``row``, ``found`` as in ``find_leaks``, ``clean_text`` without the marked spans (from the
    first byte of a span's first word to the last of its last word; a null text stays null), and ``kept``: false if
    more than ``most_covered`` of the words are marked."""
    rows = _passed(docs, items, window, text, item_key, item_text, docs.columns, True)
    return rows.select("row", "found", F.col("text").cast("string").alias("clean_text"), (F.col("found.n_hit") <= F.col("found.n_words") * most_covered).alias("kept"))


def cleaned(text: bytes, spans: list[dict]) -> bytes:
    """The text without its marked spans."""
    kept, done, words = [], 0, enumerate(_WORD.finditer(text.translate(_FOLD)))
    for span in spans:
        start = end = next(m for i, m in words if i == span["first"])
        if span["end"] > span["first"] + 1:
            end = next(m for i, m in words if i == span["end"] - 1)
        kept.append(text[done : start.start()])
        done = end.end()
    return b"".join([*kept, text[done:]])


def op12_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


#: The same result in DuckDB: every window of every item against every run of as many words.
ORACLE = rf"""
WITH words AS (SELECT * FROM (VALUES ('[\x00-\x2F\x3A-\x60\x7B-\x7F]+')) v(other)),
d AS (SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), other), lambda x: x <> '') AS w FROM documents, words),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), other), lambda x: x <> '') AS w FROM benchmark, words),
bs AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS run FROM bs),
ks AS (SELECT DISTINCT k FROM win),
ds AS (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
occ AS (SELECT id, p, k, array_to_string(w[p:p + k - 1], ' ') AS run FROM ds),
hit AS (SELECT id, p, k, item_id FROM occ JOIN win USING (k, run)),
marked AS (SELECT id, count(DISTINCT q) AS n FROM (SELECT DISTINCT id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY id),
named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(marked.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(marked.n, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (id) LEFT JOIN named USING (id)"""
