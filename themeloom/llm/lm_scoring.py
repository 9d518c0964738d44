"""Scoring documents by a causal self-attention model over subword ids, beside a smoothed word baseline.

Word counts, and from them the counts of all subword ids, cover every training document, and so does the training
of the attention weights: the training documents are dealt into portions of about PORTION ids, so their number grows
with the corpus; in each round a model for each portion starts from the common weights and the models are averaged.
All texts are then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import hold_out, python_ready, read, stored

#: Ids that one model trains on between averagings, about; rounds of training and averaging.
PORTION, ROUNDS = 1 << 19, 2
#: Sums of weights that reach the driver in a round, at most.
SUMS = 16
#: At most so many of the most frequent words have their counts in every task; rarer ones meet their counts in a join.
FREQUENT_WORDS = 200_000
#: Bytes of text that are cut to words, and ids that are scored, at a time, about: what a task holds follows them or one text.
TEXT_BYTES, SCORED_IDS = 2_000_000, 1 << 19
ALPHA = 0.1
END = 2


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text; empty strings at the ends of a text are no words."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``n`` over all texts; counted within each portion of a batch, then over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.lm_scoring import word_lists
        from themeloom.llm.word_ids import filled, portions

        for batch in batches:
            texts = filled(batch.column(0))
            for low, high in portions(texts):
                found = pc.value_counts(word_lists(texts.slice(low, high - low)).flatten())
                words, n = found.field("values"), found.field("counts")
                real = pc.not_equal(words, "")
                yield pa.RecordBatch.from_arrays([words.filter(real), n.filter(real)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def subword_counts(words: DataFrame, tokenizer: str) -> DataFrame:
    """``id``, ``n``: ids of all distinct words, each as often as its word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.word_ids import encoder

        held, total = encoder(tokenizer), np.zeros(0)
        for batch in batches:
            found, parts = held.word_numbers(batch.column(0))
            size = held.size[found]
            weight = np.repeat(np.repeat(batch.column(1).to_numpy(), parts), size)
            seen = np.bincount(held.spell(found).astype(np.int64), weight, len(total))
            seen[: len(total)] += total
            total = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], names=["id", "n"])

    return words.select("word", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequent_from(counts: DataFrame, most: int = FREQUENT_WORDS) -> int:
    """The least count that at most ``most`` words reach, from how many words have each count."""
    words = 0
    reached = None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect():
        words += r.words
        if words > most:
            break
        reached = r.n
    return reached if reached is not None else 1 << 62


def portions_of(rows: DataFrame, n_ids: int) -> DataFrame:
    """``portion``, ``sizes``, ``ids``: all texts of ``rows`` (doc_id, ids), dealt by their hash into portions of about
    PORTION ids; what one task has to read at a time is one portion or one text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, n = None, [], 0

        def packed() -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in held], "<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sizes]), pa.array([b"".join(held)])], names=["portion", "sizes", "ids"])

        for batch in batches:
            # row by row, so that a batch is not held twice
            for portion, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # many equal rows fall into one portion, which is cut then
                if held and (portion != now or n >= 2 * PORTION):
                    yield packed()
                    held, n = [], 0
                now = portion
                held.append(ids.as_py())
                n += len(held[-1]) // 4
        if held:
            yield packed()

    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(max(1, -(-n_ids // PORTION)))).alias("portion"), "doc_id", "ids")
    dealt = dealt.repartition("portion").sortWithinPartitions("portion", "doc_id", "ids")
    return dealt.select("portion", "ids").mapInArrow(pack, "portion long, sizes binary, ids binary")


def trained(portions: DataFrame, id_counts: np.ndarray, rounds: int = ROUNDS) -> bytes:
    """Weights after rounds of training a model on each portion and averaging them by the ids seen."""
    from themeloom.llm.attention import Vocabulary, from_bytes, start, to_bytes

    weights = start(Vocabulary(id_counts).prior)
    for number in range(rounds):
        raw = to_bytes(weights)

        def train(batches: Iterator[pa.RecordBatch], raw=raw, rate=0.01 / (1 + number)) -> Iterator[pa.RecordBatch]:
            from themeloom.llm.attention import Adam, Vocabulary, from_bytes, start, train_texts
            from themeloom.llm.word_ids import forget

            forget()
            vocabulary, total, seen, last = Vocabulary(id_counts), 0.0, 0, 0
            for batch in batches:
                for portion, sizes, ids in zip(*batch.columns, strict=True):
                    own = from_bytes(raw, start(vocabulary.prior))
                    ids = np.frombuffer(ids.as_buffer(), "<u4").astype(np.int64)
                    train_texts(own, vocabulary, ids, np.frombuffer(sizes.as_buffer(), "<u4").astype(np.int64), END, Adam(rate))
                    total = total + len(ids) * np.concatenate([own[k].ravel() for k in sorted(own)]).astype(np.float64)
                    seen, last = seen + len(ids), portion.as_py()
            if seen:
                yield pa.RecordBatch.from_pydict({"part": [last % SUMS], "total": [total.tobytes()], "n": [seen]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = 0.0, 0
            for batch in batches:
                for one, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total, seen = total + np.frombuffer(one), seen + n
            if seen:
                yield pa.RecordBatch.from_pydict({"total": [total.tobytes()], "n": [seen]})

        sums = portions.select("portion", "sizes", "ids").mapInArrow(train, "part long, total binary, n long")
        found = sums.repartition(SUMS, "part").select("total", "n").mapInArrow(add, "total binary, n long").collect()
        if found:
            mean = sum(np.frombuffer(r.total) for r in found) / sum(r.n for r in found)
            weights = from_bytes(mean.astype("<f4").tobytes(), weights)
    return to_bytes(weights)


def score_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Null texts count as empty: their one token is the end. Documents with a null id are neither held out nor
    learned from. Repeated ids are rows of their own, each counted. An empty table gives no rows; without
    training documents all words are unknown and the weights stay as they start. The driver holds FREQUENT_WORDS
    words, one count an id, and SUMS sets of weights.
    """
    from tokenizers import Tokenizer

    spark = python_ready(docs)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    learn = rows.filter(hold_out("doc_id") != 0)
    counts = stored(word_counts(learn), "word-counts")
    ends = learn.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    log_total = float(np.log10(n_train + ALPHA * (distinct + 1)))
    top = counts.filter(F.col("n") >= frequent_from(counts)).collect()
    top_words, top_logs = pa.array([r.word for r in top], pa.string()), np.log10(np.array([r.n for r in top], float) + ALPHA)
    id_counts = np.zeros(max(Tokenizer.from_file(tokenizer).get_vocab_size(), END + 1), np.int64)
    for r in subword_counts(counts, tokenizer).collect():
        id_counts[r.id] = r.n
    id_counts[END] += ends

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.lm_scoring import word_lists
        from themeloom.llm.word_ids import encoder, filled, portions

        held = encoder(tokenizer)
        logs = np.append(top_logs, [0.0, 0.0])
        for batch in batches:
            texts = filled(batch.column("text"))
            for low, high in portions(texts, TEXT_BYTES):
                some = texts.slice(low, high - low)
                lists = word_lists(some)
                parts = lists.flatten().dictionary_encode()
                ids, sizes = held.encode(some, END)
                at = pc.fill_null(pc.index_in(parts.dictionary, value_set=top_words), -1).to_numpy().astype(np.int64)
                at[pc.equal(parts.dictionary, "").to_numpy(zero_copy_only=False)] = -2
                at = at[parts.indices.to_numpy()]
                text_of = np.repeat(np.arange(high - low), np.diff(lists.offsets.to_numpy()))
                per_text = lambda values: np.bincount(text_of, values, high - low)  # noqa: B023, E731
                rare = np.flatnonzero(at == -1)
                cuts = np.searchsorted(text_of[rare], np.arange(high - low + 1))
                rare_words = parts.dictionary.take(parts.indices.take(pa.array(rare)))
                ends = np.cumsum(sizes)
                ids = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(low, high - low),
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(per_text(at != -2).astype(np.int64) + 1),
                        pa.array(per_text(at >= 0).astype(np.int64)),
                        pa.array(per_text(np.where(at >= 0, logs[at], 0.0))),
                        pa.array([ids[x:y].tobytes() for x, y in zip(ends - sizes, ends, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rare_words),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "logs", "ids", "rare"],
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # every text is cut to words and ids once; the model learns from the ids and scores them
    encoded = stored(
        numbered.mapInArrow(encode, "row long, doc_id long, n_tokens long, n_known long, logs double, ids binary, rare array<string>"),
        "encoded",
    )
    learned = encoded.filter(hold_out("doc_id") != 0).select("doc_id", "ids")
    raw = trained(stored(portions_of(learned, int(id_counts.sum())), "train-ids"), id_counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from themeloom.llm.attention import Vocabulary, from_bytes, score_texts, start
        from themeloom.llm.word_ids import forget

        forget()
        vocabulary = Vocabulary(id_counts)
        weights = from_bytes(raw, start(vocabulary.prior))
        for batch in batches:
            sizes = pc.binary_length(batch.column("ids")).to_numpy().astype(np.int64) // 4
            low = 0
            while low < len(sizes):
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), SCORED_IDS, "right")))
                ids = np.frombuffer(b"".join(batch.column("ids").slice(low, high - low).to_pylist()), "<u4")
                found = score_texts(weights, vocabulary, ids.astype(np.int64), sizes[low:high], END)
                kept = [batch.column(name).slice(low, high - low) for name in ("row", "doc_id", "n_tokens", "n_known", "logs")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], names=["row", "doc_id", "n_tokens", "n_known", "logs", "score"])
                low = high

    scored = stored(encoded.drop("rare").mapInArrow(score, "row long, doc_id long, n_tokens long, n_known long, logs double, score double"), "scored")
    # words out of the most frequent ones are rare by their own count, so no key of this join is hot
    rare = encoded.select("row", F.explode("rare").alias("word"))
    known = rare.join(counts, "word").groupBy("row").agg(
        F.count("*").alias("rare_known"), F.sum(F.log10(F.col("n") + ALPHA)).alias("rare_logs")
    )
    end_known, end_log = int(ends > 0), float(np.log10(ends + ALPHA))
    out = scored.join(known, "row", "left").withColumn("n_known", F.col("n_known") + F.coalesce("rare_known", F.lit(0)))
    unknown = F.col("n_tokens") - 1 - F.col("n_known")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + unknown * float(np.log10(ALPHA)) + end_log - F.col("n_tokens") * log_total
    return out.select(
        "doc_id",
        F.coalesce(hold_out("doc_id") == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + end_known).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        "score",
    )


def op3_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
