"""Line-first cleaning: lines are judged one by one, failing lines go, and a document that loses too much goes too.

All of it is DataFrame functions over one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import BLANKS, let, read, split_words

#: The characters counted as symbols.
SYMBOLS = "[#*$%&|<>]"
#: Separators between the entries of a navigation line, and how many a word make one.
SEPARATORS, SEPARATORS_A_WORD = "[|\\u00bb\\u203a\\u2022]", 0.25
#: Piled-up punctuation, and how much a word is too much.
PILED = "[#*$%&<>~^=_]{2,}|[!?]{2,}", 0.3
#: Share of different words below which a line of at least REPEAT_WORDS words is a repetition.
DIFFERENT, REPEAT_WORDS = 0.3, 10
#: Phrases of web pages around their text; a line of at most BOILERPLATE_WORDS words with one goes.
BOILERPLATE = "(?i)javascript|cookie|privacy policy|terms of (use|service)|click here|sign (in|up)|log in|subscribe|newsletter|share this|skip to content"
BOILERPLATE_WORDS = 20
#: Largest share of the characters in words that may go with failing lines.
LOSS = 0.2
#: Fixed values of the base rule.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text, first places included.

    Hashes tell the texts without any repeated window; the others compare the windows themselves.
    """
    last = F.size(words) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("g"), i.alias("p")))

    def places(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["g"] == F.get(s, j)["g"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), last), lambda i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
        return F.sort_array(F.transform(twice, lambda i: F.get(s, i)["p"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end"))
    step = lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + WINDOW).alias("end"))
    covered = F.aggregate(let(F.sort_array(grams), places), start, step, lambda a: a["n"])
    return F.when(last < 0, F.lit(0)).when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(covered).cast("long")


def line_fails(line: Column, words: Column) -> Column:
    """True where a rule removes the line; a line without words never fails."""
    n = F.size(words)
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) >= SEPARATORS_A_WORD * n
    punctuation = F.regexp_count(line, F.lit(PILED[0])) >= PILED[1] * n
    repetition = (n >= REPEAT_WORDS) & (F.size(F.array_distinct(words)) < DIFFERENT * n)
    boilerplate = (n <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return (n > 0) & (navigation | punctuation | repetition | boilerplate)


def judge(text: Column) -> Column:
    """A struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, clean_text."""
    text = F.coalesce(text, F.lit(""))
    counts = let(
        split_words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    judged = F.transform(
        F.split(text, "\n", -1),
        lambda line: let(
            split_words(line),
            lambda w: F.struct(
                line.alias("line"),
                (F.size(w) > 0).alias("full"),
                F.length(F.array_join(w, "")).cast("long").alias("chars"),
                line_fails(line, w).alias("fails"),
            ),
        ),
    )

    def summed(lines: Column) -> Column:
        full = F.transform(F.filter(lines, lambda x: x["full"]), lambda x: x["line"])
        return F.struct(
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            F.aggregate(F.filter(lines, lambda x: x["fails"]), F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("lost_chars"),
            F.array_join(F.transform(F.filter(lines, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("clean_text"),
        )

    symbols = (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long")

    def verdict(c: Column, s: Column) -> Column:
        failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
        return F.struct(
            c["n_words"].alias("n_words"),
            c["word_chars"].alias("word_chars"),
            symbols.alias("n_symbols"),
            s["n_dup_lines"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            s["lost_chars"].alias("lost_chars"),
            failed.alias("base_failed"),
            (~failed & (s["lost_chars"] <= LOSS * c["word_chars"])).alias("kept"),
            s["clean_text"].alias("clean_text"),
        )

    return let(counts, lambda c: let(let(judged, summed), lambda s: verdict(c, s)))


def apply_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct, whatever their names) and ``rules`` (the struct of ``judge``).

    Null and empty texts have no words: all counts 0, base_failed true, kept false, clean_text empty. A text
    keeps the order of its remaining lines. Repeated rows and ids are judged one by one.
    """
    return docs.select(F.struct("*").alias("row"), judge(F.col(text).cast("string")).alias("rules"))


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``apply_rules`` that are kept. The verdict is worked out once: a filter on it would be
    pushed below the projection and judge every text a second time."""
    kept = F.filter(F.array(judge(F.col(text).cast("string"))), lambda r: r["kept"])
    return docs.select(F.struct("*").alias("row"), F.explode_outer(kept).alias("rules")).filter("rules IS NOT NULL")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(read(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept"]
    return judged.select(F.col("row.doc_id").alias("doc_id"), *[F.col(f"rules.{n}").alias(n) for n in names])


#: The same result in DuckDB.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT id, doc_id, t, list_filter(string_split_regex(t, '{BLANKS}'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT id, p, array_to_string(ws[p:p + 4], ' ') AS gram FROM g),
r AS (SELECT id, p FROM (SELECT id, p, count(*) OVER (PARTITION BY id, gram) AS c FROM h) WHERE c > 1),
e AS (SELECT id, sum(least(5, coalesce(nxt - p, 5))) AS n FROM (SELECT id, p, lead(p) OVER (PARTITION BY id ORDER BY p) AS nxt FROM r) GROUP BY id),
l AS (SELECT id, line, ws, len(ws) AS n, length(array_to_string(ws, '')) AS chars FROM (
  SELECT id, line, list_filter(string_split_regex(line, '{BLANKS}'), lambda x: x <> '') AS ws
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d))),
f AS (SELECT *, n > 0 AND (len(regexp_extract_all(line, '[|\\x{{00bb}}\\x{{203a}}\\x{{2022}}]')) >= {SEPARATORS_A_WORD} * n
  OR len(regexp_extract_all(line, '{PILED[0]}')) >= {PILED[1]} * n
  OR (n >= {REPEAT_WORDS} AND len(list_distinct(ws)) < {DIFFERENT} * n)
  OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(line, '{BOILERPLATE}'))) AS fails FROM l),
s AS (SELECT id, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(chars) FILTER (fails), 0)::BIGINT AS lost FROM f GROUP BY id),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(e.n, 0)::BIGINT AS n_repeat_words, lost AS lost_chars
  FROM w JOIN s USING (id) LEFT JOIN e USING (id))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND lost_chars <= {LOSS} * word_chars AS kept FROM a
"""
