"""Licence scans by a positional rare-token index.

Licence texts and single key phrases are templates, indexed by their rarest words and the places of these in them. How rare a
word is comes from all documents: the number of documents that hold it. In a file, the places of rare words are looked
up once; every place votes for where a template would start, and the votes of its rare words are intersected by that
start. A key phrase is verified there word by word. A licence text needs half of its rare words' weight in place, and each of
its mandatory key phrases, verified, near where the template has it. DataFrame functions only; nothing is shuffled but one
count for each licence word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.common import ascii_lower, let, read, split_words

#: What separates words: all ASCII but letters and digits.
NOT_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The base phrases and their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Mandatory key phrases of licences, as they read in their public texts.
KEY_PHRASES = {
    "agpl": "gnu affero general public license",
    "apache-2.0": "licensed under the apache license version 2 0",
    "artistic": "the artistic license",
    "boost": "boost software license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "cc by nc",
    "cc-by-nd": "cc by nd",
    "cc-by-sa": "cc by sa",
    "cc0": "creative commons zero",
    "eclipse": "eclipse public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose",
    "lgpl": "gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-name": "mit license",
    "mozilla": "mozilla public license",
    "spdx": "spdx license identifier",
    "unlicense": "free and unencumbered software released into the public domain",
}
#: Rare words that vote for a phrase.
VOTERS = 3
#: The operative words of public licences and notices, as they read in their texts. Words in brackets are a mandatory
#: key phrase.
LICENCE_TEXTS = {
    "apache-2.0-notice": "[licensed under the apache license version 2 0] the license [you may not use this file except in compliance with the license] you may "
    "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed "
    "under the license is [distributed on an as is basis without warranties or conditions of any kind] either express or implied see the license for the "
    "specific language governing permissions and limitations under the license",
    "bsd-3-clause-text": "[redistribution and use in source and binary forms with or without modification are permitted] provided that the following conditions are "
    "met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[redistributions in binary form must reproduce the above copyright notice] this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used "
    "[to endorse or promote products derived from this software without specific prior written permission] this software is provided by the copyright "
    "holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed",
    "gpl-notice": "this program is free software [you can redistribute it and or modify it under the terms of the gnu] general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version this program is [distributed in the hope that it "
    "will be useful but without any warranty] without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
    "general public license for more details [you should have received a copy of the gnu] general public license along with this program",
    "isc-text": "[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies the software is provided as is and [the author disclaims all warranties with "
    "regard to this software] including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
    "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    "mit-text": "[permission is hereby granted free of charge to any person obtaining a copy of this software] and associated documentation files the software to "
    "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
    "notice and this permission notice [shall be included in all copies or substantial portions of the software] the software is provided as is "
    "without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement [in no event shall the authors or copyright holders be liable for any claim damages or other liability]",
    "unlicense-text": "this is [free and unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or "
    "distribute this software [either in source code form or as a compiled binary for any purpose commercial or non commercial] and by any means",
    "zlib-text": "this software is provided as is without any express or implied warranty [in no event will the authors be held liable for any damages arising] "
    "from the use of this software [permission is granted to anyone to use this software for any purpose] including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions",
}
#: Rare words that vote for a licence text, the least share of their weight in place, and how many words a key phrase may have moved.
TEXT_VOTERS, LEAST_SHARE, MOVED = 8, 0.5, 40


def phrases() -> dict[str, list[str]]:
    return {label: text.split() for label, text in (BASE | KEY_PHRASES).items()}


def licence_texts() -> dict[str, tuple[list[str], list[tuple[int, list[str]]]]]:
    """Each text's words, and its mandatory phrases with the place of their first word."""
    out = {}
    for label, text in LICENCE_TEXTS.items():
        words, marked, start = [], [], 0
        for word in text.split():
            start = len(words) if word[0] == "[" else start
            words.append(word.strip("[]"))
            if word[-1] == "]":
                marked.append((start, words[start:]))
        out[label] = words, marked
    return out


def words_of(text: Column) -> Column:
    """Lower-cased words. ``lower`` differs from lower-casing A-Z within words of other letters, which no
    phrase holds, and where a Kelvin sign would become a letter k; such texts take the exact way."""
    text = F.coalesce(text, F.lit(""))
    kelvin = F.contains(text, F.lit("K"))
    return split_words(F.when(kelvin, ascii_lower(text)).otherwise(F.lower(text)), NOT_WORDS)


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each licence word; the driver gets one row a word."""
    vocabulary = sorted({w for words in phrases().values() for w in words} | {w for words, _ in licence_texts().values() for w in words})
    held = F.array_intersect(words_of(F.col(text).cast("string")), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r.w: r.n for r in found}
    return counts.pop("", 0), {w: counts.get(w, 0) for w in vocabulary}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct) and ``found``: n_words, spans (label, start, end, base), score.

    ``score`` is the largest share of a template's rare-word weight that stands in place in the file, 1 if a whole
    phrase does. The span of a licence text goes from its first key phrase to its last, at the first place where they stand together.
    Null and empty texts have no words, no spans and score 0. Every place counts, overlapping or not. Texts are searched whole, however
    long; repeated rows are rows of their own; an empty table gives no rows.
    """
    n_docs, frequency = document_frequencies(docs, text)
    weight = {w: math.log((n_docs + 1) / (n + 0.5)) for w, n in frequency.items()}
    index = {}
    for label, words in phrases().items():
        order = sorted(range(len(words)), key=lambda i: (-weight[words[i]], words[i], i))[:VOTERS]
        index[label] = (words, order)
    rare = {words[i] for words, order in index.values() for i in order[:1]}
    # the postings of the texts' rare words and their key phrases, as data
    posted: dict[str, list[Column]] = {}
    keys, names = [], list(licence_texts())
    for t, (words, marked) in enumerate(licence_texts().values()):
        order = sorted(range(len(words)), key=lambda i: (-weight[words[i]], words[i], i))[:TEXT_VOTERS]
        total = sum(weight[words[i]] for i in order)
        for i in order:
            posted.setdefault(words[i], []).append(F.struct(F.lit(t).alias("t"), F.lit(i).alias("o"), F.lit(weight[words[i]] / total).alias("w")))
        keys.append(F.array(*[F.struct(F.lit(at).alias("place"), F.array(*map(F.lit, key)).alias("words")) for at, key in marked]))
    postings = F.create_map(*[x for word, held in posted.items() for x in (F.lit(word), F.array(*held))])
    none_posted = F.array().cast("array<struct<t:int,o:int,w:double>>")
    rare = sorted(rare | set(posted))

    def look_up(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(rare))
        places = F.when(F.size(w) > 0, places).otherwise(F.array().cast("array<int>"))

        def at(i: Column, word: str) -> Column:
            return F.coalesce(F.get(w, i) == word, F.lit(False))

        def starts_of(p: Column, words: list[str], place: int) -> Column:
            """Where a phrase would start by the places of one of its words."""
            found = F.transform(F.filter(p, lambda i: at(i, words[place])), lambda i: i - place)
            return F.filter(found, lambda s: s >= 0)

        def all_at(s: Column, words: list[str], places: list[int]) -> Column:
            out = F.lit(True)
            for i in places:
                out = out & at(s + i, words[i])
            return out

        def standing(p: Column, words: list[str], order: list[int]) -> Column:
            """The starts at which all words of a phrase stand, the rarest looked at first."""
            rest = sorted(set(range(len(words))) - set(order))
            voted = F.filter(starts_of(p, words, order[0]), lambda s: all_at(s, words, order[1:]))
            return F.filter(voted, lambda s: all_at(s, words, rest))

        def of_texts(p: Column) -> Column:
            """``spans`` of the licence texts that are there, and the largest ``share`` of rare-word weight in place."""

            def vote(i: Column) -> Column:
                held = F.coalesce(F.element_at(postings, F.get(w, i)), none_posted)
                # a text may start before the file does, so places below zero vote too
                return F.transform(held, lambda x: F.struct(x["t"].alias("t"), (i - x["o"]).alias("s"), x["w"].alias("w")))

            def intersected(votes: Column) -> Column:
                def share(g: Column) -> Column:
                    same = F.filter(votes, lambda v: (v["t"] == g["t"]) & (v["s"] == g["s"]))
                    total = F.aggregate(same, F.lit(0.0), lambda acc, v: acc + v["w"])
                    return F.struct(g["t"].alias("t"), g["s"].alias("s"), total.alias("share"))

                return F.transform(F.array_distinct(F.transform(votes, lambda v: F.struct(v["t"].alias("t"), v["s"].alias("s")))), share)

            def key_starts(c: Column, key: Column) -> Column:
                """Where a key phrase stands, at most MOVED words from its place in the text."""
                first = c["s"] + key["place"] - MOVED
                near = F.sequence(F.greatest(first, F.lit(0)), F.greatest(first + 2 * MOVED, F.lit(0)))
                return F.filter(near, lambda k: (k >= first) & (k <= first + 2 * MOVED) & (F.slice(w, k + 1, F.size(key["words"])) == key["words"]))

            def judged(shares: Column) -> Column:
                held = F.array(*keys)
                keys_of = lambda c: F.get(held, c["t"])
                verified = F.filter(shares, lambda c: (c["share"] >= LEAST_SHARE - 1e-12) & F.forall(keys_of(c), lambda key: F.size(key_starts(c, key)) > 0))

                def spans(found: Column) -> Column:
                    def span(t: Column) -> Column:
                        c = F.array_min(F.filter(found, lambda x: x["t"] == t))
                        last = F.element_at(keys_of(c), -1)
                        begin, end = F.array_min(key_starts(c, F.get(keys_of(c), F.lit(0)))), F.array_max(key_starts(c, last)) + F.size(last["words"])
                        label = F.get(F.array(*map(F.lit, names)), t)
                        return F.struct(label.alias("label"), begin.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(False).alias("base"))

                    return F.transform(F.array_distinct(F.transform(found, lambda c: c["t"])), span)

                return F.struct(let(verified, spans).alias("spans"), F.array_max(F.transform(shares, lambda x: x["share"])).alias("share"))

            return let(let(F.flatten(F.transform(p, vote)), intersected), judged)

        def of_phrase(p: Column, label: str, words: list[str], order: list[int]) -> tuple[Column, Column | None]:
            """Spans of a phrase, and the largest weight share of its rare words in place."""
            anchor, others = order[0], order[1:]
            total = sum(weight[words[i]] for i in order)
            starts = starts_of(p, words, anchor)

            def share(s: Column) -> Column:
                out = F.lit(weight[words[anchor]] / total)
                for i in others:
                    out = out + F.when(at(s + i, words[i]), F.lit(weight[words[i]] / total)).otherwise(F.lit(0.0))
                return out

            def span(s: Column) -> Column:
                return F.struct(F.lit(label).alias("label"), s.alias("start"), (s + len(words)).alias("end"), F.lit(label in BASE).alias("base"))

            # one word of two in place tells nothing
            return F.transform(standing(p, words, order), span), F.array_max(F.transform(starts, share)) if len(words) > 2 else None

        def match(p: Column) -> Column:
            found = [of_phrase(p, label, words, order) for label, (words, order) in index.items()]
            none = F.array().cast("array<struct<label:string,start:int,end:int,base:boolean>>")
            nothing = F.struct(none.alias("spans"), F.lit(0.0).alias("partial"))

            def joined(texts: Column) -> Column:
                shares = F.array(*[x for _, x in found if x is not None], texts["share"])
                spans = F.concat(*[x for x, _ in found], texts["spans"])
                return F.struct(spans.alias("spans"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("partial"))

            return F.when(F.size(p) == 0, nothing).otherwise(let(of_texts(p), joined))

        def result(m: Column) -> Column:
            score = F.when(F.size(m["spans"]) > 0, F.lit(1.0)).otherwise(F.least(F.lit(0.99), m["partial"]))
            return F.struct(F.size(w).cast("long").alias("n_words"), m["spans"].alias("spans"), score.alias("score"))

        return let(let(places, match), result)

    return docs.select(F.struct("*").alias("row"), let(words_of(F.col(text).cast("string")), look_up).alias("found"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(read(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "found.*")
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return rows.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels("spans").alias("labels"),
        F.round("score", 9).alias("score"),
    )


def oracle() -> str:
    """The same result in DuckDB: weights from counts, then every phrase at every place."""
    items = [(label, text) for label, text in (BASE | KEY_PHRASES).items()]
    values = ", ".join(f"('{label}', '{text}', {label in BASE})" for label, text in items)
    texts = licence_texts()
    whole = ", ".join(f"('{label}', '{' '.join(words)}', {len(keys)})" for label, (words, keys) in texts.items())
    keys = ", ".join(f"('{label}', {n}, {at}, '{' '.join(key)}')" for label, (_, marked) in texts.items() for n, (at, key) in enumerate(marked))
    return f"""
WITH p AS (SELECT label, string_split(text, ' ') AS pw, base FROM (VALUES {values}) v(label, text, base)),
lt AS (SELECT label, string_split(text, ' ') AS pw, n_keys FROM (VALUES {whole}) v(label, text, n_keys)),
lk AS (SELECT label, n, place, string_split(text, ' ') AS kw FROM (VALUES {keys}) v(label, n, place, text)),
d AS (SELECT row_number() OVER () AS id, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORDS}'), lambda x: x <> '') AS w FROM documents),
voc AS (SELECT DISTINCT unnest(pw) AS word FROM p UNION SELECT DISTINCT unnest(pw) FROM lt),
tok AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
hit AS (SELECT t.* FROM tok t SEMI JOIN voc USING (word)),
df AS (SELECT word, count(DISTINCT id) AS n FROM voc LEFT JOIN hit USING (word) GROUP BY word),
wt AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (n + 0.5)) AS weight FROM df),
pt AS (SELECT label, base, pw, unnest(pw) AS word, generate_subscripts(pw, 1) - 1 AS o FROM p),
pr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, word, o) AS r FROM pt JOIN wt USING (word)),
tot AS (SELECT label, sum(weight) AS total FROM pr WHERE r <= {VOTERS} GROUP BY label),
st AS (SELECT h.id, pr.label, pr.base, pr.pw, h.pos - pr.o AS s FROM pr JOIN hit h USING (word) WHERE r = 1 AND h.pos > pr.o),
sp AS (SELECT st.*, d.w[s:s + len(pw) - 1] = pw AS whole FROM st JOIN d USING (id)),
sh AS (SELECT sp.id, sp.label, sp.s, sum(CASE WHEN h.word IS NOT NULL THEN pr.weight ELSE 0 END / total) AS share
  FROM sp JOIN pr ON pr.label = sp.label AND r <= {VOTERS} JOIN tot ON tot.label = sp.label
  LEFT JOIN hit h ON h.id = sp.id AND h.pos = sp.s + pr.o AND h.word = pr.word
  WHERE len(sp.pw) > 2 GROUP BY ALL),
tw AS (SELECT label, unnest(pw) AS word, generate_subscripts(pw, 1) - 1 AS o FROM lt),
tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, word, o) AS r FROM tw JOIN wt USING (word)) WHERE r <= {TEXT_VOTERS}),
tt AS (SELECT label, sum(weight) AS total FROM tr GROUP BY label),
ts AS (SELECT h.id, tr.label, h.pos - tr.o AS s, sum(tr.weight) / any_value(total) AS share FROM tr JOIN hit h USING (word) JOIN tt USING (label) GROUP BY ALL),
ks AS (SELECT DISTINCT h.id, lk.label, lk.n, lk.place, h.pos AS k FROM lk JOIN hit h ON h.word = lk.kw[1] JOIN d ON d.id = h.id WHERE d.w[h.pos:h.pos + len(kw) - 1] = kw),
tb AS (SELECT DISTINCT id, label FROM (SELECT ts.id, ts.label, s FROM ts JOIN ks ON ks.id = ts.id AND ks.label = ts.label JOIN lt ON lt.label = ts.label
  WHERE share >= {LEAST_SHARE} - 1e-12 AND abs(k - s - place) <= {MOVED} GROUP BY ts.id, ts.label, s, n_keys HAVING count(DISTINCT n) = n_keys)),
best AS (SELECT id, max(share) AS share FROM (SELECT id, share FROM sh UNION ALL SELECT id, share FROM ts) GROUP BY id),
al AS (SELECT id, label, base, s, true AS phrase FROM sp WHERE whole UNION ALL SELECT id, label, false, NULL, false FROM tb),
agg AS (SELECT id, count(*) FILTER (base) AS n_base, min(s - 1) FILTER (base) AS f, max(s - 1) FILTER (base) AS l,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al FROM al GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels,
  round(CASE WHEN al IS NOT NULL THEN 1.0::DOUBLE ELSE least(0.99::DOUBLE, coalesce(share, 0)) END, 9) AS score
FROM d LEFT JOIN agg USING (id) LEFT JOIN best USING (id)"""
