"""DuckDB twins of the catalog queries."""

from __future__ import annotations

from functools import lru_cache

from themeloom.functions.text import stop_words
from themeloom.operators.naming import (
    DOCUMENT_TASK,
    DOMAIN_HINTS,
    GENERAL_HINT,
    KEYWORD_TASK,
    REPLY_FORMAT,
)
from themeloom.plans.catalog import COSINE_EPS, DBSCAN_EPS, DBSCAN_MIN, DOMAINS


def lit(text: str) -> str:
    """A SQL string literal, with line breaks spelled out."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
CHUNK = r"[^\s\p{Z}\x1c-\x1f\x85]+"
WORD = r"[\p{L}\p{N}_]{2,}"

SRC = """src AS (SELECT doc_id, text, CASE WHEN source = 'src19' THEN -1
  ELSE CAST(substr(source, 4) AS INTEGER) END AS topic FROM documents)"""
VEC = """vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v,
  CASE WHEN label = 9 THEN -1 ELSE label END AS topic FROM embeddings)"""
DV = "dv AS (SELECT d.doc_id, d.text, v.v, v.topic FROM documents d JOIN vec v USING (doc_id))"
CELL = """cell AS (SELECT doc_id, topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec)"""
PT = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"

#: DBSCAN labels from pt <id> and near <a, b>.
DENSE = f"""core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {DBSCAN_MIN}),
            link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
            reach(root, id) AS (SELECT id, id FROM core UNION SELECT r.root, l.b FROM reach r JOIN link l ON l.a = r.id),
            comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
            number AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS topic FROM (SELECT DISTINCT root FROM comp)),
            lab AS (SELECT near.a AS id, min(root) AS root FROM near JOIN comp ON comp.id = near.b GROUP BY near.a),
            mine AS (SELECT id, root FROM comp UNION ALL SELECT id, root FROM lab WHERE id NOT IN (SELECT id FROM core))
            SELECT pt.id AS doc_id, coalesce(topic, -1)::INTEGER AS topic FROM pt LEFT JOIN mine USING (id) LEFT JOIN number USING (root)"""


def stops() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words())


def terms(base: str) -> str:
    return f"""word AS (SELECT doc_id, topic, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term
  FROM {base} WHERE topic >= 0),
kept AS (SELECT * FROM word WHERE term NOT IN ({stops()})),
cnt AS (SELECT topic, term, count(*) AS n FROM kept GROUP BY ALL)"""


def weights(base: str) -> str:
    return terms(base) + f""",
tot AS (SELECT topic, greatest(coalesce(sum(n), 0), 1)::BIGINT AS words
  FROM (SELECT DISTINCT topic FROM {base} WHERE topic >= 0) LEFT JOIN cnt USING (topic) GROUP BY topic),
a AS (SELECT avg(words) AS mean_words FROM tot),
dfr AS (SELECT term, count(*) AS df FROM cnt GROUP BY term),
tfidf AS (SELECT topic, term, n, n / words AS tf, df, (n / words) * ln(1.0 + mean_words / df) AS score
  FROM cnt JOIN tot USING (topic) JOIN dfr USING (term), a)"""


def ranked(base: str, count: int = 10) -> str:
    return weights(base) + f""",
rk AS (SELECT topic, rank::INTEGER AS rank, term AS word, score FROM (SELECT *,
  row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM tfidf WHERE score > 0) WHERE rank <= {count})"""


SHOWN = "string_agg(printf('%s=%.6f', word, score), ' ' ORDER BY rank)"


def info(base: str) -> str:
    return f"""sz AS (SELECT topic, count(*) AS n FROM {base} GROUP BY topic)
SELECT topic::INTEGER AS "Topic", n AS "Count",
  coalesce(string_agg(word, '_' ORDER BY rank) FILTER (rank <= 3), '') AS "Name",
  coalesce(string_agg(word, ', ' ORDER BY rank) FILTER (rank <= 5), '') AS "Representation", coalesce({SHOWN}, '') AS "Top_words"
FROM sz LEFT JOIN rk USING (topic) WHERE topic <> -1 GROUP BY topic, n
UNION ALL SELECT -1, n, 'Outliers', 'Documents not assigned to any topic', '' FROM sz WHERE topic = -1"""


def bm25(weight: str, k1: float, b: float) -> str:
    return f"""dl AS (SELECT topic, sum({weight}) AS dl FROM tfidf GROUP BY topic),
shape AS (SELECT count(*) AS nt, avg(coalesce(dl, 0)) AS avgdl FROM tot LEFT JOIN dl USING (topic))
SELECT topic, term, round(ln((nt - df + 0.5) / (df + 0.5) + 1.0) * {weight} * ({k1} + 1.0)
  / ({weight} + {k1} * (1.0 - {b} + {b} * dl / avgdl)), 6) AS bm25
FROM tfidf JOIN dl USING (topic), shape"""


def hashed(source: str, key: str, text: str, width: int = 64) -> str:
    """Hash vectors hv <key, pos, x> of a relation."""
    return f"""hw AS (SELECT {key}, '<' || unnest(regexp_extract_all(lower({text}), '{WORD}')) || '>' AS w FROM {source}),
hg AS (SELECT {key}, ('0x' || substr(md5(substr(w, i, 3)), 1, 8))::BIGINT AS h
  FROM (SELECT {key}, w, unnest(range(1, length(w) - 1)) AS i FROM hw)),
hs AS (SELECT {key}, h % {width} AS pos, sum(CASE WHEN (h >> 16) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hg GROUP BY ALL),
hl AS (SELECT {key}, sqrt(sum(x * x)) AS len FROM hs GROUP BY ALL),
hv AS (SELECT k.{key}, p.pos, coalesce(x / nullif(len, 0), 0) AS x
  FROM (SELECT DISTINCT {key} FROM {source}) k CROSS JOIN (SELECT unnest(range(0, {width})) AS pos) p
  LEFT JOIN hs USING ({key}, pos) LEFT JOIN hl USING ({key}))"""


RELEVANCE = f"""{VEC}, {DV}, {ranked('dv', 50)},
cw AS (SELECT DISTINCT word AS term FROM rk),
{hashed('cw', 'term', 'term')},
wv AS (SELECT term AS word, list(x ORDER BY pos) AS w FROM hv GROUP BY term),
cen AS (SELECT topic, list(m ORDER BY pos) AS c FROM (SELECT topic, pos, avg(x) AS m FROM (
  SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM dv WHERE topic >= 0) GROUP BY ALL) GROUP BY topic),
rel AS (SELECT topic, rank, word, w, coalesce(list_cosine_similarity(w, c), 0) AS relevance
  FROM rk JOIN wv USING (word) JOIN cen USING (topic))"""


def mmr(count: int, diversity: float) -> str:
    """Greedy selection, one step per CTE."""
    steps = ["p1 AS (SELECT topic, 1 AS k, arg_min(struct_pack(word := word, w := w, relevance := relevance), (-relevance, rank)) AS s FROM rel GROUP BY topic)"]
    seen = "p1"
    for k in range(2, count + 1):
        steps.append(
            f"""g{k} AS (SELECT r.topic, r.rank, any_value(r.word) AS word, any_value(r.w) AS w, any_value(r.relevance) AS relevance,
    {1 - diversity} * any_value(r.relevance) - {diversity} * max(list_cosine_similarity(r.w, o.s.w)) AS gain, bool_or(r.word = o.s.word) AS used
    FROM rel r JOIN ({seen}) o ON o.topic = r.topic GROUP BY r.topic, r.rank),
p{k} AS (SELECT topic, {k} AS k, arg_min(struct_pack(word := word, w := w, relevance := relevance), (-gain, rank)) AS s
  FROM g{k} WHERE NOT used GROUP BY topic)"""
        )
        seen = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, k + 1))
    return ",\n".join(steps) + f"""
SELECT topic, k::INTEGER AS rank, s.word AS word, round(s.relevance, 6) AS score FROM ({seen})"""


def domain_case(value) -> str:
    cases = " ".join(f"WHEN {i} THEN {value(name)}" for i, name in enumerate(DOMAINS[:3]))
    return f"(CASE topic % 4 {cases} ELSE {value(DOMAINS[3])} END)"


def instruction(task: str) -> str:
    return lit(task) + " || " + domain_case(lambda d: lit(DOMAIN_HINTS.get(d, GENERAL_HINT)))


KEYWORD_PROMPTS = f"""kp AS (SELECT topic, list(word ORDER BY rank) AS words, string_agg(word, ', ' ORDER BY rank) AS keywords
  FROM rk GROUP BY topic),
pr AS (SELECT topic, words, keywords, {instruction(KEYWORD_TASK)} || {lit(chr(10) + REPLY_FORMAT + chr(10) + 'Keywords: ')}
  || keywords || {lit(chr(10) + 'JSON:')} AS prompt FROM kp)"""

REPRESENTATIVE = """cen AS (SELECT topic, list(m ORDER BY pos) AS c FROM (SELECT topic, pos, avg(x) AS m FROM (
  SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM dv WHERE topic >= 0) GROUP BY ALL) GROUP BY topic),
rd AS (SELECT topic, rank::INTEGER AS rank, doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY list_distance(v, c), doc_id) AS rank FROM dv JOIN cen USING (topic))
  WHERE rank <= 5)"""

REPLIES = r"""good AS (SELECT doc_id, '{"topic_name": " ' || head || ' ", "reasoning": "from ' || doc_id || '"}' AS good, head
  FROM (SELECT doc_id, regexp_replace(substr(text, 1, 40), '["\\\n\r\t]', ' ', 'g') AS head FROM documents))
SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN '' WHEN 3 THEN '' ELSE trim(head) END AS name,
  CASE doc_id % 4 WHEN 0 THEN 'from ' || doc_id WHEN 3 THEN 'only ' || doc_id
    WHEN 1 THEN 'from ' || doc_id ELSE '' END AS reasoning FROM good"""

FREQUENT = r"""sz AS (SELECT topic, count(*) AS n FROM src WHERE topic >= 0 GROUP BY topic),
f3 AS (SELECT topic, r, text FROM (SELECT topic, text, row_number() OVER (PARTITION BY topic ORDER BY doc_id) AS r FROM src WHERE topic >= 0) WHERE r <= 3),
wd AS (SELECT topic, r, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (
  SELECT topic, r, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM f3)),
fw AS (SELECT topic, w, count(*) AS n, min((r, p)) AS seen FROM wd WHERE regexp_full_match(w, '[a-z]{4,}') GROUP BY topic, w),
fk AS (SELECT topic, w, k FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, seen) AS k FROM fw) WHERE k <= 3),
fn AS (SELECT topic, string_agg(w, ' & ' ORDER BY k) AS name FROM fk GROUP BY topic)"""

SIL = """size AS (SELECT topic, count(*) AS n FROM vec WHERE topic >= 0 GROUP BY topic),
part AS (SELECT a.doc_id, a.topic, b.topic AS other, sum({d}) AS s FROM vec a JOIN vec b ON a.topic >= 0 AND b.topic >= 0 GROUP BY ALL),
ab AS (SELECT doc_id, topic, max(CASE WHEN other = topic AND n > 1 THEN s / (n - 1) END) AS a,
  min(CASE WHEN other <> topic THEN s / n END) AS b FROM part JOIN (SELECT topic AS other, n FROM size) USING (other) GROUP BY ALL),
sil AS (SELECT avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS value FROM ab)"""
#: The same over the points of lowest hash, with the error of their mean.
EST = """one AS (SELECT doc_id, CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab),
pick AS (SELECT s FROM one ORDER BY md5('42:' || doc_id), doc_id::VARCHAR LIMIT {m}),
est AS (SELECT avg(s) AS value, 3 * sqrt(((SELECT count(*) FROM one) - count(*)) / greatest(1, (SELECT count(*) FROM one) - 1))
  * coalesce(stddev_samp(s), 0) / sqrt(count(*)) AS error, count(*) AS points FROM pick)"""

CENTROIDS = """cen AS (SELECT topic, list(m ORDER BY pos) AS c, max(n) AS n FROM (SELECT topic, pos, avg(x) AS m, count(*) AS n FROM (
  SELECT topic, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM vec WHERE topic >= 0) GROUP BY ALL) GROUP BY topic)"""
DB = """spread AS (SELECT topic, avg(list_distance(v, c)) AS s FROM vec JOIN cen USING (topic) GROUP BY topic),
worst AS (SELECT i.topic, max(coalesce((si.s + sj.s) / nullif(list_distance(i.c, j.c), 0), 0)) AS w FROM cen i JOIN cen j ON i.topic <> j.topic
  JOIN spread si ON si.topic = i.topic JOIN spread sj ON sj.topic = j.topic GROUP BY i.topic),
db AS (SELECT avg(w) AS value FROM worst)"""
COH = """coh AS (SELECT avg(m) AS value FROM (SELECT a.topic, avg(list_cosine_similarity(a.v, b.v)) AS m FROM vec a JOIN vec b
  ON a.topic = b.topic AND a.doc_id < b.doc_id AND a.topic >= 0 GROUP BY a.topic))"""
DIV = """div AS (SELECT 1 - avg(list_cosine_similarity(i.c, j.c)) AS value FROM cen i JOIN cen j ON i.topic < j.topic)"""


def balance_of(base: str) -> str:
    return f"bal AS (SELECT exp(-stddev_pop(n) / avg(n)) AS value FROM (SELECT count(*) AS n FROM {base} WHERE topic <> -1 GROUP BY topic))"


def coverage_of(base: str) -> str:
    return f"""cov AS (SELECT count(DISTINCT topic) FILTER (topic <> -1) AS n_topics, count(*) AS n_documents,
  count(*) FILTER (topic <> -1) AS n_assigned, count(*) FILTER (topic = -1) AS n_outliers FROM {base})"""


COVERAGE_COLUMNS = "n_topics, n_documents, n_assigned, n_outliers, round(n_assigned / n_documents * 100, 6) AS coverage_pct"

DOCS = "SELECT doc_id, text, lang, source, n_chars FROM documents"
VECTORS_LONG = "SELECT doc_id, (pos - 1)::INTEGER AS pos, round(x, 6) AS x FROM cell"

KNN = """pair AS (SELECT a.doc_id AS src, b.doc_id AS dst, {d} AS dist FROM vec a JOIN vec b ON a.doc_id <> b.doc_id),
nn AS (SELECT src, dst, dist, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM pair) WHERE rank <= {k})"""

COSINE = "1 - list_cosine_similarity(a.v, b.v)"
EUCLID = "list_distance(a.v, b.v)"

FUZZY = """rho AS (SELECT src, coalesce(min(dist) FILTER (dist > 0), 0) AS rho, avg(dist) AS mean, count(*) AS k FROM nn GROUP BY src),
gap AS (SELECT src, list(greatest(dist - rho, 0)) AS gaps, any_value(k) AS k FROM nn JOIN rho USING (src) GROUP BY src),
sol(src, gaps, k, i, lo, hi, mid) AS (
  SELECT src, gaps, k, 0, 0.0::DOUBLE, NULL::DOUBLE, 1.0::DOUBLE FROM gap
  UNION ALL
  SELECT src, gaps, k, i + 1, lo2, hi2, CASE WHEN hi2 IS NULL THEN mid * 2 ELSE (lo2 + hi2) / 2 END FROM (
    SELECT *, CASE WHEN over THEN lo ELSE mid END AS lo2, CASE WHEN over THEN mid ELSE hi END AS hi2 FROM (
      SELECT *, list_sum(list_transform(gaps, lambda g: CASE WHEN g > 0 THEN exp(-g / mid) ELSE 1.0 END)) > log2(k) AS over
      FROM sol WHERE i < 64))),
sig AS (SELECT src, rho, greatest(mid, mean * 1e-3, 1e-300) AS sigma FROM sol JOIN rho USING (src) WHERE i = 64),
p AS (SELECT src, dst, CASE WHEN dist <= rho THEN 1.0 ELSE exp(-(dist - rho) / sigma) END AS p FROM nn JOIN sig USING (src)),
s AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, coalesce(max(CASE WHEN src < dst THEN p END), 0) AS a,
  coalesce(max(CASE WHEN src > dst THEN p END), 0) AS b FROM p GROUP BY ALL)
SELECT u, v, round(a + b - a * b, 6) AS w FROM s"""


def prim(distance: str) -> str:
    """Spanning tree by Prim: ``tree <id, best, step>``, each vertex with the edge that brought it in."""
    return f"""prim(id, best, step) USING KEY (id) AS (
  SELECT id, CASE WHEN id = (SELECT min(id) FROM node) THEN 0.0 ELSE 1e300 END::DOUBLE, 0::BIGINT FROM node
  UNION
  SELECT p.id, CASE WHEN p.id = x.id THEN p.best ELSE least(p.best, {distance}) END,
    CASE WHEN p.id = x.id THEN x.step ELSE 0 END
  FROM recurring.prim p JOIN node b ON b.id = p.id
  JOIN (SELECT q.id, q.best, (SELECT max(step) + 1 FROM recurring.prim) AS step FROM recurring.prim q WHERE q.step = 0 ORDER BY q.best, q.id LIMIT 1) x ON true
  JOIN node a ON a.id = x.id WHERE p.step = 0)"""


@lru_cache(maxsize=1)
def oracles() -> dict[str, str]:
    s, v = f"WITH {SRC}", f"WITH {VEC}"
    made = {
        "document_tokens": f"""SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
            FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)""",
        "stopword_antijoin": f"{s}, {terms('src').replace('WHERE topic >= 0', '')} SELECT doc_id, count(*) AS n_kept, count(DISTINCT term) AS n_distinct FROM kept GROUP BY doc_id",
        "ngram_counts": f"""{s}, tk AS (SELECT topic, list_filter(regexp_extract_all(lower(text), '{WORD}'), lambda t: t NOT IN ({stops()})) AS t FROM src WHERE topic >= 0),
            g AS (SELECT topic, unnest(t) AS term FROM tk UNION ALL
              SELECT topic, t[i] || ' ' || t[i + 1] FROM (SELECT topic, t, unnest(range(1, len(t))) AS i FROM tk))
            SELECT topic, term, count(*) AS n FROM g GROUP BY ALL""",
        "topic_texts": f"{s} SELECT topic, doc_id, text FROM src WHERE topic >= 0",
        "topic_word_totals": f"{s}, {weights('src')} SELECT topic, words, round(mean_words, 6) AS mean_words FROM tot, a",
        "term_frequencies": f"{s}, {weights('src')} SELECT topic, term, n, round(tf, 9) AS tf FROM tfidf",
        "term_topic_frequencies": f"{s}, {weights('src')} SELECT term, df FROM dfr",
        "ctfidf_scores": f"{s}, {weights('src')} SELECT topic, term, n, round(tf, 9) AS tf, df, round(score, 9) AS score FROM tfidf",
        "bm25_scores": f"{s}, {weights('src')}, {bm25('score', 1.5, 0.75)}",
        "bm25_counts": f"{s}, {weights('src')}, {bm25('n', 1.2, 0.5)}",
        "vocabulary": f"{s}, {terms('src')} SELECT DISTINCT term FROM cnt",
        "topic_top_words": f"{s}, {ranked('src')} SELECT topic, rank, word, round(score, 9) AS score FROM rk",
        "topic_words_only": f"{s}, {ranked('src')} SELECT topic, count(*)::INTEGER AS n_words, string_agg(word, ' ' ORDER BY rank) AS words FROM rk GROUP BY topic",
        "topics": f"{s}, {ranked('src')} SELECT topic, {SHOWN} AS words FROM rk GROUP BY topic",
        "topic_info": f"{s}, {ranked('src')}, {info('src')}",
        "topic_info_by_vectors": f"{v}, {DV}, {ranked('dv')}, {info('dv')}",
        "document_info": f"""{s} SELECT doc_id, text AS "Document", topic AS "Topic", len(regexp_extract_all(text, '{CHUNK}'))::INTEGER AS "Document_Length" FROM src""",
        "topic_lines": f"{s}, {ranked('src')} SELECT topic, string_agg(printf('%s (%.3f)', word, score), ', ' ORDER BY rank) AS line FROM rk GROUP BY topic",
        "topics_over_time": """WITH e AS (SELECT epoch_us(ts) AS us, event_type AS topic FROM events WHERE ts IS NOT NULL),
            r AS (SELECT min(us) AS lo, max(us) - min(us) AS width FROM e),
            b AS (SELECT CASE WHEN width = 0 THEN 0 ELSE least(floor((us - lo) * 10 / width), 9) END::INTEGER AS bin, topic, count(*) AS n FROM e, r GROUP BY ALL),
            f AS (SELECT bin::INTEGER AS bin, topic, coalesce(n, 0) AS n FROM (SELECT DISTINCT topic FROM e) CROSS JOIN (SELECT unnest(range(0, 10)) AS bin)
              LEFT JOIN b USING (bin, topic))
            SELECT bin, (lo + floor(bin * width / 10))::BIGINT AS bin_start_us, topic, n,
              round(coalesce(n / nullif(sum(n) OVER (PARTITION BY bin), 0), 0), 6) AS share FROM f, r""",
        "topics_over_time_fine": """WITH e AS (SELECT epoch_us(ts) AS us, event_type AS topic FROM events WHERE ts IS NOT NULL),
            r AS (SELECT min(us) AS lo, max(us) - min(us) AS width FROM e),
            b AS (SELECT least(floor((us - lo) * 720 / width), 719)::INTEGER AS bin, topic, count(*) AS n FROM e, r GROUP BY ALL)
            SELECT bin, topic, n, round(n / sum(n) OVER (PARTITION BY bin), 6) AS share FROM b""",
        "picked_text": "SELECT conv_id * 1000 + turn AS doc_id, coalesce(text, '') AS text FROM conversations",
        "text_limit": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100",
        "assigned_rows": f"{v} SELECT doc_id, topic FROM vec WHERE topic >= 0",
        "word_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{CHUNK}'))::INTEGER AS n_words FROM documents",
        "snippets": f"""SELECT doc_id, CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS snippet
            FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g')) AS t FROM documents)""",
        "excerpts": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM documents",
        "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5('23:' || doc_id), doc_id LIMIT 250",
        "plane_points": f"{v} SELECT doc_id, round(v[1], 6) AS x, round(v[2], 6) AS y FROM vec",
        "topic_labels": f"{s} SELECT doc_id, CASE WHEN topic = -1 THEN 'Outlier' ELSE 'Topic ' || topic END AS label FROM src",
        "sample_per_topic": f"""{s} SELECT topic, doc_id, pick::INTEGER AS pick FROM (SELECT topic, doc_id,
            row_number() OVER (PARTITION BY topic ORDER BY md5('23:' || doc_id), doc_id) AS pick FROM src WHERE topic >= 0) WHERE pick <= 5""",
        "hash_embedding": f"WITH {hashed('documents', 'doc_id', 'text')} SELECT doc_id, pos::INTEGER AS pos, round(x, 6) AS x FROM hv",
        "encoder_hook": """WITH c AS (SELECT doc_id, i, length(text) - length(replace(text, substr('aeiou', i + 1, 1), '')) AS x
              FROM documents CROSS JOIN (SELECT unnest(range(0, 5)) AS i)),
            l AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM c GROUP BY doc_id)
            SELECT doc_id, i::INTEGER AS pos, round(coalesce(x / nullif(len, 0), 0), 6) AS x FROM c JOIN l USING (doc_id)""",
        "l2_normalize": f"""{v}, {CELL}, l AS (SELECT doc_id, sqrt(sum((x * 3 + 1) * (x * 3 + 1))) AS len FROM cell GROUP BY doc_id)
            SELECT doc_id, (pos - 1)::INTEGER AS pos, round((x * 3 + 1) / len, 6) AS x FROM cell JOIN l USING (doc_id)""",
        "candidate_vectors": f"""{s}, {ranked('src', 50)}, cw AS (SELECT DISTINCT word AS term FROM rk), {hashed('cw', 'term', 'term')}
            SELECT term, pos::INTEGER AS pos, round(x, 6) AS x FROM hv""",
        "attached_vectors": f"{v}, {DV} SELECT doc_id, topic, length(text)::INTEGER AS n, round(v[1], 6) AS first FROM dv",
        "keyword_candidates": f"{s}, {ranked('src', 50)} SELECT topic, rank, word, round(score, 9) AS score FROM rk",
        "topic_centroids": f"""{v}, {CENTROIDS} SELECT topic, n, (pos - 1)::INTEGER AS pos, round(x, 6) AS x
            FROM (SELECT topic, n, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM cen)""",
        "keyword_cosine": f"WITH {RELEVANCE} SELECT topic, rank, word, round(relevance, 6) AS relevance FROM rel",
        "refined_keywords": f"""WITH {RELEVANCE} SELECT topic, k::INTEGER AS rank, word, round(relevance, 6) AS score FROM (
            SELECT *, row_number() OVER (PARTITION BY topic ORDER BY relevance DESC, word) AS k FROM rel) WHERE k <= 10""",
        "mmr_words": f"WITH {RELEVANCE}, {mmr(10, 0.5)}",
        "naming_instructions": f"""{s}, t AS (SELECT DISTINCT topic FROM src WHERE topic >= 0)
            SELECT topic, {instruction(KEYWORD_TASK)} AS for_keywords, {instruction(DOCUMENT_TASK)} AS for_documents FROM t""",
        "prompt_keywords": f"{s}, {ranked('src', 15)}, {KEYWORD_PROMPTS} SELECT topic, keywords, prompt FROM pr",
        "representative_docs": f"{v}, {DV}, {REPRESENTATIVE} SELECT topic, rank, doc_id, text FROM rd",
        "representative_docs_random": f"""{s} SELECT topic, rank::INTEGER AS rank, doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text
            FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('23:' || doc_id), doc_id) AS rank FROM src WHERE topic >= 0) WHERE rank <= 5""",
        "prompt_documents": f"""{v}, {DV}, {ranked('dv')}, {REPRESENTATIVE},
            g AS (SELECT topic, string_agg(rank || '. ' || text, chr(10) ORDER BY rank) AS docs FROM rd GROUP BY topic),
            h AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS words FROM rk GROUP BY topic)
            SELECT topic, {instruction(DOCUMENT_TASK)} || {lit(chr(10) + REPLY_FORMAT + chr(10) + 'Documents:' + chr(10))} || docs
              || coalesce({lit(chr(10) + 'Key terms: ')} || words, '') || {lit(chr(10) + chr(10) + 'JSON:')} AS prompt
            FROM g LEFT JOIN h USING (topic)""",
        "parsed_replies": f"WITH {REPLIES}",
        "generated_names": f"""{s}, {ranked('src', 15)}, {KEYWORD_PROMPTS}
            SELECT topic, CASE length(words[1]) % 3 WHEN 0 THEN array_to_string(words[1:3], '_') WHEN 1 THEN array_to_string(words[1:3], ', ')
                ELSE 'About ' || words[-1] END AS name,
              CASE length(words[1]) % 3 WHEN 0 THEN '' WHEN 1 THEN 'Keywords: ' || substr(keywords, 1, 50) ELSE 'It fits' END AS reasoning FROM pr""",
        "keyword_names": f"{s}, {ranked('src', 15)} SELECT topic, string_agg(word, ' & ' ORDER BY rank) FILTER (rank <= 3) AS name, '' AS reasoning FROM rk GROUP BY topic",
        "fallback_names": f"""{s}, {ranked('src', 15)}, sz AS (SELECT topic, count(*) AS n FROM src WHERE topic >= 0 GROUP BY topic)
            SELECT topic, string_agg(word, ' & ' ORDER BY rank) FILTER (rank <= 3) AS name, 'Fallback name from ' || any_value(sz.n) || ' documents' AS reasoning
            FROM rk JOIN sz USING (topic) GROUP BY topic""",
        "frequent_word_names": f"""{s}, {FREQUENT} SELECT topic, coalesce(name, 'Topic') AS name,
            'Fallback name from ' || n || ' documents' AS reasoning FROM sz LEFT JOIN fn USING (topic)""",
        "coverage": f"{s}, {coverage_of('src')} SELECT {COVERAGE_COLUMNS} FROM cov",
        "silhouette": f"{v}, {SIL.format(d=EUCLID)} SELECT round(value, 6) AS silhouette FROM sil",
        "silhouette_squared": f"{v}, {SIL.format(d=EUCLID + ' ** 2')} SELECT round(value, 6) AS silhouette_sq FROM sil",
        "silhouette_estimated": f"""{v}, {SIL.format(d=EUCLID)}, {EST.format(m=200)}
            SELECT round(value, 6) AS silhouette, round(error, 6) AS silhouette_error, points AS silhouette_points FROM est""",
        "davies_bouldin": f"{v}, {CENTROIDS}, {DB} SELECT round(value, 6) AS davies_bouldin FROM db",
        "coherence": f"{v}, {COH} SELECT round(value, 6) AS coherence FROM coh",
        "diversity": f"{v}, {CENTROIDS}, {DIV} SELECT round(value, 6) AS diversity FROM div",
        "balance": f"{s}, {balance_of('src')} SELECT round(value, 6) AS balance FROM bal",
        "evaluation_report": f"""{v}, {coverage_of('vec')}, {SIL.format(d=EUCLID)}, {CENTROIDS}, {DB}, {COH}, {DIV}, {balance_of('vec')},
            m AS (SELECT 'n_topics' AS metric, n_topics::DOUBLE AS value FROM cov UNION ALL SELECT 'n_documents', n_documents FROM cov
              UNION ALL SELECT 'n_assigned', n_assigned FROM cov UNION ALL SELECT 'n_outliers', n_outliers FROM cov
              UNION ALL SELECT 'coverage_pct', n_assigned / n_documents * 100 FROM cov UNION ALL SELECT 'silhouette', value FROM sil
              UNION ALL SELECT 'davies_bouldin', value FROM db UNION ALL SELECT 'coherence', value FROM coh
              UNION ALL SELECT 'diversity', value FROM div UNION ALL SELECT 'balance', value FROM bal)
            SELECT metric, round(value, 6) AS value FROM m""",
        "cluster_summary": f"{s}, {coverage_of('src')} SELECT n_topics, n_outliers, round(n_outliers / n_documents * 100, 6) AS outlier_pct FROM cov",
        "points_2d": f"""{v}, {DV} SELECT doc_id, round(v[1], 6) AS x, round(v[2], 6) AS y,
            CASE WHEN length(t) > 120 THEN substr(t, 1, 120) || '...' ELSE t END AS snippet, topic,
            CASE WHEN topic = -1 THEN 'Outlier' ELSE 'Topic ' || topic END AS label, NULL::INTEGER AS colour
            FROM (SELECT *, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS t FROM dv) ORDER BY md5('23:' || doc_id), doc_id LIMIT 150""",
        "topic_distribution": f"""{s} SELECT topic, 'Topic ' || topic AS label, count(*) AS n, (SELECT count(*) FROM src WHERE topic = -1) AS outliers
            FROM src WHERE topic <> -1 GROUP BY topic ORDER BY n DESC, topic LIMIT 10""",
        "topic_words_bar": f"{s}, {ranked('src', 12)} SELECT word, round(score, 9) AS score FROM rk WHERE topic = 3",
        "topic_words_grid": f"""{s}, {ranked('src')}, g AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS i FROM (SELECT DISTINCT topic FROM rk))
            SELECT topic, (i // 3 + 1)::INTEGER AS grid_row, (i % 3 + 1)::INTEGER AS grid_col, rank, word, round(score, 9) AS score
            FROM rk JOIN g USING (topic) WHERE rank <= 7 AND i < 9""",
        "chart_tables": f"""{v}, {DV}, {ranked('dv')} SELECT 'points_2d' AS chart, least(count(*), 12000) AS n_rows FROM dv
            UNION ALL SELECT 'topic_distribution', least(count(DISTINCT topic), 25) FROM dv WHERE topic >= 0
            UNION ALL SELECT 'topic_words_grid', count(*) FROM (SELECT topic, rank, dense_rank() OVER (ORDER BY topic) AS t FROM rk) WHERE rank <= 7 AND t <= 9""",
        **{f"roundtrip_{kind}": DOCS for kind in ("csv", "tsv", "json", "json_lines", "jsonl", "parquet", "feather")},
        "roundtrip_embeddings": f"{v}, {CELL} {VECTORS_LONG}",
        "saved_topic_info": f"{s}, {ranked('src')}, {info('src')}",
        "saved_document_info": f"""{s} SELECT doc_id, text AS "Document", topic AS "Topic", len(regexp_extract_all(text, '{CHUNK}'))::INTEGER AS "Document_Length" FROM src""",
        "saved_metrics": f"{s}, {coverage_of('src')} SELECT {COVERAGE_COLUMNS} FROM cov",
        "run_history": f"""{s} SELECT run_id, topic, count(*) AS n FROM src CROSS JOIN
            (SELECT unnest(['20240101_000000', '20240102_000000']) AS run_id) GROUP BY ALL""",
        "saved_model": f"""{v}, {DV} SELECT 'topic_info' AS part, count(DISTINCT topic) AS n_rows FROM dv UNION ALL SELECT 'document_info', count(*) FROM dv
            UNION ALL SELECT 'embeddings', count(*) FROM dv UNION ALL SELECT 'reduced', count(*) FROM dv UNION ALL SELECT 'parameters', 1""",
        "reduction_variance": f"{v}, {CELL} SELECT round(sum(s), 6) AS total_variance FROM (SELECT var_samp(x) AS s FROM cell GROUP BY pos)",
        "reduction_spectrum": f"""{v}, {CELL}, cov AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM cell a JOIN cell b USING (doc_id) GROUP BY ALL)
            SELECT 1 AS power, round(sum(c), 6) AS value FROM cov WHERE i = j UNION ALL SELECT 2, round(sum(c * c), 6) FROM cov
            UNION ALL SELECT 3, round(sum(a.c * b.c * d.c), 6) FROM cov a JOIN cov b ON b.i = a.j JOIN cov d ON d.i = b.j AND d.j = a.i""",
        "chart_table_content": f"""{v}, {DV}, {ranked('dv')}, pts AS (SELECT * FROM dv ORDER BY md5('23:' || doc_id), doc_id LIMIT 12000)
            SELECT 'points_2d' AS chart, doc_id::VARCHAR AS item, printf('%.6f %.6f %d', v[1], v[2], topic) AS shown FROM pts
            UNION ALL SELECT 'topic_distribution', topic::VARCHAR, count(*)::VARCHAR FROM dv WHERE topic >= 0 GROUP BY topic
            UNION ALL SELECT 'topic_words_grid', topic || '-' || rank, printf('%d %d %s %.6f', i // 3 + 1, i % 3 + 1, word, score)
            FROM (SELECT *, dense_rank() OVER (ORDER BY topic) - 1 AS i FROM rk) WHERE rank <= 7 AND i < 9""",
        "saved_model_content": f"""{v}, {DV}, {ranked('dv')}, ti AS ({info('dv').replace("sz AS (", "WITH sz AS (", 1)})
            SELECT 'topic_info' AS part, "Topic"::VARCHAR AS item, concat_ws(' ', "Count", "Name", "Representation") AS shown FROM ti
            UNION ALL SELECT 'document_info', doc_id::VARCHAR, concat_ws(' ', topic, len(regexp_extract_all(text, '{CHUNK}')), md5(text)) FROM dv
            UNION ALL SELECT unnest(['embedding', 'reduced']), doc_id::VARCHAR, printf('%d %.6f %.6f', len(v), v[1], v[len(v)]) FROM dv
            UNION ALL SELECT 'parameters', 'seed', '42'""",
        "document_names": f"""{v}, {DV}, {ranked('dv')} SELECT topic, string_agg(word, ' & ' ORDER BY rank) FILTER (rank <= 3) AS name FROM rk GROUP BY topic""",
        "knn_graph": f"{v}, {KNN.format(d=COSINE, k=15)} SELECT src, dst, rank, round(dist, 6) AS dist FROM nn",
        "fuzzy_edges": f"WITH RECURSIVE {VEC}, {KNN.format(d=COSINE, k=15)}, {FUZZY}",
        "core_distance": f"{v}, {KNN.format(d=EUCLID, k=5)} SELECT src AS id, round(dist, 6) AS core FROM nn WHERE rank = 5",
        "mutual_reachability": f"""{v}, {KNN.format(d=EUCLID, k=5)}, c AS (SELECT src AS id, dist AS core FROM nn WHERE rank = 5),
            e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(dist) AS dist FROM nn GROUP BY ALL)
            SELECT u, v, round(greatest(a.core, b.core, dist), 6) AS w FROM e JOIN c a ON a.id = u JOIN c b ON b.id = v""",
        "mst_weight": f"""WITH RECURSIVE {VEC}, {KNN.format(d=EUCLID, k=5)},
            node AS (SELECT vec.doc_id AS id, v, dist AS core FROM nn JOIN vec ON vec.doc_id = nn.src WHERE rank = 5),
            {prim('greatest(a.core, b.core, list_distance(a.v, b.v))')}
            SELECT count(*) - 1 AS n_edges, round(sum(best), 6) AS total_weight FROM prim""",
        "single_linkage": f"""WITH RECURSIVE {PT}, node AS (SELECT * FROM pt), {prim('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')},
            cut AS (SELECT min(best) AS t FROM (SELECT best FROM prim ORDER BY best DESC LIMIT 11)),
            run AS (SELECT id, sum(CASE WHEN best >= t THEN 1 ELSE 0 END) OVER (ORDER BY step) AS g FROM prim, cut),
            nm AS (SELECT g, row_number() OVER (ORDER BY min(id)) - 1 AS topic FROM run GROUP BY g)
            SELECT id AS doc_id, topic::INTEGER AS topic FROM run JOIN nm USING (g)""",
        "dbscan_labels": f"""WITH RECURSIVE {PT}, near AS (SELECT a.id AS a, b.id AS b FROM pt a JOIN pt b
              ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {DBSCAN_EPS}), {DENSE}""",
        "dbscan_cosine": f"""WITH RECURSIVE pt AS (SELECT vec_id AS id, embedding::DOUBLE[] AS p FROM embeddings), near AS (SELECT a.id AS a, b.id AS b
              FROM pt a JOIN pt b ON 1 - list_cosine_similarity(a.p, b.p) <= {COSINE_EPS}), {DENSE}""",
    }
    from themeloom.plans import extended

    # the same results on another way
    return made | extended.oracles() | {"model_refined": made["refined_keywords"], "knn_graph_tiles": made["knn_graph"]}
