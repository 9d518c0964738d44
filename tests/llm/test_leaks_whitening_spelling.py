"""Decontamination, whitening and spelling variants against brute force, and on nulls, empty and long input, ties and repeats."""

import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import decontamination, exact_spectrum, spelling, whitening
from themeloom.llm.suffix_automaton import Automaton

SCHEMA = "doc_id long, text string, item_id string, found int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def leaks(docs, items, window):
    """``(doc_id, n_words, n_hit, items)`` by trying every window at every place."""
    windows = {}
    for item, text in items:
        w = words_of(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w = words_of(text)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                held = windows.get(tuple(w[i : i + k]))
                if held:
                    hit.update(range(i, i + k))
                    found |= held
        out.append((doc, len(w), len(hit), tuple(sorted(found - {None}))))
    return out


@pytest.fixture(scope="module")
def leaked():
    rng = random.Random(6)
    # few words, so that many partial matches, overlaps and returns to shorter suffixes occur
    run = lambda n: rng.choices(["ab", "Cd", "e", "ÉF", "9"], k=n)
    items = [(str(i), " ".join(run(rng.choice([1, 3, 5, 6, 9, 14])))) for i in range(40) if i]
    items += [("x", None), ("y", " ,.; "), (None, "no name item here"), ("7", items[3][1]), ("8", "zz " * 30), ("9", items[5][1].upper())]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(run(rng.randint(0, 60)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "Zz " * 12), (3, docs[3][1]), (103, "see: no NAME item-here!"), (104, "w " * 30_000 + items[12][1] + " w" * 5)]
    return [(*d, "clash", 1) for d in docs], items


def rows_of(found):
    return Counter((r.row.doc_id, r.found.n_words, r.found.n_hit, tuple(r.found["items"])) for r in found.collect())


@pytest.mark.parametrize("block", [100_000, 60])
def test_leaks_against_brute_force(spark, monkeypatch, leaked, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "PIECE", 20 if block == 60 else 20_000)
    docs, items = leaked
    left, right = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.find_leaks(left, right, window=6)
    assert rows_of(got) == Counter(leaks(docs, items, 6))
    for r in decontamination.remove_leaks(left, right, window=6, most_covered=0.3).collect():
        marked = {i for s in r.found.spans for i in range(s.first, s.end)}
        assert len(marked) == r.found.n_hit and r.kept == (r.found.n_hit <= 0.3 * r.found.n_words)
        assert words_of(r.clean_text) == [w for i, w in enumerate(words_of(r.row.text)) if i not in marked]
        assert (r.clean_text == r.row.text) == (not marked)
    assert decontamination.find_leaks(left.limit(0), right).count() == 0
    none = decontamination.find_leaks(left, right.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.found.n_hit for r in none)


def test_portions_and_longest_matches(monkeypatch):
    monkeypatch.setattr(decontamination, "PORTION", 7)
    text = "Alpha beta, gamma " * 9
    assert [w for p in decontamination.portions(text.encode()) for w in p.split()] == decontamination.words_of(text.encode())
    reader = Automaton([b"a b c d e".split(), b"b c x".split()], 3).reader()
    for part in (b"q a b", b"c d z b c", b"x a", b"b"):
        reader.read(part.split())
    assert reader.n_words == 11 and reader.spans == [[1, 5, 4], [6, 9, 3]] and reader.items() == {0, 1}


def charpoly(matrix):
    """Coefficients by the method of Faddeev and LeVerrier in fractions."""
    d = len(matrix)
    m = [[Fraction(0)] * d for _ in range(d)]
    out = [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][x] * m[x][j] for x in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(matrix[i][x] * m[x][i] for i in range(d) for x in range(d)) / k)
    return [int(c) for c in out[::-1]]


def spectrum(matrix, count=4):
    residues = {p: exact_spectrum.polynomial_mod(np.array([[x % p for x in r] for r in matrix]), p) for p in exact_spectrum.primes_needed(matrix)}
    polynomial = exact_spectrum.remaindered(residues)
    roots = exact_spectrum.largest_roots(polynomial, count)
    axes = [[float(x) for x in v] for root in roots for v in exact_spectrum.null_space(matrix, *root)]
    return polynomial, [root / 2**shift for root, shift, times in roots for _ in range(times)], np.array(axes)


def test_characteristic_polynomial_and_roots():
    rng = np.random.default_rng(3)
    cases = [[[0]], [[5]], [[2, 1], [1, 2]], [[0, 1], [1, 0]], np.diag([3, 3, 3, 1, 0]).tolist(), np.ones((4, 4), int).tolist()]
    for d in (3, 6, 9):
        a = rng.integers(-10**6, 10**6, (d + 2, d)).astype(object)
        cases.append((a.T @ a).tolist())
    for matrix in cases:
        polynomial, roots, axes = spectrum(matrix)
        assert polynomial == charpoly(matrix)
        want = np.linalg.eigvalsh(np.array(matrix, float))[::-1]
        want = want[want > 1e-9 * max(1, want[0])]
        assert len(roots) >= min(4, len(want)) and np.allclose(roots[:4], want[: len(roots)][:4], rtol=1e-9)
        if len(axes):
            m = np.array(matrix, float)
            assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-14
            assert np.abs(axes @ m - np.array(roots)[:, None] * axes).max() < 1e-13 * roots[0]


def test_close_roots_are_told_apart():
    # the roots 10**12 and 10**12 + 1: far closer than double precision could part in a rotated basis
    turn = np.array([[2, -1, 2], [2, 2, -1], [-1, 2, 2]], object)
    matrix = (turn @ np.diag([10**12 + 1, 10**12, 1]).astype(object) @ turn.T).tolist()
    _, roots, axes = spectrum(matrix)
    assert np.allclose(roots, [9 * (10**12 + 1), 9 * 10**12, 9], rtol=1e-15)
    assert np.allclose(np.abs(axes), np.abs(turn.T.astype(float)) / 3, atol=1e-15)


def whitened(spark, rows, schema="vec_id long, embedding array<double>, whitened int"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    made = whitening.fit(df)
    return made, whitening.whiten(df, made).collect()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(300, 6)) * [9, 5, 3, 2, 1, 0.5]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    rows += [(900 + i, rows[0][1], 0) for i in range(50)] + [(0, rows[1][1], 0), (None, rows[2][1], 0)]
    bad = [(800, None, 0), (801, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (802, [float("nan")] * 6, 0), (803, [float("inf")] + [0.0] * 5, 0), (804, [], 0), (805, [1.0, 2.0], 0)]
    made, got = whitened(spark, rows + bad)
    x = np.array([np.floor(np.array(v) * 256) for _, v, _ in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    assert made.n == n and made.identity_error < 1e-12
    assert np.allclose(made.explained, values[::-1][:4] / values.sum(), rtol=1e-12)
    side = np.sign((made.axes * axes.T[::-1][:4]).sum(1))
    want = (x - total / n) @ axes[:, ::-1][:, :4] / np.sqrt(values[::-1][:4]) * side
    key = lambda r: (str(r[0]), str(r[1]))
    expect = sorted(((r[0], int(d), tuple(w)) for r, d, w in zip(rows, ((n * x - total) ** 2).sum(1), want, strict=True)), key=key)
    found = sorted(((r.row.vec_id, int(r.deviation), tuple(r.whitened)) for r in got), key=key)
    assert [r[:2] for r in found] == [r[:2] for r in expect]
    assert np.allclose([r[2] for r in found], [r[2] for r in expect], atol=1e-10)


def test_whitening_of_few_equal_and_huge_vectors(spark):
    assert whitened(spark, []) [1] == []
    for rows in ([(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0)] * 5):
        made, got = whitened(spark, rows)
        assert made.n == 1 and len(got) == len(rows) and all(r.whitened == [] and r.deviation == 0 for r in got)
    # two vectors have one component; entries beyond a long stop at its ends
    made, got = whitened(spark, [(1, [1e300, 0.0, 1.0], 0), (2, [-1e300, 0.0, 1.0], 0), (3, [0.0, 0.0, 1.0], 0)])
    assert made.n == 3 and len(made.axes) == 1 and made.identity_error < 1e-12
    assert sorted(round(r.whitened[0] * made.axes[0][0], 6) for r in got) == [-1.224745, 0.0, 1.224745]
    # equal variances share a plane; any basis of it whitens
    made, got = whitened(spark, [(i, v, 0) for i, v in enumerate(([1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]))])
    assert made.identity_error < 1e-12 and np.allclose(made.explained, [0.5, 0.5])


def test_scatter_is_exact():
    rng = np.random.default_rng(5)
    for top in (9, 1 << 20, 1 << 40, 1 << 62):
        y = rng.integers(-top, top, (2500, 3))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.scatter(y) == want).all()
        assert (whitening.scatter(y.astype(object) * (1 << 70)) == want * (1 << 140)).all()
        assert (whitening.unpacked(whitening.pa.array(whitening.packed(y)), 3) == y).all()


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    """``(word, form, root, n, n_near, form_n)`` by comparing all pairs."""
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 5 * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


@pytest.mark.parametrize("chunk", [1 << 18, 40])
def test_variants_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "PAIRS", 50 if chunk == 40 else 1 << 18)
    rng = random.Random(2)
    counts = {"".join(rng.choices("abé", k=rng.randint(1, 8))): 5 ** rng.randint(1, 6) for _ in range(500)}
    counts |= {"x" * 3000: 4, "x" * 3001: 400, "x" * 2999 + "y": 80}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.group_variants(words).collect()} == variants(counts)
    assert spelling.group_variants(words.limit(0)).count() == 0


def test_runs_and_deleted_characters(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PORTION", 5)
    rng = random.Random(4)
    letters = "abcXYZÀ×ÿ"
    texts = ["".join(rng.choices(letters + " .1Ā中_\n", weights=[9] * len(letters) + [2] * 7, k=rng.randint(0, 400))) for _ in range(60)]
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, "abc" * 9000), (None, "abc abc abd"), (-30, texts[0])]
    want = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.counted(docs, drop_one_in=3).collect()} == want
    monkeypatch.setattr(spelling, "LEAST_LENGTH", 3)
    monkeypatch.setattr(spelling, "LEAST_COUNT", 2)
    counts = {w: n for w, n in want.items() if len(w) >= 3 and n >= 2}
    assert {tuple(r) for r in spelling.spelling_variants(docs, drop_one_in=3).collect()} == variants(counts)


def test_queries_of_the_operators(spark):
    from themeloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    leaked = QUERIES["op12_suffix_automaton"](spark, sf)
    assert leaked.dtypes == [("doc_id", "bigint"), ("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items_sha256", "string"), ("contaminated", "boolean")]
    want = leaks([(r.doc_id, r.text) for r in docs], [(str(r.item_id), r.text) for r in items], 10)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in leaked.collect()) == Counter((d, w, h, len(i), h > 0) for d, w, h, i in want)
    out = QUERIES["op13_whitening"](spark, sf)
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    assert out.groupBy("component").agg(F.count("*").alias("c")).count() == 4 and out.agg(F.max("identity_error")).first()[0] < 1e-9
    assert QUERIES["op11_spelling_variants"](spark, sf).dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


LONG, TEXT, FLAG, REAL, INT = "bigint", "string", "boolean", "double", "int"
CONTRACTS = {
    "op1_": {"doc_id": LONG, "fingerprint": TEXT, "component_id": LONG},
    "op2_": {"doc_id": LONG, "n_words": LONG, "n_base": LONG, "first_word": LONG, "last_word": LONG, "base_labels": TEXT, "labels": TEXT, "score": REAL},
    "op3_": {"doc_id": LONG, "held_out": FLAG, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": REAL, "score": REAL},
    "op4_": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
    "op5_": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op6_": {"doc_id": LONG, "n_words": LONG, "word_chars": LONG, "n_symbols": LONG, "n_dup_lines": LONG, "n_repeat_words": LONG, "base_failed": FLAG, "kept": FLAG},
    "op7_": {"doc_id": LONG, "held_out": FLAG, "score": REAL, "predicted": INT},
    "op8_": {"doc_id": LONG, "size": LONG, "text_crc32": LONG, "law": TEXT, "shard": INT, "slot": LONG, "grown_shard": INT},
    "op9_": {"doc_id": LONG, "start": LONG, "length": LONG, "ids_crc32": LONG, "doc_tokens": LONG, "sequence_id": LONG, "offset": LONG},
    "op10_": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
}


@pytest.mark.parametrize("operator", CONTRACTS)
def test_query_columns_and_digests(spark, operator):
    """Each query over a whole small table: the columns of its contract, a row for each row, digests of what it says they are."""
    from themeloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    (name,) = [q for q in QUERIES if q.startswith(operator)]
    out = QUERIES[name](spark, sf)
    assert dict(out.dtypes).items() >= CONTRACTS[operator].items()
    rows = out.collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    if operator == "op4_":
        assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    elif operator != "op9_":
        assert sorted(r.doc_id for r in rows) == sorted(docs)
    if operator in ("op5_", "op9_"):
        import public_tokenizers
        from tokenizers import Tokenizer

        held = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
        held.encode_special_tokens = True
        at = 0
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            ids = np.array([*held.encode(docs[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
            if operator == "op5_":
                assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
                at += len(ids)
            else:
                assert (r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes()))
    if operator == "op8_":
        assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.grown_shard is None for r in rows)
    if operator == "op10_":
        import hashlib

        assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)
    if operator in ("op3_", "op7_"):
        modulus, rest = (10, 0) if operator == "op3_" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in rows)
