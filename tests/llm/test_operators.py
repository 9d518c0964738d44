"""The operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import base64
import bisect
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from themeloom.llm import byte_bpe, embedding_dedup, licenses, lm_scoring, packing, quality_classifier, quality_rules, sharding, simhash, token_files
from themeloom.llm.attention import Vocabulary, forward, gradients, logits, score_texts, start, to_bytes, windows
from themeloom.llm.common import stored
from themeloom.llm.graph import components
from themeloom.llm.lattice import decode, shortest
from themeloom.session import scratch_path

WORD = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, row string, score double"


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma's", "delta,", "épsilon", "zêta.", "the", "of", "and", "naïve", "42", "x" * 40, "cc", "by", "İx", "áb"]
    out = [" ".join(rng.choices(words, k=rng.choice([1, 3, 12, 40, 200]))) for _ in range(50)]
    out += [None, "", "   ", "\n\n", "one", "one two", out[0], out[0], out[1].upper(), out[2] + " tail", "word " * 5000, "<|endoftext|> x\x1cy", "CC-BY and the GNU General Public License, all rights reserved"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(None if i == 3 else 7 if i in (7, 8) else i, t, "mine", 0.5) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    held = Tokenizer.from_file(WORD)
    held.encode_special_tokens = True
    return [*held.encode(text or "", add_special_tokens=False).ids, 2]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_simhash_matches_brute_force(docs, rows, empty):
    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = Counter((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, root, strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_a_dense_group_and_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    rng = random.Random(1)
    fps = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(40)} | {rng.getrandbits(64) for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r.node: r.root for r in components(simhash.links(simhash.distance_table(spark.createDataFrame([(f,) for f in signed], "fp long")))).collect()}
    un = lambda x: x & ((1 << 64) - 1)
    root = {f: f for f in signed}
    for _ in signed:
        root = {f: min(root[g] for g in signed if (un(f) ^ un(g)).bit_count() <= 3) for f in signed}
    assert all(got.get(f, f) == root[f] for f in signed)


def test_license_spans(docs, rows, empty):
    found = licenses.scan(docs).select("row.*", "found")
    assert found.columns[:4] == ["doc_id", "text", "row", "score"]
    import re

    for r in found.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        assert r.found.n_words == len(words)
        want = {(k, i) for k, p in licenses.phrases().items() for i in range(len(words)) if words[i : i + len(p)] == p}
        assert {(s.label, s.start) for s in r.found.spans if s.label in licenses.phrases()} == want
        assert 0 <= r.found.score <= 1 and (r.found.score == 1) == bool(want)
    assert licenses.scan(empty).count() == 0


def test_licence_texts_by_votes_and_key_phrases(spark):
    texts = licenses.licence_texts()
    rows, want = [], []
    for label, (words, keys) in texts.items():
        assert len(keys) >= 2 and all(words[at : at + len(key)] == key for at, key in keys)
        body = list(words)
        # a word of no key phrase is changed, and ten are put in
        free = next(i for i in range(len(words)) if not any(at <= i < at + len(key) for at, key in keys) and i > keys[0][0])
        moved = [*body[:free], "othername", *["inserted"] * 10, *body[free + 1 :]]
        broken = list(body)
        broken[keys[-1][0] + 1] = "broken"
        for text, there in ((body, True), (["head"] * 300 + body + ["tail"] * 300, True), (moved, True), (broken, False), (keys[0][1], False)):
            rows.append((len(rows), " ".join(text).upper() if there else ", ".join(text)))
            want.append(label if there else None)
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "plain words of no licence")]
    want += [None] * 3
    got = {r.row.doc_id: r.found for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, text), label in zip(rows, want, strict=True):
        found = {s.label: (s.start, s.end) for s in got[i].spans if s.label in texts}
        assert found.keys() == ({label} if label else set()), (i, text)
        if label:
            (first, key), (last, end) = texts[label][1][0], texts[label][1][-1]
            words = text.lower().split()
            a, b = found[label]
            assert words[a : a + len(key)] == key and words[b - len(end) : b] == end


def test_quality_rules(docs, rows, empty):
    import re

    for r in quality_rules.apply_rules(docs).select("row.text", "rules").collect():
        w = re.split("[\x20\x09-\x0d]+", r.text or "")
        w = [x for x in w if x]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r.rules.n_words, r.rules.n_repeat_words, r.rules.word_chars) == (len(w), len(covered), sum(map(len, w)))
        assert r.rules.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.apply_rules(empty).count() == 0


def test_lines_go_and_documents_with_them(spark):
    clean = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(1, clean), (2, clean + "\nHome | About | Help"), (3, "Home | About | Help | More\n" * 3 + clean[:60]), (4, clean + "\nPlease accept every cookie here")]
    got = {r.row.doc_id: r.rules for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == clean and got[1].lost_chars == 0
    assert got[2].kept and got[2].clean_text == clean and got[4].clean_text == clean
    assert not got[3].kept
    kept = quality_rules.keep(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.select("row.doc_id").collect()) == [1, 2, 4]


def test_attention_gradients_and_distribution():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300)
    v = Vocabulary(counts)
    w = {k: x.astype(np.float64) for k, x in start(v.prior).items()}
    ids = rng.integers(0, 300, (3, 16))
    rows, kinds, real = v.row[ids], v.kind[rng.integers(0, 300, (3, 16))], np.ones((3, 16))

    def loss():
        z = logits(w, forward(w, rows)["h"])
        z = z - np.log(np.exp(z).sum(-1, keepdims=True))
        return -np.take_along_axis(z, kinds[..., None], 2).mean()

    g = gradients(w, rows, kinds, real)
    for name in w:
        at = tuple(np.unravel_index(np.abs(g[name]).argmax(), g[name].shape))
        w[name][at] += 1e-4
        up = loss()
        w[name][at] -= 2e-4
        down = loss()
        w[name][at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[name][at], rel=2e-3)
    # chances of all ids after any text sum to one, and windows do not depend on company
    one = np.array([score_texts(w, v, np.array([5, i]), np.array([2]), 2)[0] for i in range(300)])
    first = score_texts(w, v, np.array([5]), np.array([1]), 2)[0]
    assert (10 ** (one - first)).sum() == pytest.approx(1, rel=1e-4)
    long = rng.integers(0, 300, 100)
    both = score_texts(w, v, np.concatenate([long, [4, 2]]), np.array([100, 2]), 2)
    assert both[0] == pytest.approx(score_texts(w, v, long, np.array([100]), 2)[0])


def test_scores_against_a_plain_loop():
    """log10 chances id by id: one window at a time, one place at a time, without matrices of windows."""
    rng = np.random.default_rng(3)
    v = Vocabulary(rng.integers(0, 60, 200))
    w = {k: x.astype(np.float64) for k, x in start(v.prior).items()}
    text = rng.integers(0, 200, 75)
    total = 0.0
    for place in range(len(text)):
        # the first window reads from the start, later ones begin every 24 ids and score their last 24
        begin = 0 if place < 32 else 24 * -(-(place - 31) // 24)
        seen = [v.row[text[i - 1]] if i else v.row[2] for i in range(begin, place + 1)]
        x = [w["e"][r] + w["p"][i] for i, r in enumerate(seen)]
        scores = [np.exp(x[-1] @ w["q"] @ (y @ w["k"]) / 4.0) for y in x]
        mixed = sum(s * (y @ w["v"]) for s, y in zip(scores, x)) / sum(scores)
        z = np.exp((x[-1] + mixed @ w["o"]) @ w["u"] + w["b"])
        kind = v.kind[text[place]]
        total += np.log10(z[kind] / z.sum()) + v.within[text[place]] / np.log(10)
    assert score_texts(w, v, text, np.array([75]), 2)[0] == pytest.approx(total, rel=1e-9)


def test_attention_batches_with_and_without_first_windows():
    """Gradients of a batch are the sums over its windows, whichever of them have an output from their first place on."""
    rng = np.random.default_rng(4)
    v = Vocabulary(rng.integers(0, 60, 200))
    w = {k: x.astype(np.float64) for k, x in start(v.prior).items()}
    ids, sizes = rng.integers(0, 200, 410), np.array([300, 1, 40, 3, 66])
    target, before, _ = windows(ids, sizes, 2)
    row, kind = np.append(v.row[ids], v.row[2]), v.kind[ids]
    real = target >= 0
    whole = gradients(w, row[before], np.where(real, kind[target], 0), real)
    parts = [gradients(w, row[before[i : i + 1]], np.where(real, kind[target], 0)[i : i + 1], real[i : i + 1]) for i in range(len(real))]
    for name in w:
        assert np.allclose(sum(p[name] * r.sum() for p, r in zip(parts, real)) / real.sum(), whole[name], rtol=1e-9, atol=1e-14)


def test_lm_cuts_each_text_to_ids_once(spark, monkeypatch):
    """The model learns from the ids that it scores, which are the library's, and scoring reads no text."""
    from tokenizers import Tokenizer

    kept = {}
    plain = lm_scoring.stored
    monkeypatch.setattr(lm_scoring, "stored", lambda df, name="step": kept.setdefault(name, plain(df, name)))
    texts = ["Some WORDS, and 12 more", "", None, "h\u0331 H\u0331 \u0130x caf\u00e9's don't", "a\x1cb c"] * 3
    out = lm_scoring.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD)
    assert out.count() == len(texts)
    held = Tokenizer.from_file(WORD)
    held.encode_special_tokens = True
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in kept["encoded"].collect()}
    assert got == {i: [*held.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert "text" not in kept["scored"].columns and set(kept) == {"word-counts", "encoded", "train-ids", "scored"}


def test_attention_context():
    sizes = np.array([100, 1, 33, 32])
    target, before, text = windows(np.zeros(166, np.int64), sizes, 2)
    assert sorted(target[target >= 0]) == list(range(166))
    first = (np.cumsum(sizes) - sizes)[text]
    # ids read at or before each scored place, of its own text: all there are, or at least eight
    at = np.argwhere(target >= 0)
    seen = {int(target[i, j]): (int((before[i, : j + 1] >= first[i]).sum()), int(target[i, j] - first[i])) for i, j in at}
    assert all(n == earlier if earlier < 32 else 8 < n <= 32 for n, earlier in seen.values())
    assert max(n for n, _ in seen.values()) == 32
    # the 17th id and on still hear of the first
    v = Vocabulary(np.arange(300))
    w = start(v.prior)
    a, b = np.full(30, 7), np.full(30, 7)
    b[0] = 290
    tail = lambda ids: score_texts(w, v, ids, np.array([30]), 2)[0] - score_texts(w, v, ids[:29], np.array([29]), 2)[0]
    assert abs(tail(a) - tail(b)) > 1e-6


def test_lm_base_score(docs, rows, empty):
    got = lm_scoring.score_documents(docs, WORD).collect()
    split = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t, *_ in rows if d is not None and not held(d) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(split(t)), sum(c[w] > 0 for w in split(t)), round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for d, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.score_documents(empty, WORD).count() == 0


def test_lm_learns_from_every_training_document(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "PORTION", 50)
    seen = []
    plain = lm_scoring.trained
    monkeypatch.setattr(lm_scoring, "trained", lambda portions, counts: seen.append(portions) or plain(portions, counts))
    rows = [(i, f"text {i} of some words") for i in range(40)] + [(5, "text 5 of some words")] * 30
    out = lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), WORD)
    assert out.count() == 70
    parts, got = seen[0].collect(), Counter()
    for p in parts:
        ids, at = np.frombuffer(p.ids, "<u4"), 0
        for n in np.frombuffer(p.sizes, "<u4"):
            got[tuple(ids[at : at + n])] += 1
            at += n
        assert at == len(ids) <= 130
    assert got == Counter(tuple(ids_of(t)) for d, t in rows if zlib.crc32(str(d).encode()) % 10)
    assert len({p.portion for p in parts}) > 3
    # a small corpus trains too: the weights leave their start
    counts = np.ones(len(Tokenizer.from_file(WORD).get_vocab()), np.int64)
    assert plain(seen[0], counts) != to_bytes(start(Vocabulary(counts).prior))


def test_lattice():
    rng = np.random.default_rng(2)
    assert len(shortest()) == 240 and {int((s**2).sum()) for s in shortest()} == {8}
    x = rng.normal(size=(200, 8))
    near = decode(x) / 2
    for step in shortest() / 2:
        assert (((x - near) ** 2).sum(1) <= ((x - near - step) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("chunk", [2000, 10])
def test_embedding_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64))
    v = np.concatenate([base[rng.integers(0, 12, 90)] + rng.normal(size=(90, 64)) * rng.choice([0.05, 0.2, 0.3], (90, 1)), np.repeat(base[:1], 15, 0)])
    rows = [(i, [float(x) for x in r], i % 2) for i, r in enumerate(v)]
    rows += [(200, None, 0), (201, [0.0] * 64, 0), (202, [float("nan")] * 64, 1), (203, rows[0][1], None), (204, [1.0, None], 0), (205, [], 1), (206, [2.0, 0.0], 1), (207, [1.0, 0.0], 1)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.arange(len(v))[:, None] % 2 == np.arange(len(v)) % 2)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.array([root[link[i]].min() for i in range(len(v))])
    assert [got[i].n_links for i in range(len(v))] == (link.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(v))] == root.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(200, 206))
    assert got[207].component_id == 206 and not got[207].kept and got[207].n_links == 1
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_rank_code_round_trip():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(ranks) + 1):
        block = token_files.pack_block([None, 5], np.array([0, n]), ranks[:n])
        doc_ids, sizes, back = token_files.unpack_block(block)
        assert doc_ids == [None, 5] and sizes.tolist() == [0, n] and (back == ranks[:n]).all()
    with pytest.raises(ValueError):
        token_files.unpack_block(b"x" * 40)


def test_token_file(spark, docs, rows, empty, monkeypatch):
    path = scratch_path(spark, "token-file")
    token_files.write_token_file(docs, path, WORD, 2)
    got = token_files.read_token_file(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((d, raw(ids_of(t))) for d, t, *_ in rows)
    path = scratch_path(spark, "token-file")
    token_files.write_token_file(empty, path, WORD, 2)
    assert token_files.read_token_file(spark, path).count() == 0


def test_quality_classifier(spark, empty):
    rng = random.Random(3)
    made = lambda i: (i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30)) if i % 2 else "BUY!! NOW!! " * 15)
    docs = spark.createDataFrame([*map(made, range(120)), (500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(1, 1), (2, None), (None, 1), (900, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = {r.row.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 1) for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1)
    assert got[500] == got[501] and 0 <= got[500] <= 1 and len(got) == 122
    nothing = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, nothing).collect()} == {0.5}
    assert quality_classifier.score(empty, model).count() == 0


def test_quality_votes_against_a_plain_loop(spark):
    """Words of one shape tell the labels apart; ties, long texts, repeated documents and clashing columns."""
    rng = random.Random(8)
    good, bad = (["".join(rng.choices("abcdefgh", k=5)) for _ in range(40)] for _ in range(2))
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=30))) for i in range(200)] + [(400, " ".join(good) * 3000), (401, "x" * 300_000), (402, " ".join(bad)), (402, " ".join(bad))]
    docs = spark.createDataFrame([(d, t, 0.1, 9) for d, t in rows], "doc_id long, text string, score double, quality int").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(rows) and got[0].row.asDict().keys() == {"doc_id", "text", "score", "quality"}
    learned = [(quality_classifier.terms(t.encode()), d % 2) for d, t in rows[:200] if zlib.crc32(str(d).encode()) % 3 != 1]
    assert Counter(model.labels) == Counter(y for _, y in learned)
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)

    def latent(terms):
        x = np.log1p(terms) * model.idf
        x = np.concatenate([unit(x[: quality_classifier.FORM]), quality_classifier.WORDS_SHARE * unit(x[quality_classifier.FORM :])])
        return unit(x @ model.axes)

    held = [(latent(t), y) for t, y in learned]
    for r in got:
        mine = latent(quality_classifier.terms(r.row.text.encode()))
        votes = sorted(((float(mine @ v), y) for v, y in held), reverse=True)
        near = votes[: quality_classifier.NEIGHBOURS]
        weight = [max(c, 0) ** quality_classifier.POWER for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight) if sum(weight) else model.prior
        if votes[quality_classifier.NEIGHBOURS - 1][0] - votes[quality_classifier.NEIGHBOURS][0] > 1e-5:
            assert r.score == pytest.approx(want, abs=1e-4)
        if r.row.doc_id < 200 and zlib.crc32(str(r.row.doc_id).encode()) % 3 == 1:
            assert (r.score >= 0.5) == (r.row.doc_id % 2 == 1)
    same = [r.score for r in got if r.row.doc_id == 402]
    assert len(same) == 2 and same[0] == same[1] < 0.5


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard_by_bytes(docs, 4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((d, t) for d, t, *_ in rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    # a group of copies with most of the bytes is cut, small groups are not
    hot = [(i, "copy " * 50) for i in range(600)] + [(600 + i, f"text {i // 2} " * 40) for i in range(300)]
    got = sharding.shard_by_bytes(spark.createDataFrame(hot, "doc_id long, text string")).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(x - mean) < 0.02 * mean for x in sizes.values())
    assert sharding.shard_by_bytes(empty).count() == 0


def test_splitters_of_many_targets(spark):
    rng = random.Random(11)
    rows = [(rng.getrandbits(64) - (1 << 63), i, rng.randint(1, 9)) for i in range(9000)] + [(77, i - 500, 5) for i in range(1000)]
    keys = spark.createDataFrame(rows, "h long, d long, size long")
    total = sum(r[2] for r in rows)
    targets = [total * k // 1801 for k in range(1, 1801)]
    got = sharding.splitters(keys, targets, [0.0] * 1800)
    rows.sort()
    below = np.cumsum([0, *(r[2] for r in rows)])
    at = [bisect.bisect_left(rows, (h, d)) for h, d in got]
    assert all(abs(below[i] - t) == np.abs(below - t).min() for i, t in zip(at, targets, strict=True))


def test_packing_plan():
    rng = random.Random(8)
    for histogram in ({}, {4096: 3}, {1: 5000}, {2049: 7}, Counter(min(4096, 1 + int(rng.expovariate(1 / 900))) for _ in range(5000))):
        planned = packing.plan(dict(histogram))
        used = Counter()
        for need, n in planned:
            assert n > 0 and sum(k * m for k, m in need) <= 4096
            for k, m in need:
                used[k] += n * m
        assert used == Counter(histogram)
    windows = sum(n for _, n in planned)
    assert windows <= 1.01 * sum(k * n for k, n in histogram.items()) / 4096 + 1


def test_packing(docs, rows, empty):
    got = packing.pack_documents(docs, WORD, 2, window=256).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    pieces = Counter((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in got)
    want = Counter()
    for d, t, *_ in rows:
        ids = ids_of(t)
        for s in range(0, len(ids), 256):
            want[d, s, len(ids[s : s + 256]), raw(ids[s : s + 256]), len(ids)] += 1
    assert pieces == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(empty, WORD, 2).count() == 0


def test_byte_bpe(docs, rows, empty):
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    held = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((d, sha(raw(held.encode_ordinary(t or ""))), sha((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, sha(bytes(r.ids)), sha(bytes(r.decoded))) for r in got) == want
    assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 7), (60, 61), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 60: 60, 61: 60}


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    made = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(60)) + "."
    clean = [made() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, clean[i]) for i in range(5)] + [(200 + i, " ".join(f"{w}***" for w in made().split())) for i in range(20)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows] + [(300, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0 if 200 <= d < 300 else 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == list(enumerate(clean))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in out) == sorted((i, raw(ids_of(t))) for i, t in enumerate(clean))


def test_every_pair_within_the_radius_meets_and_passes():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    a[:2] = 0, np.uint64(1) << np.uint64(63)
    for bits in (0, 1, 2, 3):
        flip = np.zeros(len(a), np.uint64)
        for row in range(len(a)):
            for b in rng.choice(64, bits, replace=False):
                flip[row] |= np.uint64(1) << np.uint64(b)
        b = a ^ flip
        da, db = simhash.distances(a), simhash.distances(b)
        assert (da[:, 0] == np.bitwise_count(a)).all() and np.abs(da.astype(int) - db).max() <= bits
        assert (simhash.meeting_keys(da, 3) == simhash.meeting_keys(db, 3)).any(1).all()
        assert simhash.near(a, b, da.astype(np.int8), db.astype(np.int8), 3).all()
    chance = simhash.near(a, np.roll(a, 1), da.astype(np.int8), np.roll(da, 1, 0).astype(np.int8), 3)
    # only the first two, which differ in one bit
    assert np.flatnonzero(chance).tolist() == [1]


def test_near_dedup_of_edited_copies(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for g in range(30):
        base = [word() for _ in range(400)]
        for c in range(12 if g == 0 else 4):
            own = list(base)
            for at in rng.sample(range(400), c % 4):
                own[at] = word()
            rows.append((len(rows), " ".join(own)))
    # copies without an id, other texts under one id, repeated rows
    rows += [(900, None), (901, " "), (902, "two words"), (903, "Two words"), (None, rows[0][1]), (None, "alone and unnamed"), (5, "another text"), (950, "same row"), (950, "same row")]
    fps = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(rows))]
    groups = {}
    for (d, t), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append((d is None, d, t))
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(6), "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == sorted(min(g, key=lambda x: (x[0], x[1] or 0))[:2] for g in groups.values())
    assert len(kept) < len(rows) // 2 + 5


def test_scaled_vectors_and_null_ids(spark):
    """Squares that run over or under lose no link; a row without an id is not kept; clashing columns play no part."""
    rows = [(1, [1e200, 1e200], 0, 5), (2, [1e-200, 1e-200], 0, 5), (None, [1.0, 1.0], 0, 5), (3, [1.0, -1.0], 0, 5), (None, [5.0, 0.1], 1, 5)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(map(tuple, embedding_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, False), (3, 0, 3, True), (None, 0, None, False)], key=str)


def test_quality_fit_makes_no_second_table_of_counts():
    """The driver holds the counts of the labelled documents once."""
    import tracemalloc

    from themeloom.llm import quality_classifier as quality

    rng = np.random.default_rng(0)
    counts, labels = rng.poisson(0.3, (4000, quality.TERMS)).astype(float), np.arange(4000) % 2.0
    first = quality.weighed(counts[:300], np.ones(quality.TERMS))
    assert np.array_equal(first, quality.weigh(counts[:300].copy(), np.ones(quality.TERMS)))
    size = counts.nbytes
    tracemalloc.start()
    model = quality.fit(counts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.8 * size and model.axes.base is None and model.vectors.shape == (4000, quality.LATENT)
