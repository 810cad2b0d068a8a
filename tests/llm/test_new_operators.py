"""Periodic runs, SentencePiece and whitening against brute force and the libraries they must agree with."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from subpanel.llm import periodic, pieces, queries, whitening
from tests.llm.test_operators import LONG, documents, empty, odd  # noqa: F401


def plain_runs(words, least=12):
    """Every lag over every word."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i - q, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


@pytest.mark.parametrize("window", [5, periodic.WINDOW])
def test_runs_against_brute_force(monkeypatch, window):
    monkeypatch.setattr(periodic, "WINDOW", window)
    rnd = random.Random(1)
    for _ in range(600):
        texts = []
        for _ in range(rnd.randrange(1, 4)):
            words = [rnd.choice("abcde"[:rnd.choice([1, 2, 2, 3, 5])]) for _ in range(rnd.randrange(0, 80))]
            if words and rnd.random() < 0.6:
                a = rnd.randrange(len(words))
                p = 1 + (len(words) - a) // rnd.randrange(2, 8)
                words = [words[i if i < a else a + (i - a) % p] for i in range(len(words))]
            texts.append(words + words[:rnd.choice([0, 0, -1, len(words)])])
        for words, (runs, collapsed) in zip(texts, periodic.text_runs([" ".join(w) for w in texts])):
            assert runs == plain_runs(words) and collapsed == plain_collapsed(words, runs)


def test_runs_of_long_texts():
    """One word, and stretches of one word between others: neither takes a cell for each pair of words."""
    assert list(periodic.text_runs(["a " * 300_000])) == [([(0, 300_000, 1)], "a")]
    found, _ = next(periodic.text_runs([" ".join((["a"] * 200 + ["b"]) * 200)]))
    assert (0, 40_200, 201) in found and (0, 200, 1) in found


def planted(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_periodic_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf_dir).collect()}
    rows = queries.op11_periodic(spark, sf_dir).collect()
    assert len(rows) == len(texts) and any(r["n_runs"] for r in rows)
    for r in rows:
        words = planted(r["doc_id"], texts[r["doc_id"]])
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best and r["n_runs"] == len(runs)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r["collapsed_sha256"] == sha(plain_collapsed(words, runs))


def test_periodic_odd_rows(odd, empty):  # noqa: F811
    rows = odd.withColumn("runs", F.lit("mine")).select("*", periodic.periodic(F.col("text")).alias("found")).collect()
    assert len(rows) == odd.count() and {r["runs"] for r in rows} == {"mine"}
    for r in rows:
        if r["text"] != LONG:
            assert r["found"]["runs"] == [] and r["found"]["collapsed"] == " ".join((r["text"] or "").split())
    assert empty.select(periodic.periodic(F.col("text"))).count() == 0


# --- SentencePiece --------------------------------------------------------------------------

TEXTS = ["", " ", "  ", "a", " a", "a ", "a  b", "   a    b   ", "\n", "\n\n a\n", "\t\t", "▁", "▁▁a ▁b", " ▁", "<s>", "</s> <unk> <0x0A>",
         "日本語テキスト 😀😀", "\x00a\x00", "x" * 500, " " * 100, "a\r\nb", "ﬁ ½ ①", "　 b", "𠮷𠮷", "é" * 50, "�",
         "http://www.example.com/?q=1&b=2", "    def f(x):\n        return x\n\n\n", "Ａ１ ㈱ ﾊﾟ ガ ﬃ İ ​‍ x­ Ω ﷺ é́", "한글 각 ᄀ ᆨ"]


def mixed_texts(n):
    rnd = random.Random(3)
    signs = ["a", "b", " ", "  ", "\n", "▁", "é", "日", "😀", "the", " of", "ing", "\t", "<s>", "0", "1", "."]
    return TEXTS + ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.mark.parametrize("short", [0, pieces.SHORT])
def test_encoding_equals_library(monkeypatch, library, short):
    """Ids, spans of source bytes and decoded texts; with the queue for all parts and for long ones only."""
    monkeypatch.setattr(pieces, "SHORT", short)
    model = pieces.Model(pieces.default_model(), remember=50)
    for text in mixed_texts(800):
        ids, begins, ends = (np.frombuffer(x, "<u4").tolist() for x in model.encode(text))
        want = library.encode(text, return_type="proto").pieces
        assert list(zip(ids, begins, ends)) == [(p.id, p.begin, p.end) for p in want], text
        assert model.decode([1, *ids, 2]) == library.decode([1, *ids, 2])
    assert len(model.seen) < 300


def test_decoding_equals_library(library):
    rnd, model = random.Random(4), pieces.Model(pieces.default_model())
    for _ in range(5000):
        ids = [rnd.choice([0, 1, 2, rnd.randrange(3, 259), rnd.randrange(100, 259), rnd.randrange(259, 32000), 259, 268, 263])
               for _ in range(rnd.randrange(1, 8))]
        assert model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("dummy", [True, False])
def test_normaliser_equals_library(rule, squeeze, dummy):
    """Longest prefixes of the compiled maps that come with the library, and the alignment of every character."""
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    own = pieces.Normalizer(next(v for k, v in pieces.message(theirs.serialized_model_proto()) if k == 3))
    places = lambda text: np.cumsum([0, *(len(c.encode()) for c in text)])
    for text in mixed_texts(150):
        want, offsets = theirs.normalize(text, with_offsets=True)
        found, origin = own.normalize(text.encode())
        assert found.decode() == want and origin[places(want)].tolist() == places(text)[offsets].tolist(), text


def test_user_defined_pieces_stay_whole():
    normalizer = pieces.Normalizer(b"", user=["<x y>", "<x>"])
    found, origin = normalizer.normalize("a  <x>b".encode())
    assert found.decode() == "▁a▁<x>b" and origin[-5:].tolist() == [3, 4, 5, 6, 7]


def test_pieces_query(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    rows = queries.op12_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = [1, *library.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids) and r["decoded_sha256"] == sha(library.decode(ids))
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pieces_odd_rows(odd, empty, library):  # noqa: F811
    rows = odd.withColumn("ids", F.lit("mine")).select("*", pieces.encode(F.col("text")).alias("found")).collect()
    assert len(rows) == odd.count() and {r["ids"] for r in rows} == {"mine"}
    for r in rows:
        assert np.frombuffer(r["found"]["ids"], "<u4").tolist() == library.encode(r["text"] or "")
    assert empty.select(pieces.decode(pieces.encode(F.col("text"))["ids"])).count() == 0
    assert odd.select(pieces.decode(F.lit(None).cast("binary")).alias("x")).where("x is not null").count() == 0


# --- whitening ------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, whitened string"


def check_whitening(rows, vectors):
    """The contract, worked out with exact integers and a library's eigenvectors."""
    x = np.floor(np.array(list(vectors.values()), float) * 1024).astype(np.int64).astype(object) + 100_000
    n, sums = len(x), x.sum(axis=0)
    a = n * x.T.dot(x) - np.outer(sums, sums)
    roots, basis = np.linalg.eigh((a / (n * n)).astype(float))
    trace = sum(a[i, i] for i in range(len(a)))
    found = {(r["vec_id"], r["component"]): r for r in rows}
    count = max(r["component"] for r in rows)
    assert len(found) == len(rows) == n * count
    for k in range(1, count + 1):
        e, v = roots[-k], basis[:, -k]
        want = (x * n - sums).astype(float) / n @ v / np.sqrt(e)
        got = np.array([found[i, k]["whitened"] for i in vectors])
        assert np.allclose(got, want if want @ got > 0 else -want, atol=1e-7)
        assert all(abs(found[i, k]["explained"] - e * n * n / trace) < 1e-9 for i in vectors)
    for i, row in zip(vectors, x):
        assert found[i, 1]["deviation"] == int(((n * row - sums) ** 2).sum()) and found[i, 1]["n"] == n
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-8


def test_whitening_query(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = queries.op13_whitening(spark, sf_dir).collect()
    assert {r["component"] for r in rows} == set(range(1, 9))
    check_whitening(rows, {r["vec_id"]: r["embedding"] for r in given})


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = {i: [float(np.float32(v)) for v in row] for i, row in enumerate(np.random.default_rng(1).normal(size=(30, 3)))}
    bad = [(100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 0.0, 0.0], "x"), (103, [inf, 0.0, 0.0], None),
           (104, [1.0], "x"), (105, [], "x"), (106, [1e38, 0.0, 0.0], "x")]
    table = spark.createDataFrame([*((i, v, "x") for i, v in good.items()), *bad], VECTORS)
    rows = whitening.components_of(table).collect()
    assert {r["component"] for r in rows} == {1, 2, 3}
    check_whitening(rows, good)
    twice = whitening.components_of(table.unionByName(table)).collect()
    assert len(twice) == 2 * len(rows) and twice[0]["n"] == 60
    assert whitening.components_of(table.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(5)], VECTORS)
    assert whitening.components_of(same).count() == 0
    line = spark.createDataFrame([(None, [float(i), 2.0 * i], "x") for i in range(5)], VECTORS)
    assert [r["component"] for r in whitening.components_of(line).collect()] == [1] * 5


def test_large_entries_stay_exact(spark):
    rows = spark.createDataFrame([(i, [float(v) * 1e12, float(v % 7)], "x") for i, v in enumerate([3, -5, 11, 2])], VECTORS)
    vectors = [r["embedding"] for r in rows.collect()]
    x = np.floor(np.array(vectors, float) * 1024).astype(np.int64).astype(object)
    _, sums, matrix = whitening.scatter(rows.select(F.col("embedding").cast("array<double>")), "embedding", 2)
    s = x.sum(axis=0)
    assert (matrix == 4 * x.T.dot(x) - np.outer(s, s)).all() and sums == [int(v) + 400_000 for v in s]
    found = whitening.components_of(rows).collect()
    assert found and found[0]["identity_error"] < 1e-9


def polynomial(matrix):
    primes = whitening.primes_for(whitening.coefficient_bits(matrix) + 1)
    return whitening.remaindering(primes, [whitening.polynomial_mod((matrix % p).astype(np.int64), p) for p in primes])


@pytest.mark.parametrize("matrix, poly, roots", [
    ([[2, 0], [0, 2]], [4, -4, 1], [2, 2]), ([[1, 1], [1, 1]], [0, -2, 1], [2]), ([[5]], [-5, 1], [5]), ([[0]], [0, 1], []),
    ([[3, 0, 0], [0, 3, 0], [0, 0, 1]], [-9, 15, -7, 1], [3, 3, 1]), ([[0, 0, 0], [0, 4, 2], [0, 2, 1]], [0, 0, -5, 1], [5])])
def test_polynomial_and_ties(matrix, poly, roots):
    matrix = np.array(matrix, object)
    assert polynomial(matrix) == poly
    found = whitening.largest_roots(poly, 8)
    assert [round(float(r), 12) for r in found] == roots
    basis = whitening.components(matrix, found)
    assert np.allclose(basis @ basis.T, np.eye(len(found)))
    assert np.allclose(basis @ matrix.astype(float), basis * np.array(roots, float)[:, None] if roots else basis @ matrix.astype(float))


def test_polynomial_of_close_roots():
    """Eigenvalues that differ in their 12th place are told apart, and their components are exact."""
    big = 10 ** 12
    matrix = np.array([[big, 1, 0], [1, big, 0], [0, 0, big]], object)
    roots = whitening.largest_roots(polynomial(matrix), 3)
    assert [r - big for r in map(round, roots)] == [1, 0, -1]
    half = np.sqrt(0.5)
    assert np.allclose(np.abs(whitening.components(matrix, roots)), [[half, half, 0], [0, 0, 1], [half, half, 0]], atol=1e-15)
