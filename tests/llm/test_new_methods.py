"""Toxicity, vector codes and whitening against brute force, and on odd input."""

import os
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.llm import registry, toxicity, vector_codes, vectors, whitening

SAMPLE = "/root/testdata/sf0.001"
sampled = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="sample tables not here")
EMBEDDINGS = "vec_id long, embedding array<float>, label int, component string, code string, n string"


@pytest.fixture(scope="module")
def embeddings(spark):
    def make(*rows):
        return spark.createDataFrame([(*row, *[None] * (3 - len(row)), "clash", "clash", "clash") for row in rows], EMBEDDINGS)

    return make


def cloud(seed, rows, width, groups=5, spread=0.05):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(groups, width))[rng.integers(0, groups, rows)] + spread * rng.normal(size=(rows, width))) / 4


# Toxicity


def brute_buckets(text):
    text = toxicity._GAP + " ".join((text or "").lower().split()) + toxicity._GAP
    out = set()
    for order in toxicity.ORDERS:
        for at in range(len(text) - order + 1):
            value = 0
            for character in text[at : at + order]:
                value = (value * int(toxicity._BASE) + ord(character)) % 2**64
            out.add((value + order) * int(toxicity._SPREAD) % 2**64 >> 64 - toxicity.BUCKET_BITS)
    return out


@pytest.mark.parametrize("piece", [16, 1 << 18])
def test_toxicity_buckets(monkeypatch, piece):
    """Places in pieces of any size give the n-grams of the whole text, and of no two texts together."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    texts = ["Some  words\nof a TEXT, and more of them", None, "", "ÉTÉ \U0001f642 ok", "x"]
    found = toxicity.features(texts, np.arange(1 << toxicity.BUCKET_BITS))
    assert [set(f.tolist()) for f in found] == [brute_buckets(t) for t in texts]
    counts, seen = np.zeros((2, 1 << toxicity.BUCKET_BITS), np.int32), np.zeros(1 << toxicity.BUCKET_BITS, np.int64)
    toxicity.bucket_counts(texts, [1, 0, 0, 1, 0], counts, seen)
    for kind, own in ((1, (0, 3)), (0, (1, 2, 4))):
        expected = np.zeros(1 << toxicity.BUCKET_BITS, int)
        for i in own:
            expected[list(brute_buckets(texts[i]))] += 1
        assert (counts[kind] == expected).all()


def test_toxicity_ratios_scale_the_features():
    """Two features that part the classes equally well weigh more the larger their ratio."""
    ratio = toxicity.ratios(np.array([40, 8]), np.array([1, 1]), 50, 50)
    assert ratio == pytest.approx([np.log(41 / 52) - np.log(2 / 52), np.log(9 / 52) - np.log(2 / 52)])
    rows = [np.array([0, 1])] * 20 + [np.array([], int)] * 20
    model = toxicity.fit(rows, np.repeat([1.0, 0.0], 20), ratio, np.zeros(4, np.int16))
    assert model.weights[0] > model.weights[1] > 0
    assert (model.scores(rows) > 0.5).tolist() == [True] * 20 + [False] * 20


def insults(documents, n=120):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[int(rng.integers(40))] = "Nitwit"
        rows.append((i, " ".join(words)))
    return documents(*rows)


def test_toxicity_finds_the_marked_word(spark, documents):
    docs = insults(documents)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    found = toxicity.score_learned(docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in found)
    assert {r.held_out for r in found} == {True, False}
    # The labels of held-out rows teach nothing.
    flipped = labels.withColumn("toxic", F.when(toxicity.fold_bucket("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(toxicity.score_learned(docs, flipped).collect()) == sorted(found)


def test_toxicity_sample_is_bounded_by_rows(spark, documents):
    """One id on many rows, and one row many times, take no more places than the bound."""
    docs = documents(*[(1, f"text {i}") for i in range(400)], *[(2, "the same text")] * 400, *[(i, f"row {i}") for i in range(3, 60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    sizes = []
    original = toxicity.fit
    try:
        toxicity.fit = lambda rows, *rest: sizes.append(len(rows)) or original(rows, *rest)
        toxicity.train(docs, labels, rows=25)
        toxicity.train(docs.where("doc_id <> 1"), labels, rows=1_000)
    finally:
        toxicity.fit = original
    assert sizes == [25, 58]


def test_toxicity_on_odd_input(spark, cases):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (7, 1), (7, 0), (5, 0), (99, 1)], "doc_id long, toxic int")
    found = toxicity.score_learned(cases, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == cases.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    assert toxicity.score_learned(cases.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_learned(cases, labels.limit(0)).collect()} == {0.5}
    named = toxicity.score(cases.select(F.col("doc_id").cast("string").alias("name"), "text"), toxicity.train(cases, labels), "name")
    assert named.schema["doc_id"].dataType.typeName() == "string" and named.count() == len(rows)


@sampled
def test_toxicity_held_out_accuracy(spark):
    sf_dir = SAMPLE.replace("sf0.001", "sf0.1")
    found = registry.op11_toxicity(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    cells = {(r.toxic, r.predicted): r["count"] for r in found.where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert cells[1, 1] / (cells[1, 1] + cells[1, 0]) > 0.88
    assert cells[0, 0] / (cells[0, 0] + cells.get((0, 1), 0)) > 0.99


# Vector codes


def brute_codes(vectors_, parts=8, entries=16, rounds=6):
    points = np.floor(4096 * np.asarray(vectors_, np.float32).astype(np.float64)).astype(np.int64).reshape(len(vectors_), parts, -1)
    books = points[:entries].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        far = ((points[:, :, None] - books[None]) ** 2).sum(axis=-1)
        codes = far.argmin(axis=-1)
        if step < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = points[codes[:, p] == e, p]
                    if len(own):
                        books[p, e] = own.sum(axis=0) // len(own)
    return codes, far.min(axis=-1).sum(axis=-1), books


@pytest.mark.parametrize("seed,rows,spread", [(0, 300, 0.05), (1, 300, 1.0), (2, 9, 0.1), (3, 200, 0.0)])
def test_codes_against_brute_force(spark, embeddings, monkeypatch, seed, rows, spread):
    own = cloud(seed, rows, 32, spread=spread)
    table = embeddings(*[(i, own[i].tolist(), i % 3) for i in np.random.default_rng(seed).permutation(rows).tolist()]).repartition(3)
    found, books = vector_codes.compress(table)
    codes, error, expected = brute_codes(own)
    assert (books == expected).all()
    by_label = [int(error[np.arange(rows) % 3 == k].sum()) for k in range(3)]
    assert [(r.vec_id, list(r.code), r.error, r.label_error) for r in found.orderBy("vec_id").collect()] == [
        (i, codes[i].tolist(), error[i], by_label[i % 3]) for i in range(rows)
    ]


@pytest.mark.parametrize("kind", ["cloud", "grid", "line", "one"])
def test_cover_tree(kind):
    rng = np.random.default_rng(5)
    rows = {
        "cloud": (4096 * cloud(5, 700, 6, spread=0.3)).astype(np.int64),
        "grid": rng.integers(-3, 4, (900, 4)),
        "line": np.arange(500)[:, None] * np.array([[3, -1]]),
        "one": np.full((50, 3), 7),
    }[kind]
    tree = vector_codes.cover_tree(rows)
    assert (tree.points[tree.place] == rows).all() and tree.weights.sum() == len(rows)
    far = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    for i in range(len(tree.centre)):
        own = tree.points[tree.low[i] : tree.high[i]]
        assert far(own, tree.points[tree.centre[i]]).max() <= tree.radius[i] + 1e-9
        children = range(tree.first[i], tree.last[i])
        if children:
            assert tree.centre[tree.first[i]] == tree.centre[i]
            assert [tree.low[c] for c in children] == [tree.low[i], *(tree.high[c] for c in children)][: len(children)]
            assert all(tree.radius[c] <= tree.radius[i] / 2 + 1e-9 for c in children)
            centres = tree.points[tree.centre[list(children)]]
            apart = far(centres[:, None], centres[None])[np.triu_indices(len(centres), 1)]
            assert (apart > tree.radius[i] / 2 - 1e-9).all()
    (again,) = vector_codes.unpack(vector_codes.pack([tree]))
    assert all((getattr(again, f) == getattr(tree, f)).all() for f in tree.__dict__)
    # Entries on the points make ties; whole subtrees and exact comparisons give the same counts and sums.
    book = np.concatenate([rows[rng.integers(0, len(rows), 12)], rows[:1], rows[:1] + 1])
    codes, totals = vector_codes.assign(tree, book)
    expected = ((rows[:, None] - book[None]) ** 2).sum(axis=-1).argmin(axis=1)
    assert (codes[tree.place] == expected).all()
    for e in range(len(book)):
        assert totals[e].tolist() == [(expected == e).sum(), *rows[expected == e].sum(axis=0)]


def test_cover_tree_assigns_whole_subtrees(monkeypatch):
    """Far groups are told apart at inner nodes: few points are compared one by one."""
    rows = np.concatenate([np.random.default_rng(i).integers(0, 50, (400, 4)) + 100_000 * i for i in range(4)])
    tree, compared = vector_codes.cover_tree(rows), []
    original = vector_codes._squared
    monkeypatch.setattr(vector_codes, "_squared", lambda a, b: compared.append(a.shape[0]) or original(a, b))
    codes, _ = vector_codes.assign(tree, rows[[0, 400, 800, 1200]])
    assert (codes[tree.place] == np.repeat(np.arange(4), 400)).all() and sum(compared) < 40


ODD = [
    (1, [0.5, -0.25] * 8, 1),
    (2, None, 1),
    (3, [0.5, None] * 8, 1),
    (4, [float("nan")] * 16, 2),
    (5, [float("-inf")] * 16, None),
    (6, [0.0] * 16, None),
    (6, [0.0] * 16, None),
    (6, [1.0, 0.5] * 8, None),
    (None, [0.25] * 16, 2),
    (7, [0.5, -0.25] * 3, 2),
    (8, [], 2),
]


def test_codes_on_odd_input(embeddings):
    found, books = vector_codes.compress(embeddings(*ODD))
    rows = found.collect()
    assert sorted((r.vec_id or 0) for r in rows) == [0, 1, 6, 6, 6, 7, 8]
    assert {r.error for r in rows} == {0} and {r.label_error for r in rows} == {0}
    assert books.shape == (8, 7, 2)
    assert books[0].tolist() == [[2048, -1024], [0, 0], [0, 0], [4096, 2048], [2048, -1024], [0, 0], [1024, 1024]]
    empty, books = vector_codes.compress(embeddings(*ODD).limit(0))
    assert empty.count() == 0 and vector_codes.books_digest(books) == sha256(b"").hexdigest()
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(embeddings((1, [1e30], 1)))


@sampled
def test_codes_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SAMPLE}/embeddings.parquet'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    expected = connection.execute(registry.oracle_sql()["op12_vector_codes"]).df()[names]
    found = registry.op12_vector_codes(spark, SAMPLE).toPandas()[names]
    assert sorted(map(tuple, found.values.tolist())) == sorted(map(tuple, expected.values.tolist()))


# Whitening


def brute_white(own, size=8):
    x = np.floor(1024 * np.asarray(own, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, total)) for row in x]
    return centred @ axes[:, :size] / np.sqrt(values[:size]), values[:size] / values.sum(), deviation


@pytest.mark.parametrize("seed,rows,width", [(0, 400, 16), (1, 5_000, 9), (2, 40, 3)])
def test_whitening_against_brute_force(embeddings, seed, rows, width):
    own = cloud(seed, rows, width, spread=0.3)
    found = whitening.whiten(embeddings(*[(i, own[i].tolist()) for i in range(rows)]).repartition(3)).orderBy("vec_id", "component").toPandas()
    size = min(8, width)
    white, explained, deviation = brute_white(own)
    mine = found.whitened.to_numpy().reshape(rows, size)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert found.component.tolist() == [*range(1, size + 1)] * rows and set(found.n) == {rows}
    assert found.explained.to_numpy().reshape(rows, size)[0] == pytest.approx(explained, rel=1e-9)
    assert [int(d) for d in found.deviation[::size]] == deviation
    assert found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-12


def matrix_of(values, seed=0):
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0].astype(np.longdouble)
    for _ in range(3):  # orthonormal in extended precision
        basis = basis @ (1.5 * np.eye(len(values), dtype=np.longdouble) - 0.5 * basis.T @ basis)
    matrix = (basis * np.array(values, np.longdouble)) @ basis.T
    return (matrix + matrix.T) / 2, basis[:, np.argsort(-np.array(values), kind="stable")]


SPECTRA = {
    "apart": ([float(i) for i in range(1, 33)], 1e-15),
    "close": ([1 + 1e-6 * i for i in range(16)] + [2.0 + i for i in range(16)], 1e-11),
    "clustered beyond float32": ([1 + 1e-10 * i for i in range(16)] + [3 + 1e-9 * i for i in range(16)], 1e-7),
    "graded": ([4.0**-i for i in range(24)], 1e-4),
}


@pytest.mark.parametrize("kind", SPECTRA)
def test_eigenvectors(kind):
    values, tolerance = SPECTRA[kind]
    matrix, basis = matrix_of(values)
    found, vectors_ = whitening.eigenvectors(matrix)
    assert found == pytest.approx(sorted(map(float, values), reverse=True), rel=1e-15, abs=1e-16)
    off = vectors_ * np.sign((vectors_ * basis).sum(axis=0)) - basis
    assert np.sqrt((off**2).sum(axis=0)).max() < tolerance
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max() < 2e-15
    assert np.abs(matrix @ vectors_ - vectors_ * found).max() < 1e-14


def test_eigenvectors_of_equal_eigenvalues():
    for values in ([1.0] * 5, [0.0] * 4 + [2.0] * 3, [7.0, 7, 7, 1, 0, 0]):
        matrix, _ = matrix_of(values)
        found, vectors_ = whitening.eigenvectors(matrix)
        assert found == pytest.approx(sorted(values, reverse=True), abs=1e-15)
        assert np.abs(vectors_.T @ vectors_ - np.eye(len(values))).max() < 2e-15
    assert whitening.eigenvectors(np.zeros((3, 3), np.longdouble))[0].tolist() == [0, 0, 0]


def test_covariance_is_exact_far_from_zero():
    rows = np.random.default_rng(0).integers(0, 3, (1_000, 4)) + 10**6
    near = rows.sum(axis=0) // 1_000
    centred = (rows - near).T @ (rows - near)
    found = whitening.covariance(1_000, rows.sum(axis=0), centred.astype(object))
    n, sums = 1_000, [int(s) for s in rows.sum(axis=0)]
    for i in range(4):
        for j in range(4):
            exact = Fraction(n * int((rows[:, i] * rows[:, j]).sum()) - sums[i] * sums[j], n * n)
            assert float(found[i, j]) == float(exact)


def test_whitening_on_odd_input(embeddings):
    found = whitening.whiten(embeddings(*ODD)).collect()
    assert sorted({(r.vec_id or 0) for r in found}) == [0, 1, 6, 7, 8] and len(found) == 7 * 8
    assert {r.n for r in found} == {7}
    some = [r for r in found if r.whitened is not None]
    assert {r.component for r in some} == {1, 2, 3, 4} or len({r.component for r in some}) < 8
    assert all(r.identity_error < 1e-9 for r in found)
    assert whitening.whiten(embeddings(*ODD).limit(0)).count() == 0
    alone = whitening.whiten(embeddings((1, [0.5, 0.25]))).collect()
    assert [(r.component, r.whitened, r.explained, int(r.deviation), r.identity_error) for r in alone] == [(1, None, 0.0, 0, 0.0), (2, None, 0.0, 0, 0.0)]


def test_deviation_beyond_a_long():
    model = whitening.Whitening(10**7, np.array([10**12, 10**12 + 5]), np.eye(2), np.ones(2), 2.0)
    own = np.array([[1_100_000, 100], [100_000, 100_000]])
    expected = [sum((10**7 * int(a) - s) ** 2 for a, s in zip(row, (10**12, 10**12 + 5))) for row in own]
    assert [int(d) for d in whitening._deviations(own, model).to_pylist()] == expected and expected[0] > 2**63


def test_pieces():
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(range(a, b))], names=["x"]) for a, b in ((0, 5), (5, 5), (5, 6), (6, 17))]
    out = list(vectors.pieces(iter(batches), 4))
    assert [b.num_rows for b in out] == [4, 4, 4, 4, 1] and [x for b in out for x in b.column("x").to_pylist()] == [*range(17)]
