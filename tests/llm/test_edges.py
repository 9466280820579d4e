"""Every operator over NULLs, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import bpe, decontaminate, embeddings, language, line_dedup, lm, near_copies, quality, simhash, substrings, urls


@pytest.fixture(scope="module")
def codec():
    return bpe.public_codec()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (7, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [(1, "Some words of a text. And more of them, too."), (2, None), (None, "words of nothing at all but these"), (3, ""), (4, "too short")],
        "item_id long, text string",
    )


def test_bpe(cases, codec):
    found = bpe.token_digests(cases, codec)
    assert found.count() == cases.count()
    assert {r.n_tokens for r in found.where("doc_id IN (2, 3)").collect()} == {0}
    round_trip = bpe.decode_ids(bpe.encode_texts(cases, codec), codec)
    texts = sorted((r.doc_id or 0, (r.text or "").encode()) for r in cases.select("doc_id", "text").collect())
    assert sorted((r.doc_id or 0, bytes(r.decoded)) for r in round_trip.collect()) == texts
    assert bpe.token_digests(cases.limit(0), codec).count() == 0


def test_simhash(cases):
    found = {(r.doc_id, r.version): r for r in simhash.near_duplicates(cases).collect()}
    assert simhash.near_duplicates(cases).count() == cases.count()
    # NULL, empty and blank texts have fingerprint zero and link like others.
    zero = [r for r in found.values() if r.fingerprint == 0]
    assert {r.doc_id for r in zero} == {2, 3, 4, None} and {r.component_id for r in zero} == {2}
    same = {r.component_id for r in found.values() if r.doc_id in (1, None) and r.fingerprint != 0}
    assert same == {1}
    assert simhash.near_duplicates(cases.limit(0)).count() == 0
    kept = simhash.one_of_each(cases)
    assert kept.columns == cases.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 8]
    assert simhash.one_of_each(cases.limit(0)).count() == 0


def test_simhash_without_ids(documents):
    kept = simhash.one_of_each(documents((None, "a b c d e"), (None, "a b c d e"), (None, None)))
    assert kept.count() == 2


def test_language(cases):
    model = language.train(cases)
    assert model.names == ["de", "en", "fr"]
    found = language.identify(cases, model)
    assert found.count() == cases.count()
    # The id of 4 is blank, of 6 a run of one letter.
    assert all((r.lang_pred, r.score) == ("und", 0) for r in found.where("doc_id IN (2, 3, 4)").collect())
    assert {r.lang_pred for r in found.where("doc_id IN (1, 7)").collect()} == {"en"}
    kept = language.known_language(cases, model)
    assert kept.columns == cases.columns and kept.where("doc_id IN (2, 3, 4)").count() == 0
    nothing = language.train(cases.limit(0))
    assert nothing.names == [] and {r.lang_pred for r in language.identify(cases, nothing).collect()} == {"und"}
    assert language.identify_learned(cases.limit(0)).count() == 0
    held = language.identify_learned(cases).where("doc_id IS NULL").select("held_out").distinct().collect()
    assert [r.held_out for r in held] == [True]


def test_quality(cases, labels):
    found = quality.score_learned(cases, labels).collect()
    assert len(found) == cases.count() and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == int(r.score >= 0.3) for r in found)
    assert quality.score_learned(cases.limit(0), labels).count() == 0
    assert quality.score_learned(cases, labels.limit(0)).count() == cases.count()


def test_decontamination(cases, benchmark):
    found = decontaminate.leaks(cases, benchmark).collect()
    assert {(r.doc_id, r.item_id, r.coverage) for r in found} == {(1, 1, 1.0), (7, 1, 1.0), (None, 1, 1.0)}
    kept = decontaminate.without_leaks(cases, benchmark)
    assert kept.columns == cases.columns
    assert kept.count() == cases.count() - 4
    assert decontaminate.leaks(cases.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(cases, benchmark.limit(0)).count() == 0


def test_line_dedup(cases):
    found = line_dedup.dedup_lines(cases, min_docs=2, min_chars=10)
    assert found.select("doc.*").columns == cases.columns
    rows = {}
    for r in found.collect():
        rows.setdefault(r.doc.doc_id, []).append(r)
    assert rows[1][0].n_dropped == 1 and rows[1][0].doc.text == ""
    # Rows that repeat a document keep the line both; a NULL id and a NULL text are left alone.
    assert sorted((r.doc.text[:7], r.n_dropped) for r in rows[7]) == [("Some wo", 0), ("Some wo", 0), ("another", 0)]
    assert {r.doc.text for r in rows[None]} == {None, "Some words of a text. And more of them, too."}
    assert line_dedup.dedup_lines(cases.limit(0)).count() == 0


def test_simhash_repeated_id_of_two_components(documents):
    first, second = "one two three four five six seven", "red green blue black white grey pink"
    kept = simhash.one_of_each(documents((7, first), (7, second), (8, first), (9, second)))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, first), (7, second)]


def test_near_copies_against_brute_force(cases, documents, spark):
    import random

    dice = random.Random(3)
    word = lambda: "w%d" % dice.randrange(10**6)
    stock = [word() for _ in range(60)]
    rows = []
    for group in range(12):
        base = [word() for _ in range(dice.choice((5, 6, 9, 40, 150)))] + stock[: dice.randrange(60)]
        for _ in range(6):
            copy = list(base)
            for _ in range(dice.randrange(1 + len(base) // 25)):
                copy[dice.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    sets = {}
    for doc, text in rows:
        own = text.split()
        sets[doc] = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    root = {doc: doc for doc in sets}
    linked = 0
    for a in sets:
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                linked += 1
                low, high = sorted((root[a], root[b]))
                root = {doc: low if own == high else own for doc, own in root.items()}
    assert linked > 50
    docs = documents(*rows)
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == sorted(set(root.values()))
    assert near_copies.one_of_each(cases).columns == cases.columns
    assert sorted(r.doc_id for r in near_copies.one_of_each(cases).collect()) == [1, 2, 5, 6, 7, 8]


def test_substrings(cases):
    found = substrings.without_repeats(cases, words=5).collect()
    # Rows that repeat id and text are one document; both come back. A NULL id takes no part.
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(7, 2), (7, 2)]
    assert substrings.without_repeats(cases.limit(0)).count() == 0


def test_lm(cases):
    found = lm.score_learned(cases).collect()
    assert len(found) == cases.count() and all(r.score < 0 and r.base_score < 0 for r in found)
    assert all(r.held_out for r in found if r.doc_id is None)
    assert lm.score_learned(cases.limit(0)).count() == 0
    # Nothing learned: every word is as likely as the one unknown word.
    empty = lm.score_documents(cases, F.lit(True)).collect()
    assert all(abs(r.base_score) < 1e-6 and r.n_known == 0 and r.train_tokens == 0 for r in empty)


def test_embeddings(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.45]),
        (8, [1.0]), (9, [2.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, []), (11, [float("inf"), 0.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cls", F.lit(1)).withColumn("low", F.lit("x"))
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(frame).collect()]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 10, 11)]
    linked = [(1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (7, 4, 1, False), (None, 4, 1, False), (8, 1, 8, True), (9, 1, 8, False)]
    assert sorted(found, key=str) == sorted(alone + linked, key=str)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme/net/"), (4, "http://A.NET"), (5, "http://a.net/"), (6, "x://example.net/en/x?y#z"), (7, "http://example.net#/en/"),
        (8, "http://notexample.com/de/"), (9, "http://b.example.com/de/1"), (None, "http://org/fr/"), (5, "http://a.net/"), (10, "http://free-bets.org/x"),
        (11, "a://b://net/"), (12, "http://x.orgs/fr/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    found = sorted(((r.page.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()), key=str)
    expected = [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "", None, "allow"), (5, "a.net", "/", "net/", "block"),
        (6, "example.net", "/en/x", "example.net/en/", "allow"), (7, "example.net", "", None, "allow"), (8, "notexample.com", "/de/", None, "allow"),
        (9, "b.example.com", "/de/1", "example.com/de/", "block"), (None, "org", "/fr/", "org/fr/", "allow"), (5, "a.net", "/", "net/", "block"),
        (10, "free-bets.org", "/x", None, "block"), (11, "b:", "//net/", None, "allow"), (12, "x.orgs", "/fr/", None, "allow"),
    ]
    assert found == sorted(expected, key=str)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, cases, benchmark, tmp_path):
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (cases, cases.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "byte_bpe":
                assert out.columns == docs.columns, name
            docs = out
        docs.collect()
