"""The pipeline over the smallest sample, each stage against brute force on its own input."""

import base64
import hashlib
import os
import random
import struct
from itertools import combinations

import numpy as np
import pytest
from test_methods import brute_lines

import corpus_pipeline
from footfall.llm import near_copies
from footfall.llm.frames import stored

SAMPLE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SAMPLE), reason="sample tables not here")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage, as dicts."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    # A near copy, an exact copy under another id, a text without letters and a leak in two pieces.
    first = docs.orderBy("doc_id").first()
    item = spark.read.parquet(f"{SAMPLE}/benchmark.parquet").orderBy("item_id").first().text.split()
    half = len(item) // 2
    odd = [
        (90_001, first.text, "fr", "x", 0),
        (90_002, first.text + " .", "fr", "x", 0),
        (90_003, "12 34 !! 56", "en", "x", 0),
        (90_004, "Und so. " + " ".join(item[half:]) + " dann " + " ".join(item[:half]), "de", "x", 0),
    ]
    docs = stored(docs.unionByName(spark.createDataFrame(odd, docs.schema)), "sample")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SAMPLE), name)
        out[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
    return out


def test_language_id_drops_only_what_is_no_language(stages):
    before, after = stages["language_id"]
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before} - kept == {90_003}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r["doc_id"] in kept)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    assert sorted((r["doc_id"], r["text"]) for r in after) == brute_lines([(r["doc_id"], r["text"]) for r in before], 40, 5)
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    assert set(after[0]) == set(before[0])


def shingle_set(text, width=5):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def keepers(rows):
    """The smallest ids of the groups that pairs of five-word Jaccard similarity 0.8 or more make."""
    sets = {doc: shingle_set(text) for doc, text in rows}
    root = {doc: doc for doc in sets}
    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared * 5 >= (len(sets[a]) + len(sets[b]) - shared) * 4:
            low, high = sorted((root[a], root[b]))
            root = {doc: low if own == high else own for doc, own in root.items()}
    return set(root.values())


def test_simhash_keeps_one_of_each_group(stages):
    before, after = stages["simhash_near_dedup"]
    expected = keepers([(r["doc_id"], r["text"]) for r in before])
    assert {r["doc_id"] for r in after} == expected and 90_001 not in expected
    unchanged = {r["doc_id"]: r for r in before}
    assert all(r == unchanged[r["doc_id"]] for r in after) and len(after) == len(expected)


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_of_every_degree(documents, seed):
    """Edited copies around the similarity, chains of them, a passage that all texts share, and exact copies."""
    rng = random.Random(seed)
    words = [f"w{n}" for n in range(4_000)]
    passage = rng.sample(words, 30)
    rows = []
    for group in range(12):
        text = rng.sample(words, rng.randrange(5, 120))
        for copy in range(8):
            own = list(text)
            for _ in range(rng.randrange(0, 3 + len(own) // 30)):
                place = rng.randrange(len(own))
                own[place : place + rng.randrange(2)] = [rng.choice(words)]
            if rng.random() < 0.3:
                own = passage + own
            rows.append((len(rows) + 1, " ".join(own)))
            if rng.random() < 0.3:
                text = own[:]
    rows += [(len(rows) + n, " ".join(passage)) for n in (1, 2)]
    rng.shuffle(rows)
    kept = near_copies.one_of_each(documents(*rows).repartition(3))
    assert {r.doc_id for r in kept.collect()} == keepers(rows)


def test_near_copies_without_ids(documents):
    """A group in which no row has an id keeps one row too, not one of each of its shingle sets."""
    text = " ".join(f"w{n}" for n in range(60))
    copies = [text, text + " more", text + " even more", text]
    rows = [(None, copy) for copy in copies] + [(None, "something else that is alone here"), (None, None), (None, " ")]
    rows += [(None, "red " + text[::-1]), (4, "red " + text[::-1] + " green"), (3, text[::-1])]
    kept = [(r.doc_id, r.text) for r in near_copies.one_of_each(documents(*rows)).collect()]
    assert sorted(doc for doc, _ in kept if doc is not None) == [3]
    without = [t for doc, t in kept if doc is None]
    assert len(without) == 3 and len([t for t in without if t in copies]) == 1 and "something else that is alone here" in without


def test_near_copies_go_through_simhash(documents, spark, monkeypatch):
    """The first pairs compared are those of near SimHash fingerprints of five-word shingles, which link the copies."""
    rng = random.Random(8)
    rows = []
    for group in range(10):
        text = [f"w{rng.randrange(10**6)}" for _ in range(600)]
        rows += [(3 * group + n, " ".join(text[: len(text) - n])) for n in range(3)]
    asked, similar = [], near_copies._similar

    def spied(pairs, *rest):
        asked.append({(r.a, r.b) for r in pairs.collect()})
        return similar(pairs, *rest)

    monkeypatch.setattr(near_copies, "_similar", spied)
    kept = corpus_pipeline.distinct_documents(spark, documents(*rows), "")
    assert {r.doc_id for r in kept.collect()} == keepers(rows) == set(range(0, 30, 3))
    prints = {}
    for doc, text in rows:
        found = near_copies.shingles(text.encode())
        ones = [sum(int(h) >> bit & 1 for h in found) for bit in range(64)]
        node = int(np.array([near_copies._set_hash(found)], np.uint64).view(np.int64)[0])
        prints[node] = sum(1 << bit for bit in range(64) if ones[bit] * 2 > len(found)), doc // 3
    near = {(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a][0] ^ prints[b][0]).bit_count() <= near_copies.SIMHASH_BITS}
    assert asked[0] and asked[0] <= near and {prints[a][1] for a, _ in asked[0]} == {prints[a][1] for a, _ in near}
    assert {n for pair in near for n in pair} == {n for pair in asked[0] for n in pair}


def test_no_task_of_the_sets_runs_python_twice(documents, monkeypatch):
    plans = []

    def spied(frame, purpose):
        if purpose == "near-sets":
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return stored(frame, purpose)

    monkeypatch.setattr(near_copies, "stored", spied)
    text = "one two three four five six seven eight nine ten"
    assert near_copies.one_of_each(documents((1, text), (2, text + " "), (3, text + " ten ten"))).count() > 0
    assert plans
    for plan in plans:
        assert "Exchange hashpartitioning" in plan[plan.index("MapInArrow") : plan.index("ArrowEvalPython")]


def test_the_limit_by_prefixes_is_one():
    rng = np.random.default_rng(0)
    for trial in range(300):
        universe = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
        common = np.sort(rng.choice(universe, rng.integers(0, 60), replace=False))
        a, b = (np.sort(rng.choice(universe, rng.integers(1, 250), replace=False)) for _ in "ab")
        limit = near_copies.most_shared(*near_copies.prefix(a, common), len(a), *near_copies.prefix(b, common), len(b))
        assert limit >= len(np.intersect1d(a, b))
    same = near_copies.prefix(a, common)
    assert near_copies.most_shared(*same, len(a), *same, len(a)) == len(a)


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    for size in (0, 1, 30, 400, 5_000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for others in (0, 1, 9, 200):
            b = np.unique(np.concatenate([a[others:], rng.integers(0, 2**64, others, dtype=np.uint64)]))
            bits = sum(int(x).bit_count() for x in (near_copies.sketch(a) ^ near_copies.sketch(b)).view(np.uint64))
            differing = len(np.setxor1d(a, b))
            assert bits <= differing and (differing - bits) % 2 == 0


def test_decontamination(stages, spark):
    def words(text):
        return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()

    items = [words(r.text) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
    before, after = stages["benchmark_decontamination"]
    clean = set()
    for row in before:
        own = words(row["text"])
        runs = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        hit = [[i for i in range(len(t) - 4) if tuple(t[i : i + 5]) in runs] for t in items]
        if all(len({p for i in found for p in range(i, i + 5)}) < 0.5 * len(t) for found, t in zip(hit, items)):
            clean.add(row["doc_id"])
    assert {r["doc_id"] for r in after} == clean and 90_004 not in clean


def test_tokens(stages):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as public

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages["byte_bpe"]
    expected = []
    for row in before:
        ids = own.encode_ordinary(row["text"])
        packed = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        expected.append((row["doc_id"], len(ids), packed, hashlib.sha256(row["text"].encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after) == sorted(expected)


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SAMPLE), name)
    assert sorted(corpus_pipeline.run(spark, SAMPLE).collect()) == sorted(docs.collect())
