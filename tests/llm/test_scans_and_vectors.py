"""Licence scans, vector codes and clustering against plain versions."""

import hashlib
import math
import random

import brute
import numpy as np
import pytest

from txnflow.llm import geometric_kmeans, licence_scan, vector_codes
from txnflow.llm.text import is_ascii_break, words

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, cluster int, row string, distance bigint"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 11: licences

BASE_COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_base_phrases_equal_brute_force(documents, edges, edge_rows, no_rows):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    for df, known in ((documents, rows), (edges, [(r[0], r[1]) for r in edge_rows])):
        expected = sorted(((i, *brute.licence_phrases(t, licence_scan.BASE)) for i, t in known), key=repr)
        assert rows_of(licence_scan.report(df), *BASE_COLUMNS) == expected
    assert licence_scan.report(no_rows).count() == 0


def test_lines_of_the_documents_get_their_labels(documents):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Released under the MIT License.": "mit",
             "Licensed under the Apache License, Version 2.0.": "apache-2.0", "All rights reserved.": "reserved",
             "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0"}
    found = {r.doc_id: r for r in licence_scan.report(documents).collect()}
    seen = set()
    for row in documents.collect():
        held = [label for line, label in lines.items() if line in (row.text or "")]
        assert found[row.doc_id].labels == ",".join(sorted({x for h in held for x in h.split(",")}))
        assert found[row.doc_id].score == (1.0 if held else pytest.approx(found[row.doc_id].score)) and 0 <= found[row.doc_id].score <= 1
        seen |= set(held)
    assert len(seen) > 2


def test_matches_equal_brute_force_on_random_words():
    rnd = random.Random(7)
    for turn in range(150):
        letters = "abcd"[:rnd.randint(1, 4)]
        templates = [(f"t{k}", " ".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 4, 5, 9, 14])))) for k in range(rnd.randint(1, 5))]
        text = " ".join(rnd.choice(letters + "xy") for _ in range(rnd.randint(0, 40)))
        scanner = licence_scan.Scanner(templates)
        shorts, longs = scanner.matches(words(text, breaks=is_ascii_break)[0])
        assert sorted((s.template, s.start) for s in shorts) == sorted(brute.short_places(text, templates, licence_scan.LEAST_WORDS)), (text, templates)
        found = sorted((k, *m) for k, matches in longs.items() for m in matches)
        assert found == sorted(brute.common_runs(text, templates, licence_scan.LEAST_WORDS)), (text, templates)
        for k, matches in longs.items():
            spans = scanner.chains(k, matches)
            assert max(s.covered for s in spans) == brute.best_chain(matches, licence_scan.MAX_GAP)
            assert all(0 < s.covered <= min(scanner.lengths[k], s.end - s.start) for s in spans)


def test_changed_texts_are_covered_spans(spark):
    body = dict((label, text) for label, text in licence_scan.TEMPLATES if len(text) > 200)["isc"].split()
    changed = [*body[:9], "really", *body[9:15], *body[17:]]  # a word more, two less
    rows = [(1, " ".join(["before"] * 5 + changed + ["after"])), (2, " ".join(body[:12])), (3, " ".join(body).upper() + " x " + " ".join(body)), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = [tuple(r)[:4] for r in licence_scan.licence_spans(df).orderBy("doc_id", "start").collect()]
    n = len(words(" ".join(body), breaks=is_ascii_break)[0])
    assert spans == [(1, "isc", 5, 5 + n - 1), (3, "isc", 0, n), (3, "isc", n + 1, 2 * n + 1)]
    assert {r.doc_id: r.labels for r in licence_scan.report(df.where("text is not null")).collect()} == {1: "isc", 2: "", 3: "isc"}
    assert licence_scan.licence_spans(df, templates=()).count() == 0


# 12 and 13: vectors

@pytest.fixture(scope="module")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@pytest.fixture(scope="module")
def odd_vectors():
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(64)], rnd.choice([0, 1, None])) for i in range(150)]
    rows += [(i, [float(rnd.randint(-1, 1)) for _ in range(64)], None) for i in range(150, 320)]  # ties
    rows += [(i, rows[0][1], 1) for i in range(320, 380)]  # copies
    rows += [(400, None, 1), (401, [None] * 64, 1), (402, [math.nan] * 64, 1), (403, [math.inf] + [0.0] * 63, 1), (404, [], 1), (405, [1.0] * 32, 1),
             (3, rows[3][1], 0), (None, rows[5][1], None), (-7, [0.0] * 64, 2)]
    return [(*r, "c", 9, "r", 1) for r in rows]


def vectors_of(rows):
    return [(r[0], np.array(r[1], np.float32).astype(float), r[2]) for r in rows
            if r[1] is not None and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1])]


def test_codes_equal_brute_force(spark, odd_vectors):
    for rows in (odd_vectors, odd_vectors[:30]):
        df = spark.createDataFrame(rows, VECTORS).repartition(5)
        assert rows_of(vector_codes.compressed(df), "vec_id", "code", "error", "label_error", "codebooks_sha256") == sorted(
            brute.vector_codes(vectors_of(rows)), key=repr)
    assert vector_codes.compressed(df.where("false")).count() == 0
    assert vector_codes.compressed(df.where("vec_id >= 400 and vec_id <= 404")).count() == 0


def test_sums_by_label_are_the_same_salted(spark, odd_vectors, monkeypatch):
    df = spark.createDataFrame(odd_vectors, VECTORS)
    expected = rows_of(vector_codes.compressed(df), "vec_id", "label_error")
    monkeypatch.setattr(vector_codes, "broadcast_if_small", lambda df: df)
    assert rows_of(vector_codes.compressed(df), "vec_id", "label_error") == expected


def test_search_looks_at_few_entries_and_finds_the_first_nearest():
    rnd = np.random.default_rng(2)
    for spread in (2, 300):
        books = vector_codes.Codebooks(rnd.integers(-spread, spread, (64, 16, 4)))
        vectors = rnd.integers(-spread, spread, (300, 64))
        squares = ((vectors.reshape(300, 1, 16, 4) - books.entries) ** 2).sum(3)
        entry, distance = books.nearest(vectors)
        assert (entry == squares.argmin(1)).all() and (distance == squares.min(1)).all()


def test_clusters_equal_brute_force(spark, odd_vectors):
    columns = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for rows in (odd_vectors, odd_vectors[:5]):
        df = spark.createDataFrame(rows, VECTORS).repartition(4)
        assert rows_of(geometric_kmeans.report(df), *columns) == sorted(brute.lloyd(vectors_of(rows)), key=repr)
    assert geometric_kmeans.report(df.where("false")).count() == 0


def test_bounds_spare_comparisons(embeddings):
    log = []
    n = geometric_kmeans.clustered(embeddings, log=log).count()
    assert log[0] == n and sum(log[1:]) < 0.9 * n * (len(log) - 1)


def test_gain_of_a_moved_centroid_is_bounded_below_its_drift():
    rnd = np.random.default_rng(5)
    tighter = 0
    for _ in range(300):
        before = rnd.normal(0, 100, (3, 6))
        after = before + rnd.normal(0, rnd.choice([1, 20]), (3, 6))
        radius = rnd.uniform(1, 120, 3)
        gain = geometric_kmeans.drift_bounds(before, after, radius)
        drift = np.sqrt(((after - before) ** 2).sum(1))
        assert (gain <= drift + 1e-9).all()
        tighter += int((gain < 0.9 * drift).sum())
        way = rnd.normal(0, 1, (400, 6))
        for i in range(3):
            points = before[i] + radius[i] * way / np.sqrt((way ** 2).sum(1))[:, None] * rnd.uniform(0, 1, (400, 1)) ** 0.1
            for j in range(3):
                nearer = np.sqrt(((points - before[j]) ** 2).sum(1)) - np.sqrt(((points - after[j]) ** 2).sum(1))
                assert nearer.max() <= gain[i, j] + 1e-9
    assert tighter > 500


def test_too_large_components_are_named(spark):
    df = spark.createDataFrame([(1, [1e12] * 64, 0)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large"):
        vector_codes.compressed(df).collect()


def test_hash_order_of_the_first_centroids():
    assert hashlib.sha256(b"3:12").hexdigest() == brute.first_hash(12)
