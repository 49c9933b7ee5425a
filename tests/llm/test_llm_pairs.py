"""Near dedup and substring dedup against all-pairs versions and SQL."""

import random

import brute
import harness
import pytest

from trajspark.llm import neardup, queries, substrings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return harness.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    assert harness.compare(queries.QUERIES[name](spark, SF), duck, queries.SQL[name]) == []


def corpus(seed=3):
    """Copies, near copies at all distances of one text, shared passages, short and odd texts, ids out of order."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    base, passage = text(120), text(40)
    rows = [" ".join(base)] * 3
    for edits in [1, 1, 1, 2, 2, 3, 4, 6, 9] * 4:
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(len(t))] = f"e{rng.random()}"
        rows.append(" ".join(t))
    for _ in range(30):
        t = text(rng.randrange(5, 80))
        at = rng.randrange(len(t))
        rows.append(" ".join(t[:at] + passage + t[at:]))
    rows += [" ".join(text(60)) for _ in range(30)]
    rows += [None, "", "  \t\n", "one", "One", "ONE two", "a b c d", "A b\tc\nd", "a b c d e", "é É é É é", "x" * 3000, " ".join(["same"] * 500), " ".join(["same"] * 400), "a\u00a0b c d e f"]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


def test_near_duplicates_against_all_pairs(spark):
    rows = corpus()
    want = brute.components(rows)
    got = neardup.near_duplicates(brute.docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_rounds_is_exact_too(spark):
    rows = corpus(4)
    want = brute.components(rows)
    got = neardup.near_duplicates(brute.docs(spark, rows), rounds=0).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_special_rows(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (None, None), (7, None), (9, long), (8, long + " end"), (6, "q R s")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(brute.docs(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, 6, False), (None, 0, None, True), (7, 0, 7, True), (9, 29996, 8, False), (8, 29997, 8, True), (6, 1, 6, True)], key=str)
    kept = neardup.without_near_duplicates(brute.docs(spark, rows))
    assert kept.columns == brute.docs(spark, rows).columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted([("5", 11), ("6", 5), ("None", 0), ("7", 0), ("8", len(long) + 4)])
    assert neardup.near_duplicates(brute.docs(spark, [])).count() == 0 and neardup.without_near_duplicates(brute.docs(spark, [])).count() == 0


def test_sets_are_counted_as_in_the_definition(spark):
    for text in ["A b C d E f", "a", "", "a b a b a b a b a b"]:
        got = neardup.near_duplicates(brute.docs(spark, [(1, text)])).first()
        assert got.n_shingles == len(brute.shingles(text))


def test_repeats_against_all_windows(spark):
    rows = corpus(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_spans(brute.docs(spark, rows)).collect())
    assert got == sorted(brute.repeats(rows))


def test_repeats_special_rows(spark):
    p = " ".join(f"p{i}" for i in range(13))
    rows = [(3, p), (3, p + " x"), (2, "y\n" + p.replace(" ", "\t\n")), (None, p), (None, None), (9, ""), (8, p[:-3]), (7, "a " * 40), (6, "a " * 20 + "b"), (10, p + " q " + p), (11, "tail " + p)]
    want = sorted(brute.repeats([(2**63 - 1 if i is None else i, t) for i, t in rows]))
    got = sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeated_spans(brute.docs(spark, rows)).collect())
    assert got == want
    spans = {(r.doc_id, r.n_words): [(s.start, s.words, s.source) for s in r.spans] for r in substrings.repeated_spans(brute.docs(spark, rows)).collect()}
    assert spans[(10, 27)] == [(0, 13, 2), (14, 13, 2)]
    left = substrings.without_repeats(brute.docs(spark, rows))
    assert left.columns == brute.docs(spark, rows).columns
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in left.collect()), key=str)
    assert (3, "x", 1) in texts and (11, "tail ", 5) in texts and (10, "q ", 2) in texts and (9, "", 0) in texts and (None, None, None) in texts
    assert (2, rows[2][1], len(rows[2][1])) in texts and not any(t[1] == p for t in texts)
    assert substrings.repeated_spans(brute.docs(spark, [])).count() == 0 and substrings.without_repeats(brute.docs(spark, [])).count() == 0


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    got = substrings.repeated_spans(brute.docs(spark, [(1, long), (2, "x " + long)])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {1: (200_000, 0), 2: (200_001, 200_000)}
