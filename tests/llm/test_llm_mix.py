"""Mixing, packing and the pipeline."""

from collections import defaultdict
from zlib import crc32

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from trajspark.llm import mixing, packing, queries

SF = "/root/testdata/sf0.001"
ODD = [(None, None, None, None), (None, "a b", None, None), (1, None, "en", "b"), (2, "", "en", "b"), (3, "one two three", "en", "b"), (4, "w " * 50_000, "en", "c"), (5, "x y", "en", "a"), (5, "x y", "en", "a"), (6, "z", "en", "É")]


def test_targets_by_resharing(spark):
    for sizes in [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, None: 5, "c": 7, "d": 0, "É": 900}, {"x": 3}, {None: 10, "a": 0}]:
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9) for s in want)


def test_taken_words(spark):
    rows = ODD + [(100 + i, "t " * (1 + i * i % 37), "en", "abc"[i % 3]) for i in range(300)]
    df = brute.docs(spark, rows)
    got = mixing.mix_sizes(df).collect()
    again = mixing.mix_sizes(df.repartition(5)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    sizes, taken = defaultdict(int), defaultdict(list)
    for _, t, _, s in rows:
        sizes[s] += len(brute.words(t))
    by = {(r[0], len(brute.words(r[1]))): r[3] for r in rows}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[by[(r.doc_id, r.size)]].append(r)
    want = brute.targets(dict(sizes))
    for s, some in taken.items():
        assert some[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in some) - want[s]) <= 2 and some[0].source_size == sizes[s]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    count = defaultdict(int)
    for r in mixed.collect():
        count[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    expected = defaultdict(int)
    for r in got:
        expected[r.doc_id] += r.taken
    assert {k: v for k, v in expected.items() if v} == dict(count)
    assert mixing.mix_sizes(brute.docs(spark, [])).count() == 0 and mixing.mixed_documents(brute.docs(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix_sizes(brute.docs(spark, [(1, None)])).collect()] == [0]


def test_long_documents_are_repeated_less_often(spark):
    rows = [(i, "w " * (1 if i % 2 else 64), "en", "a") for i in range(2000)]
    got = mixing.mix_sizes(brute.docs(spark, rows)).collect()
    share = [np.mean([r.taken > r.size for r in got if r.size == n]) for n in (1, 64)]
    assert share[0] > share[1] and abs(sum(r.taken for r in got) - got[0].target) <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.sampled_from([16, 32, 64]))
def test_plan_covers_every_remainder(lengths, size):
    counts = defaultdict(int)
    for n in lengths:
        counts[n % size] += 1
    rows, sequences = packing.plan_remainders(dict(counts), size)
    covered, bins = defaultdict(list), defaultdict(list)
    for n, lo, hi, start, length, first, offset in rows:
        for r in range(lo, hi):
            covered[(n, r)].append((start, length))
            bins[first + r - lo].append((offset, length))
    for n, c in counts.items():
        for r in range(c if n else 0):
            at = 0
            for start, length in sorted(covered[(n, r)]):
                assert start == at and length > 0
                at += length
            assert at == n
    sizes = []
    for b in range(sequences):
        at = 0
        for offset, length in sorted(bins[b]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == size or s & (s - 1) == 0 for s in sizes) and len(bins) == sequences


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_best_fill_is_the_best(counts, space):
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= space}
    used = packing.best_fill(space, counts)
    assert sum(n * c for n, c in used.items()) == max(reach) and all(c <= counts[n] for n, c in used.items())


def check_pieces(pieces, texts, size=2048):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, bins, n = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in pieces:
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in texts:
        n[i] += 1
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        if n[i] == 1:
            at = 0
            for r in sorted(by[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc32(ids[at:at + r.length].tobytes())
                at += r.length
            assert at == len(ids)
        else:
            assert all(r.ids_crc32 == crc32(ids[r.start:r.start + r.length].tobytes()) for r in by[i] if r.doc_tokens == len(ids))
    sizes = []
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(s == size or s & (s - 1) == 0 and s < size for s in sizes)
    return sizes


def test_pack_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sizes = check_pieces(queries.QUERIES["op6_min_slack_packing"](spark, SF).collect(), docs)
    assert sum(s < 2048 for s in sizes) <= 11


def test_pack_special_rows(spark):
    rows = [(i, t, "en", "s") for i, t in [(None, None), (1, None), (2, ""), (3, "a<|endoftext|>b"), (4, "word " * 5000), (4, "word " * 5000), (5, "é𝒳\x00"), (6, " \n" * 300)]]
    pieces = packing.pack(brute.docs(spark, rows)).collect()
    check_pieces(pieces, [(r[0], r[1]) for r in rows])
    assert sum(r.length for r in pieces if r.doc_id == 4) == 2 * next(r.doc_tokens for r in pieces if r.doc_id == 4)
    assert sum(r.length for r in packing.pack(brute.docs(spark, rows), size=64).collect()) == sum(r.length for r in pieces)
    assert packing.pack(brute.docs(spark, [])).count() == 0


# --- the pipeline

def test_stages_in_order_and_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "source_mix", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_against_brute_force(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"clean{i} " + " ".join(f"w{(i * 7 + k * 13) % 997}" for k in range(60)), "en", f"s{i % 2}") for i in range(40)]
    rows += [(100 + i, f"some vile words u{i}", "en", "s0") for i in range(30)] + [(200, rows[3][1], "en", "s1"), (201, rows[4][1] + " extra", "en", "s1"), (202, "lead a " + passage, "en", "s0"), (203, " ".join(f"q{i}" for i in range(40)) + " " + passage, "en", "s1")]
    documents = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int("vile" in r[1])) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == documents.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    clean = [(r[0], r[1]) for r in rows if "vile" not in r[1]]
    assert sorted(r.doc_id for r in seen["toxicity"]) == sorted(i for i, _ in clean)
    one = sorted(i for i, (_, c) in brute.components(clean).items() if i == c)
    assert sorted(r.doc_id for r in seen["near_dedup"]) == one and 200 not in one and 201 not in one
    want = {i: n - gone for i, n, gone, _ in brute.repeats([(i, t) for i, t in clean if i in one])}
    assert {r.doc_id: len(brute.words(r.text)) for r in seen["substring_dedup"]} == want and want[203] == 40
    sizes = defaultdict(int)
    for r in seen["substring_dedup"]:
        sizes[r.source] += len(brute.words(r.text))
    mixed = defaultdict(int)
    for r in seen["source_mix"]:
        mixed[r.source] += len(brute.words(r.text))
    assert all(abs(mixed[s] - t) <= 1 for s, t in brute.targets(dict(sizes)).items())
    check_pieces(seen["packing"], [(r.doc_id, r.text) for r in seen["source_mix"]])
    assert sorted((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.start, r.length) for r in seen["packing"])


def test_pipeline_of_odd_and_no_documents(spark, tmp_path):
    schema = "doc_id long, quality int, toxic int"
    for k, rows in enumerate([[], ODD]):
        folder = tmp_path / str(k)
        brute.docs(spark, rows).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], schema).write.parquet(str(folder / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.count() >= len(rows) / 3


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 5_000_000, "a" + "\t" * 1_000_000 + "b", " " * 999_999, "x" * 1_000_000, "!?" * 300_000, "7" * 20_000, "q" * 19_999 + " " + "q" * 19_999], ids=["blanks", "line feeds", "tabs", "no-break", "word", "marks", "digits", "below"])
def test_ids_of_very_long_runs(run):
    import public_tokenizers
    from tokenizers import Tokenizer
    from trajspark.llm import packing
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(run, add_special_tokens=False).ids
    assert packing.token_ids(run, "byte_bpe_50k.tiktoken").tolist() == [*want, 1]
