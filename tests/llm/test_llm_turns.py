"""Conversation repair, sentencepiece ids and periodic runs."""

import random
from hashlib import sha256

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from trajspark.llm import conversations, pieces, queries, runs, text

SF = "/root/testdata/sf0.01"
VOCABULARY = "piece_bpe_32k.model"
ODD = [(None, None), (None, "word word"), (1, None), (2, ""), (3, " \n\t"), (4, "▁ ▁▁a b\x00é日😀\n\n"), (5, "x" * 200_000), (6, "same same"), (6, "same same"), (7, " " * 100_000), (8, "a " * 50_000), (9, "\n" * 50_000 + "é " * 3)]


# --- conversations

def turns(spark, rows):
    """Conversations with further columns, named as the operator's own."""
    return spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in rows], "conv_id long, turn long, role string, text string, head string, m int, conv int, audit double")


def repaired(spark, rows):
    return {r[0]: tuple(r[1:]) for r in conversations.repair_digests(turns(spark, rows)).collect()}


def expected(rows):
    return {k: brute.repair(v) for k, v in brute.damage(rows).items()}


def test_conversations_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.QUERIES["op11_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == expected(rows)


def test_odd_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 5, None, "x."), (2, 1, "user", None), (2, 3, "", "y?"), (5, 2**62, "user", "z!"), (5, -2**62, "assistant", "z!"),
            (6, 1, "user", "end. \n\t"), (6, 1, "user", "no end "), (6, 2, "assistant", "w" * 300_000 + ".")]
    rows += [(3, i, ["user", "assistant", "user", "system"][i % 4], f"{i % 50}." if i % 5 else f"{i}") for i in range(700)]  # over many chunks
    rows += [(4, 1, "user", "same.")] * 400
    assert repaired(spark, rows) == expected(rows)
    assert repaired(spark, []) == {}


def test_long_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "tool"]), f"{i}{rng.choice(['.', ''])}") for i in range(3000)] + [(2, 0, "user", "a.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert repaired(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repaired_rows_carry_the_digest(spark):
    rows = [(i // 7, i % 7, ["user", "assistant"][i % 2], f"{i}.") for i in range(0, 140, 1) if i % 11]
    plans = {r.conv_id: r for r in conversations.repair_plans(turns(spark, rows)).collect()}
    out = {}
    for r in conversations.repaired(turns(spark, rows)).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.role, r.text))
    for k, plan in plans.items():
        own = [r[1:] for r in rows if r[0] == k]
        want = brute.repair(own)
        assert plan[1:] == want[:-1]
        assert sha256("\n".join(f"{a}:{b}" for a, b in out.get(k, [])).encode()).hexdigest() == want[-1]
        roles = "".join(a[0] for a, _ in out.get(k, []))
        assert roles.lstrip("s") == "ua" * (len(roles.lstrip("s")) // 2)


def test_search_against_all_states():
    rng = random.Random(1)
    roles = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    for _ in range(1500):
        letters = rng.choice(["suaoxSUAO", "ua", "uax", "uuuax", "suaUAx", "uxS", "o"])
        codes = "".join(rng.choice(letters) for _ in range(rng.randrange(24)))
        want = brute.repair([(i, roles[c.lower()], "" if c == "x" else f"{i}" + "." * c.islower()) for i, c in enumerate(codes)])
        k = rng.randrange(len(codes) + 1)
        for chunks in ([codes], [codes[:k], codes[k:]]):  # chunks put together give what one search gives
            whole = conversations._Conversation()
            for c in chunks:
                found = [{"entry": e, "exit": x, "cost": cost, "audit": a} for e in range(4) for x, cost, a in conversations.repairs(c, e)]
                whole.add({"found": found, "first": None, "low": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0})
            assert whole.row("")[-2:] == want[5:7], codes


def test_bound_of_a_suffix_is_never_above_its_cost():
    rng = random.Random(2)
    for _ in range(500):
        codes = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randrange(1, 12)))
        base, _, pairs = conversations.bounds(codes)
        least = min(cost for _, cost, _ in conversations.repairs(codes, conversations.START))
        assert base[0] + 2 * pairs[0] <= least


# --- sentencepiece

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(VOCABULARY))


def digest(library, doc_id, t):
    ids = library.encode(t or "")
    return doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()


def test_documents_against_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_sentencepiece"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(digest(library, *r) for r in rows)


def test_odd_texts_against_the_library(spark, library):
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, pieces.piece_digests(brute.docs(spark, ODD)).collect()), key=by) == sorted((digest(library, *r) for r in ODD), key=by)
    assert pieces.piece_digests(brute.docs(spark, [])).collect() == []


def test_encode_and_decode_tables(spark, library):
    docs = brute.docs(spark, ODD)
    ids = pieces.encode(docs)
    assert sorted((len(r.ids), r.ids[:50]) for r in ids.collect()) == sorted((len(x), x[:50]) for x in (library.encode(t or "") for _, t in ODD))
    assert sorted(r.text for r in pieces.decode(ids).collect()) == sorted(library.decode(library.encode(t or "")) for _, t in ODD)


def test_random_texts_and_ids_against_the_library(library):
    model, rng = pieces.Pieces(public_tokenizers.path(VOCABULARY)), random.Random(5)
    letters, names = [" ", "▁", "\n", "\t", "a", "b", "t", "h", "e", "é", "ß", "日", "😀", "\x00", "​", "i", "n", "g", "0", "-"], list(model.id)
    for k in range(4000):
        t = "".join(rng.choice(letters if k % 3 else names) for _ in range(rng.randrange(1, 20)))
        if k % 7 == 0:
            t = " " * rng.randrange(40) + t + rng.choice("a=-_#.0 ") * rng.randrange(60)
        assert model.encode(t) == library.encode(t), repr(t)
        ids = [rng.randrange(32000 if rng.random() < 0.4 else 259) for _ in range(6)]
        assert model.decode(ids) == library.decode(ids), ids


def test_compatible_pairs_are_those_that_stay(library):
    model, rng = pieces.Pieces(public_tokenizers.path(VOCABULARY)), random.Random(6)
    ids = [i for i in model.id.values() if model.whole(i)]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids[:300])
        own = model.unit_ids(model.piece[a] + model.piece[b])
        assert (own == [a, b]) == model.compatible(a, b)
    assert all(model.whole(i) for i in model.id.values())


# --- runs

def test_runs_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in rows if len(brute.words(r.text)) < 1500]
    got = {r[0]: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows) and len(some) > 0.9 * len(rows)
    assert all(got[r.doc_id] == brute.run_digest(*r) for r in some)
    assert sum(v[1] > 0 for v in got.values()) > 50


def test_runs_of_odd_texts(spark):
    rows = [*ODD[:7], *ODD[7:8], *ODD[8:10], (10, "a b " * 40 + "c " + "b a b a b a b a x x x x x x"), (None, "a " * 6), (12, "a " * 5), (13, "a b " * 4), (14, "a b " * 3 + "a"), *[(k, " ".join(f"w{i % 7}" for i in range(300))) for k in range(100, 160)]]
    by = lambda r: (r[0] is None, r[0] or 0, r[1], r[7])
    assert sorted(map(tuple, runs.run_digests(brute.docs(spark, rows)).collect()), key=by) == sorted((brute.run_digest(i, t) if len(t or "") < 90_000 or " a" not in t else big(i, t) for i, t in rows), key=by)
    assert runs.run_digests(brute.docs(spark, [])).collect() == []


def big(doc_id, t):
    """One word over and over."""
    n = len(brute.words(t))
    return (doc_id, 1, 0, n, 1, 1000 * n, sha256(f"0,{n},1\n".encode()).hexdigest(), sha256(b"a").hexdigest())


def test_runs_and_collapsed_text(spark):
    got = runs.periodic_runs(brute.docs(spark, [(1, "x y z " * 4 + "end"), (2, "no run here"), (3, None)])).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 12, 3)], [], []]
    assert [r.collapsed for r in got] == ["x y z end", "no run here", ""]


def test_scan_against_all_lags():
    rng = random.Random(3)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 3, 5, 20]), rng.randrange(120)
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 8:
                a, p = rng.randrange(n), rng.randrange(1, 12)
                for i in range(a, min(n, a + rng.randrange(1, 80))):
                    w[i] = w[a + (i - a) % p]
        h = text.mix(np.array(w, np.uint64))
        assert sorted(runs.runs_of(h, np.zeros(n, np.int64)), key=lambda r: (r[0], r[2])) == brute.runs(w)


def test_words_with_one_hash_are_told_apart(monkeypatch):
    docs = [" ".join(f"w{i}" for i in range(30)), "a b " * 6]
    monkeypatch.setattr(text.Block, "word_hashes", lambda self, kind=0, lower=False: np.zeros(len(self.start), np.uint64))
    got = [found for block in text.blocks(pa.array(docs)) for found, _ in runs._rows(block, None)]
    assert got == [[], [(0, 12, 2)]]


def test_long_segments_take_no_square_of_time():
    w = np.arange(200_000) % 3
    assert runs.runs_of(text.mix(w.astype(np.uint64)), np.zeros(len(w), np.int64)) == [(0, 200_000, 3)]
