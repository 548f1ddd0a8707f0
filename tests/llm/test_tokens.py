"""Operators 2, 7 and 9: ids against the libraries, round trips, packing rules."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from topicspark.llm import byte_bpe, packing, pieces, token_files

from .conftest import awkward_rows

RANKS, JSON, WORD = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4")


def odd_texts():
    rng = random.Random(3)
    fixed = ["", "   ", "a  b   c", "\n\n x \n y", "aaaaaaaaaaaaaaaa", "ab" * 300, "=" * 77, "'s 're it's  'S", "x y z", " lead", "trail ", "é́ ü",
             "<|endoftext|>", "a  <|endoftext|> b", "x <|endoftext|>", "<|endoftext|>  y\n<|endoftext|>", "one <|endoftext| > two", "end.<|endoftext|>End <|startoftext|> a"]
    return fixed + ["".join(rng.choice("ab c\n=ea  é't12 \x1c-日") for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_merge_replay_equals_the_library():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    table, _ = byte_bpe._worker_tables(RANKS, P.PATTERN)
    texts = odd_texts()
    assert list(table.texts(texts)) == [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_merge_replay_takes_a_lower_rank_that_a_merge_makes_first():
    singles = {bytes([b]): b for b in range(256)}
    # joining "ab" (rank 300) makes the pair "ab"+"a" whose rank (260) is lower than that of "ab"
    ranks = singles | {b"aba": 260, b"ab": 300, b"abaab": 310}
    replay = byte_bpe.MergeReplay(ranks)
    enc = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for w in ("ab", "aba", "abab", "ababab", "abaab", "aabaabab", "babababa"):
        assert replay.encode([w.encode()])[0].tolist() == enc.encode_ordinary(w), w


@pytest.mark.parametrize("path", [JSON, WORD])
def test_pieces_give_the_ids_of_whole_texts(path):
    encode, texts = library(path), odd_texts()
    assert list(pieces.library_table(path).texts(texts)) == [encode(t).tobytes() for t in texts]


def test_cut_joins_back():
    for t in odd_texts():
        head, parts = pieces.cut(t)
        assert head + "".join(" " + p for p in parts) == t


def test_op2_on_awkward_rows(awkward, nothing):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    got = sorted(map(tuple, byte_bpe.round_trip_report(awkward, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for i, t, *_ in awkward_rows():
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), sha256(ids.tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert byte_bpe.round_trip_report(nothing, RANKS, P.PATTERN).count() == 0


def test_re_pair_expands_to_its_input():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        ids, owner = rng.integers(0, int(rng.integers(1, 5)) + 1, n), np.sort(rng.integers(0, 3, n))
        symbols, who, g = token_files.re_pair(ids, owner, 10, least=2)
        assert (g.expand(symbols) == ids).all()
        assert (np.concatenate([g.expand(symbols[who == k]) for k in range(3)]) == ids).all()
        assert [len(g.expand(np.array([10 + k]))) for k in range(len(g.left))] == g.lengths.tolist()


@pytest.mark.parametrize("least", [2, 4, 16])
def test_re_pair_leaves_no_frequent_pair(least):
    """Zipf-like ids with copied passages and runs of one id; counts of non-overlapping places."""
    rng = np.random.default_rng(least)
    ids = np.minimum(rng.zipf(1.3, 60_000), 20_000)
    ids[30_000:40_000] = ids[:10_000]
    ids[50_000:50_500] = 7
    owner = np.sort(rng.integers(0, 200, len(ids)))
    symbols, who, g = token_files.re_pair(ids, owner, 1 << 17, least=least)
    assert (g.expand(symbols) == ids).all()
    inside = who[:-1] == who[1:]
    pairs, count = np.unique((symbols[:-1] << 32 | symbols[1:])[inside], return_counts=True)
    assert count.max() < least, (count.max(), (count >= least).sum())


def test_re_pair_of_a_full_shard_stays_below_sixty_bytes_an_id():
    import tracemalloc

    ids = np.random.default_rng(5).zipf(1.2, 1 << 20).clip(0, 50_000).astype("<u4")
    owner = np.arange(len(ids)) // 500
    tracemalloc.start()
    try:
        token_files.re_pair(ids, owner, 1 << 17)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 << 20


def test_re_pair_shortens_repeats_and_decodes_one_document():
    ids = [np.tile(np.arange(50, dtype="<u4"), 40).tobytes(), np.arange(7, dtype="<u4").tobytes(), np.tile(np.arange(50, dtype="<u4"), 3).tobytes()]
    row = token_files._shard(0, 0, [3, None, 9], ids, 1 << 17, 0)
    assert len(row["symbols"]) < len(ids[0]) / 4
    assert [x[2] for x in token_files.shard_documents(row)] == ids
    assert list(token_files.shard_documents(row, [2, 1])) == [(9, 150, ids[2]), (None, 7, ids[1])]


def test_op7_on_awkward_rows(spark, awkward, nothing, tmp_path):
    encode = library(JSON)
    rows = sorted(awkward_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    got = token_files.file_report(awkward, JSON).collect()
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [r[0] for r in rows]
    at = 0
    for r in by_start:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted((str(i), zlib.crc32(np.append(encode(t), 0).astype("<u4").tobytes())) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want
    assert token_files.file_report(nothing, JSON).count() == 0


def check_packing(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_op9_on_awkward_rows(awkward, nothing):
    encode = library(WORD)
    rows = packing.packed_report(awkward, WORD).collect()
    assert check_packing(rows, 2048) == -(-sum(r["length"] for r in rows) // 2048)
    want = []
    for i, t, *_ in awkward_rows():
        ids = np.append(encode(t), 0).astype("<u4")
        want += [(i, k, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    assert packing.packed_report(nothing, WORD).count() == 0


def test_packing_many_shards_stays_near_the_bound(spark):
    rng = random.Random(5)
    lengths = [max(1, min(2048, int(rng.lognormvariate(5.5, 1.0)))) for _ in range(4000)]
    rows = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length bigint"), 2048, per_shard=500).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_packing(rows, 2048) <= -(-sum(lengths) // 2048) + 2


def test_local_search_raises_squared_fill():
    rng = random.Random(1)
    lengths = [rng.randint(300, 900) for _ in range(120)]
    bins = [[i] for i in range(120)]
    better = packing.improve([list(b) for b in bins], lengths, 2048)
    fill = lambda bs: sum(sum(lengths[k] for k in b) ** 2 for b in bs)
    assert sorted(k for b in better for k in b) == list(range(120))
    assert fill(better) > fill(bins) and len(better) < 60 and all(sum(lengths[k] for k in b) <= 2048 for b in better)


def test_local_search_tries_every_pair():
    lengths = [1000, 947, 100] + [2] * 64 + [51, 50]  # only 51 + 50 for 100 fills the first
    better = packing.improve([[0, 1, 2], list(range(3, len(lengths)))], lengths, 2048)
    assert sorted(k for b in better for k in b) == list(range(len(lengths)))
    assert max(sum(lengths[k] for k in b) for b in better) == 2048


def test_underfull_sequences_are_dealt_again_until_they_fit_a_shard(spark):
    rng = random.Random(9)
    lengths = [rng.randint(300, 1100) for _ in range(2000)]
    rows = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length bigint"), 2048, per_shard=40).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths)
    assert check_packing(rows, 2048) <= -(-sum(lengths) // 2048) + 28


def test_assembled_sequences_hold_the_ids(awkward):
    parts = packing.pieces(awkward, WORD)
    out = packing.assemble(packing.pack(parts, 2048)).collect()
    assert sum(r["n_tokens"] for r in out) == sum(r["length"] for r in parts.select("length").collect())
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)


def test_bounded_batches_keep_all_rows():
    from topicspark.llm.common import bounded
    b = pa.RecordBatch.from_pydict({"text": ["x" * n for n in range(100)]})
    assert [t for p in bounded([b], "text", 500) for t in p.column("text").to_pylist()] == b.column("text").to_pylist()


def test_small_table_gives_the_same_ids():
    """A worker of operator 9 keeps fewer pieces; what it no longer holds is encoded again."""
    texts = odd_texts() + [f"piece{i} {'q' * (i % 7)}{i * 7919} of many" for i in range(3000)]
    small, encode = pieces.library_table(WORD, 500), library(WORD)
    assert small is not pieces.library_table(WORD)
    for _ in range(2):
        got = [one for at in range(0, len(texts), 400) for one in small.texts(texts[at:at + 400])]
        assert got == [encode(t).tobytes() for t in texts]
        assert len(small.parts) <= 500
    assert packing.KEPT <= 250_000 and packing.TEXT <= 2 << 20
