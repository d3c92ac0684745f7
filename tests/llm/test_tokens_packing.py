import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import packing, token_files
from scriptorium.llm.tokens import PieceEncoder


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ODD = st.text(st.sampled_from(list("abcÉßé '\n\t.1,2!-é ́🙂Σς ")), max_size=60)


@pytest.mark.parametrize("path", [packing.VOCABULARY, token_files.VOCABULARY])
def test_pieces_give_the_ids_of_the_whole_text(path):
    own, want = PieceEncoder(path), plain(path)

    @settings(max_examples=300, deadline=None)
    @given(ODD)
    def check(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want(text)

    check()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=700))
def test_block_round_trip(ids):
    ids = np.array(ids, np.uint32)
    assert (token_files.decode_block(*token_files.encode_block(ids), len(ids)) == ids).all()


def test_block_with_ranks_over_two_bytes():
    ids = np.arange(70_000, dtype=np.uint32)
    table, control, data = token_files.encode_block(ids)
    assert (token_files.decode_block(table, control, data, len(ids)) == ids).all()
    assert len(data) == 256 + 2 * (65536 - 256) + 3 * (70_000 - 65536)


def test_files_read_back(spark, odd_docs):
    want = plain(token_files.VOCABULARY)
    got = token_files.round_trip(odd_docs, block_ids=1000).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at, expected = 0, []
    for r in rows:
        ids = want(r.text) + [0]
        expected.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    assert token_files.round_trip(odd_docs.limit(0)).count() == 0


def test_packing(spark, odd_docs):
    want = plain(packing.VOCABULARY)
    made = packing.pack(odd_docs).collect()
    assert sum(r.length for r in made) == sum(len(want(r.text)) + 1 for r in odd_docs.collect())
    docs, bins = defaultdict(list), defaultdict(list)
    for r in made:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    for r in odd_docs.dropDuplicates(["doc_id"]).collect():
        ids = np.array(want(r.text) + [1], "<u4").tobytes()
        own = {(x.start, x.ids) for x in docs[r.doc_id]}
        assert b"".join(x for _, x in sorted(own)) == ids
        assert {x.doc_tokens for x in docs[r.doc_id]} == {len(ids) // 4}
    assert packing.pack(odd_docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=80))
def test_bins_hold_what_their_class_says(lengths):
    bins, out = packing.Bins(), []
    for n in lengths:
        assert sum(parts := packing.pieces_of(n)) == n and max(parts) <= 2048
        for x in parts:
            out += bins.add((), x)
    out += bins.rest()
    assert sum(x[1] for x in out) == sum(lengths)
    used = defaultdict(int)
    for _, n, seq, _ in out:
        used[seq] += n
    assert max(used.values()) <= 2048 and len(used) <= sum(lengths) / 2048 * 1.1 + 3
