"""Encoding, packing and ORC files against plain re-computation."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from curdline.llm import orc_tokens, packing, tokens
from tests.llm.helpers import DOCUMENTS, docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = tokens.tokenizer_spec(PATH)
PLAIN = Tokenizer.from_file(PATH)  # as it comes


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


ODD = ["", None, "a", " ", "  x  y ", "tab\tnew\nline \n two\n\n  three", "it's we'll don't'S 's", "ünïcödé – ‘quoted’ 日本語 text",
       "<|endoftext|> plain <|endoftext|>", "word,word. Word!?… end", "  nbsp   em\u0085x \x1c y", "🙂 👩‍👩‍👧 ok", "1 2,3.4 5%",
       "x" * 3000, "a.b.c,d ;e", "é. É,ß; ñ!", "a \nb\n c\n\nd", "ends in space ", "\nstarts so",
       "a   b  \n  c", ", . a., ,b", "it<|endoftext|>joined", "<|endoftext|>", "a \x1c b\u2028c \u3000 d", "ª. º, 1. 2,"]


def test_pieces_give_the_ids_of_whole_texts():
    encode = tokens.Encoder(SPEC).encode
    texts = [*ODD, prose(1, 500)]
    assert [list(np.frombuffer(x, "<u4")) for x in encode(texts)] == [ids_of(t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["ab", "é", "C", "'s", ".", ",", "!", " ", "\n", "7", "\t", "<|endoftext|>"]), max_size=14).map("".join))
def test_any_short_text(text):
    assert list(np.frombuffer(tokens.encoder(SPEC).encode([text])[0], "<u4")) == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é'sñ.,!?: \n\t ​<|1日"), max_size=40))
def test_any_text(text):
    assert list(np.frombuffer(tokens.encoder(SPEC).encode([text])[0], "<u4")) == ids_of(text)


def test_known_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 20)
    encoder = tokens.Encoder(SPEC)
    for seed in range(5):
        text = prose(seed, 30)
        assert list(np.frombuffer(encoder.encode([text])[0], "<u4")) == ids_of(text)
    assert len(encoder.known) + len(encoder.odd) <= 20 + 30


def corpus():
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(i, 3 + 37 * i % 700)) for i in range(120)]
    return [*rows, (300, prose(9, 9000)), (100, "again"), (100, "again"), (None, "no id")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_packing(spark, rows):
    out = packing.packed(docs(spark, rows).selectExpr("*", "1 as piece", "2 as task", "true as is_open"), SPEC).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    wanted = defaultdict(list)
    for i, t in rows:
        ids = ids_of(t)
        for k, (a, n) in enumerate(packing.cut_points(len(ids), packing.CAPACITY)):
            wanted[i].append((k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())))
    assert {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) for i, rs in documents.items()} == {
        i: sorted(x) for i, x in wanted.items()
    }
    total = sum(len(ids_of(t)) for _, t in rows)
    assert len(sequences) <= 1.05 * total / packing.CAPACITY + 1


def test_sequences_hold_the_ids(spark):
    given = docs(spark, [(i, prose(i, 50 + 400 * i)) for i in range(8)])
    pieces = packing.packed(given, SPEC)
    back = defaultdict(dict)
    content = {r.sequence_id: r.ids for r in packing.sequence_ids(given, pieces, SPEC).collect()}
    for r in pieces.collect():
        back[r.doc_id][r.start] = content[r.sequence_id][r.offset : r.offset + r.length]
    for r in given.collect():
        assert [x for s in sorted(back[r.doc_id]) for x in back[r.doc_id][s]] == ids_of(r.text)


def test_cut_points():
    assert packing.cut_points(1024, 1024) == [(0, 1024)]
    assert packing.cut_points(5, 1024) == [(0, 5)]
    assert packing.cut_points(2050, 1024) == [(0, 2), (2, 1024), (1026, 1024)]


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    closed = [c for n in (6, 7, 8) for c in bins.add(n, n)]
    assert closed == [[7]]
    assert list(bins.add(2, 2)) == [[8, 2]]
    assert list(bins.rest()) == [[6]]


def test_orc(spark, rows, tmp_path):
    path = f"file:{tmp_path}/ids.orc"
    orc_tokens.write(docs(spark, rows).selectExpr("*", "1 as part", "2 as ids"), SPEC, path)
    stored = orc_tokens.read(spark, path)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    wanted, start = [], 0
    for i, t in ordered:
        ids = ids_of(t)
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, orc_tokens.checksums(stored).collect()), key=lambda r: r[1]) == wanted
    some = orc_tokens.documents_with_ids(spark, path, [101, 300])
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.ids for r in some.collect()} == {i: ids_of(t) for i, t in rows if i in (101, 300)}


def test_orc_files_have_indexes(spark, tmp_path):
    import pyarrow.orc

    path = f"{tmp_path}/ids.orc"
    orc_tokens.write(docs(spark, [(i, prose(i, 200)) for i in range(50)]), SPEC, f"file:{path}")
    file = next(f for f in sorted(__import__("pathlib").Path(path).glob("*.orc")))
    found = pyarrow.orc.ORCFile(file)
    assert found.row_index_stride == orc_tokens.ROW_INDEX_STRIDE and str(found.compression).lower() == "zstd"


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert packing.packed(empty, SPEC).collect() == []
    orc_tokens.write(empty, SPEC, f"file:{tmp_path}/empty.orc")
    assert orc_tokens.checksums(orc_tokens.read(spark, f"file:{tmp_path}/empty.orc")).collect() == []


def test_tokenizer_is_a_parameter():
    assert json.loads(SPEC)["model"]["type"] == "BPE"
