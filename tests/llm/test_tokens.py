import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import EDGES, text_of
from tidewheel.llm import packing, queries, token_files, tokens
from tidewheel.llm.elias_fano import EliasFano, encode
from tidewheel.llm.tokens import Encoder


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    whole, encoder = plain(name), Encoder(public_tokenizers.path(name))
    assert encoder.kind in ("leading", "dropped")
    alphabet = list(" \n\t\r\x0b\x1c\x85  'sdA é́Σς1２-_😀<|endoftext|>") + ["  ", "\n\n", "'ll ", "word ", " the", "Ünder", "ﬁ", "‍", "İ", "\u0958", "\u1e9e", "ſ", "!!", "$_", "a,.", "\nZ", " Ab*** ", " é; "]

    @settings(max_examples=600, deadline=None)
    @given(st.lists(st.sampled_from(alphabet), max_size=30).map("".join))
    def check(text):
        assert list(array("I", encoder.encode(text))) == whole(text)

    check()


def test_all_white_space_is_known():
    spaces = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert spaces == set(" \n" + tokens._ODD_SPACES + tokens._WIDE_SPACES)


def corpus():
    rng = random.Random(9)
    return [*EDGES, *[(100 + i, text_of(rng, rng.choice([1, 10, 500, 3000]))) for i in range(40)]]


def test_op3_is_a_partition_into_powers_of_two(spark, make, table):
    rows = corpus()
    found = queries.op3_packing(spark, table(documents=make(rows))).collect()
    whole = plain("word_bpe_49k.json")
    expected = []
    for doc, text in rows:
        ids = [*whole(text), 1]
        expected += [(doc, a, n, zlib.crc32(array("I", ids[a : a + n]).tobytes()), len(ids)) for a, n in packing.cuts(len(ids))]
    assert sorted((tuple(r[:5]) for r in found), key=str) == sorted(expected, key=str)
    assert len({r["sequence_id"] for r in found}) == len(found) and {r["offset"] for r in found} == {0}
    assert all(r["length"].bit_count() == 1 and r["length"] <= 2048 for r in found)


@given(st.integers(0, 20_000))
def test_cuts_are_gapless(n):
    at = 0
    for start, length in packing.cuts(n):
        assert start == at and length & (length - 1) == 0
        at += length
    assert at == n


@pytest.mark.parametrize("rows", [corpus(), []])
def test_buckets_hold_equal_lengths(spark, make, tmp_path, rows):
    packed = packing.pack(make(rows))
    path = str(tmp_path / "buckets")
    found = packing.write_buckets(packed, path)
    columns = packed.columns
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, packed.collect()))
    for folder in (tmp_path / "buckets").glob("length=*"):
        own = spark.read.parquet(str(folder)).selectExpr("octet_length(ids) / 4 AS n").distinct().collect()
        assert [r["n"] for r in own] == [int(folder.name.removeprefix("length="))]


def test_op4_reads_back_what_the_library_says(spark, make, table):
    rows = corpus()
    found = queries.op4_token_files(spark, table(documents=make(rows))).collect()
    whole, at, expected = plain("byte_bpe_50k.json"), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*whole(text), 0]
        expected.append((doc, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected


def test_shards_are_read_a_few_documents_at_a_time(spark, make, monkeypatch):
    rows = corpus() + [(None, f"none {i}") for i in range(5)]
    path = token_files.write_tokens(make(rows), token_files.new_path(spark))
    whole = token_files.read_tokens(spark, path).collect()
    monkeypatch.setattr(token_files.EliasFano, "values", None)  # no table of all bounds
    for docs, ids in ((1, 1 << 20), (3, 1 << 20), (1024, 16)):
        read = token_files._read_shards(path, docs, ids)
        manifest = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
        found, base = [], 0
        for r in manifest:
            batch = pa.RecordBatch.from_pylist([{"shard": r["shard"], "base": base, "width": r["width"]}])
            found += [tuple(x.values()) for part in read([batch]) for x in part.to_pylist()]
            base += r["ids"]
        assert sorted(found, key=str) == sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in whole), key=str)


def test_shards_find_documents_by_number(spark, make):
    path = token_files.write_tokens(make([(3, "three"), (1, "one one"), (None, "none")]), token_files.new_path(spark))
    manifest = spark.read.parquet(f"{path}/manifest").orderBy("shard").collect()
    whole, found = plain("byte_bpe_50k.json"), []
    for r in manifest:
        shard = token_files.Shard(path, r["shard"], r["width"])
        found += [(shard.doc_id(i), shard.ids(i).tolist()) for i in range(len(shard))]
    assert found == [(None, [*whole("none"), 0]), (1, [*whole("one one"), 0]), (3, [*whole("three"), 0])]


def test_empty_tables(spark, make, table):
    folder = table(documents=make([]))
    assert queries.op3_packing(spark, folder).count() == 0
    assert queries.op4_token_files(spark, folder).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(-(2**60), 2**60), st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**45)), max_size=700))
def test_elias_fano_round_trip_and_select(first, steps):
    values = np.cumsum(np.array([first, *steps], dtype=np.int64))
    coded = EliasFano(encode(values))
    assert (coded.values() == values).all()
    for i in range(0, len(values), 37):
        assert coded.select(i) == values[i]
        for j in (i, i + 1, min(len(values), i + 300), len(values)):
            assert (coded.select_range(i, j) == values[i:j]).all()
    with pytest.raises(IndexError):
        coded.select(len(values))


def test_elias_fano_of_large_gaps_and_space():
    dense = np.cumsum(np.random.default_rng(1).integers(1, 1000, 100_000))
    assert len(encode(dense)) < len(dense) * 1.6  # bytes; 64-bit offsets take 8
    assert len(EliasFano(encode(np.zeros(0, np.int64)))) == 0
    with pytest.raises(ValueError):
        encode(np.array([2, 1]))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_distinct_units_are_encoded_once_and_dropped_units_again(name):
    """Words with other marks behind them share their ids; a full cache changes no id."""
    rng, whole = random.Random(4), plain(name)
    words = ["".join(rng.choices("abcdefgäßñÉ", k=rng.randrange(1, 9))) for _ in range(400)]
    texts = [None, "", *[" ".join(rng.choice(words) + rng.choice(["", ",", ".\n", "!)"]) for _ in range(60)).replace("\n ", "\n") for _ in range(40)], "two  spaces"]
    encoder, small = Encoder(public_tokenizers.path(name)), Encoder(public_tokenizers.path(name), 50)
    expected = [whole(text) for text in texts]
    assert [list(array("I", x)) for x in encoder.encode_all(texts)] == expected
    assert len(encoder.units) <= 2 * len(set(words)) + 8
    for at in range(0, len(texts), 5):
        assert [list(array("I", x)) for x in small.encode_all(texts[at : at + 5])] == expected[at : at + 5]
