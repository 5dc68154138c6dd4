"""Token files: every id equal to a plain encoding, places and masks, and the defined cases."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorelake.llm import token_files
from scorelake.llm.token_queries import VOCABULARY, op12_token_files
from scorelake.llm.warc import qualified
from scorelake.sources.workspace import new_folder

PATH = public_tokenizers.path(VOCABULARY)
LONG = "many words of a very long text, " * 9000
ROWS = [
    (7, "plain words\n\n  with  spaces "), (3, None), (2, ""), (None, "no id"), (-5, "é😀 ünï x \x1c y"), (9, LONG),
    (4, "same"), (4, "same"), (4, "other <|endoftext|> text"), (1 << 50, "x" * 5000),
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def _expected(rows, plain):
    out, start = [], 0
    for doc_id, text in rows:
        ids = plain(text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@cache
def _encoder():
    return token_files.Encoder(PATH)


@given(st.text(alphabet=st.sampled_from("ab1 .'\n\t \x1cé²"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_units_equal_whole_texts(text):
    assert token_files._cut(text) == token_files._CUT.split(text)
    encoder = _encoder()
    assert encoder.by_unit
    ids = np.frombuffer(b"".join(encoder.pieces(text)), "<u4").tolist()
    assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.sampled_from("ab1 .'\n\t \x1cé²"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_units_without_room_in_the_memo(text):
    encoder = _encoder()
    full, encoder.memo = encoder.memo, {}
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files, "MEMO", 0)
        ids = np.frombuffer(b"".join(encoder.pieces(text)), "<u4").tolist()
    assert not encoder.memo
    encoder.memo = full
    assert ids == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_of_a_long_text(plain, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 100)
    encoder = token_files.Encoder(PATH)
    pieces = list(encoder.pieces(LONG))
    assert len(pieces) > 1000 and [*np.frombuffer(b"".join(pieces), "<u4"), 0] == plain(LONG)


@pytest.mark.parametrize("sequence", [8, 2048])
def test_round_trip(spark, rows, plain, sequence):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("file", F.lit(1)).withColumn("place", F.lit("x"))
    folder = qualified(spark, new_folder(spark, "tokens"))
    index = token_files.write_files(docs.repartition(4), folder, PATH, sequence=sequence)
    got = sorted(token_files.read_files(index, folder).collect(), key=lambda r: r.start)
    # Rows of one id come in either order of their texts.
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    ways = [_expected([*order[:a], *middle, *order[a + 3 :]], plain) for a in (4,) for middle in
            ([(4, "same"), (4, "same"), (4, "other <|endoftext|> text")], [(4, "other <|endoftext|> text"), (4, "same"), (4, "same")])]
    assert [r[0] for r in order[4:7]] == [4, 4, 4]
    assert [tuple(r) for r in got] in ways


def test_sequences_and_masks(spark, plain):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(30)], "doc_id long, text string")
    folder = qualified(spark, new_folder(spark, "tokens"))
    index = token_files.write_files(docs.coalesce(1), folder, PATH, sequence=16)
    ids, ends, cells = [], 0, 0
    for file in sorted(r.file for r in index.select("file").distinct().collect()):
        opened = token_files.TokenFile(f"{folder}/files/{file}")
        for number in range(len(opened)):
            values, mask, last = opened.row(number)
            assert len(values) == len(mask) == len(last) == 16 and not values.flags.owndata and values.dtype == np.uint16
            mask, last = mask.to_numpy(zero_copy_only=False), last.to_numpy(zero_copy_only=False)
            assert number == len(opened) - 1 or mask.all()
            assert (values[~mask] == 0).all() and (values[last] == 0).all() and mask[last].all()
            ids += values[mask].tolist()
            ends, cells = ends + int(last.sum()), cells + 16
        opened.close()
    assert ends == 30 and ids == [x for i in range(30) for x in plain("word " * i)]


def test_a_wrong_index_is_noticed(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, "and more")], "doc_id long, text string")
    folder = qualified(spark, new_folder(spark, "tokens"))
    index = token_files.write_files(docs.coalesce(1), folder, PATH)
    with pytest.raises(Exception, match="no document of"):
        token_files.read_files(index.withColumn("n_tokens", F.col("n_tokens") - 1), folder).collect()


def test_empty_table(spark):
    folder = qualified(spark, new_folder(spark, "tokens"))
    index = token_files.write_files(spark.createDataFrame([], "doc_id long, text string"), folder, PATH)
    got = token_files.read_files(index, folder)
    assert got.collect() == [] and got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_query_equals_plain_encoding(spark, plain):
    sf_dir = "/root/testdata/sf0.001"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(op12_token_files(spark, sf_dir).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == _expected(docs, plain)
