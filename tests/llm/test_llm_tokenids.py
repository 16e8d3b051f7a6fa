import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import llm_rows
from relaylens.llm import tokenids

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as file:
        return tokenids.Encoder(file.read())


def same(encoder, library, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    assert len(sizes) == len(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]) if texts else []):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got.tolist() == want, text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(
    "abAB '’.,!?#$%&*<|>\n\t\r  é́ñΣς日ㅎ가²½1_-"), st.characters(exclude_categories=["Cs"])),
    max_size=40), max_size=5))
def test_any_text_is_encoded_as_by_the_library(encoder, library, texts):
    same(encoder, library, texts)


def test_chunks_with_signs_contractions_and_special_tokens(encoder, library):
    same(encoder, library, [
        "it's. 's' don't!!! x's.'s a.'s <|endoftext|> <|startoftext|>. a<|endoftext|>b Word.,; Zoë?",
        "Café. café! ﬁne Å ΑΣ ΣΑ. İI", "a̸. ≠ ≮ .̸ x.̸", None, "",
        " ".join(llm_rows.prose(k, 30) for k in range(30))])


def test_tables_of_chunks_stay_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(tokenids, "KEPT_CHUNKS", 50)
    for k in range(12):
        same(encoder, library, [llm_rows.prose(k, 30), llm_rows.prose(k + 1, 40)])
    assert len(encoder.chunks) < 200


@pytest.mark.parametrize("bits", [1, 3, 7, 8, 11, 13, 16, 17, 24, 29, 31, 32])
def test_packed_numbers_of_every_width(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 5000, dtype=np.uint64).astype("<u4")
    data = tokenids.pack(ids, bits)
    assert len(data) == -(-5000 * bits // 8)
    assert (tokenids.unpack(data, bits, 0, 5000) == ids).all()
    for lo, hi in ((0, 0), (4999, 5000), (17, 900), (8, 9)):
        assert (tokenids.unpack(data, bits, lo, hi) == ids[lo:hi]).all()
    if bits < 32:
        with pytest.raises(ValueError):
            tokenids.pack(np.array([1 << bits], "<u4"), bits)


def test_fewest_bits():
    assert [tokenids.bits_for(n) for n in (1, 2, 3, 256, 257, 49_408, 65_537)] == \
        [1, 1, 2, 8, 9, 16, 17]


def test_a_file_gives_any_document():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 5000, 3, 20_000, 0]
    ids = rng.integers(0, 1 << 11, sum(lengths)).astype("<u4")
    file = tokenids.PackedFile(tokenids.packed_file(
        4, 99, [None, -5, 7, 7, 8, 1 << 40], lengths, ids, 11, block=1000) + b"\n")
    assert (file.part, file.before, file.n_ids) == (4, 99, sum(lengths))
    assert file.doc_ids == [None, -5, 7, 7, 8, 1 << 40]
    for k, part in enumerate(np.split(ids, np.cumsum(lengths)[:-1])):
        assert (file.document(k) == part).all()
    assert (file.ids(999, 1001) == ids[999:1001]).all()
    with pytest.raises(ValueError):
        tokenids.PackedFile(b"x" * 200)


@pytest.mark.parametrize("file_ids", [1 << 21, 500])
def test_awkward_rows(spark, library, monkeypatch, file_ids):
    monkeypatch.setattr(tokenids, "FILE_IDS", file_ids)
    monkeypatch.setattr(tokenids, "LEAST_BYTES", 50_000)
    docs = llm_rows.awkward(spark)
    got = [tuple(r) for r in tokenids.through_files(docs, PATH).select(
        "doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokenids.through_files(docs.limit(0), PATH).count() == 0


def test_many_rows_of_one_id_in_many_files(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenids, "LEAST_BYTES", 2000)
    random.seed(2)
    texts = [(random.choice([1, 1, 1, 2, 3]), llm_rows.prose(k % 9, 60)) for k in range(200)]
    docs = llm_rows.documents(spark, texts)
    path = str(tmp_path / "ids")
    tokenids.write_ids(docs, path, PATH, 1)
    assert len([f for f in os.listdir(path) if f.endswith(".txt")]) > 5
    places = sorted(map(tuple, tokenids.read_places(spark, path).select(
        "start", "n_tokens", "doc_id").collect()))
    assert [p[2] for p in places] == sorted(t[0] for t in texts)
    assert all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:]))
    wanted = spark.createDataFrame([(2,), (2,), (77,)], "doc_id long")
    got = sorted(r["ids"] for r in tokenids.ids_of(spark, path, wanted).collect())
    assert got == sorted(library.encode(t, add_special_tokens=False).ids + [1]
                         for i, t in texts if i == 2)
