import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import llm_rows
from relaylens.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return pieces.read_model(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(model, library, text):
    ids = np.frombuffer(model.encode(text), np.int32).tolist()
    assert ids == library.encode(text)
    assert model.decode(ids) == library.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab ▁\n\té日😀<0x41>theing"), st.characters(
    exclude_categories=["Cs"])), max_size=40))
def test_any_text_is_encoded_as_by_the_library(model, library, text):
    same(model, library, text)


def test_texts_made_of_pieces(model, library):
    random.seed(5)
    known = list(model.ids)
    for _ in range(2000):
        same(model, library, "".join(random.choices(known, k=random.randint(0, 9)))
             .replace("▁", " "))


def test_long_runs_step_back(model, library):
    for text in ("a" * 5000, "ab" * 3000, " " * 2000, "x " * 3000, "\n" * 500, "ing" * 900):
        same(model, library, text)


def test_both_ways_to_compare_neighbours_agree(model):
    random.seed(6)
    known = [p for p in model.shorter if len(p) > 1]
    for _ in range(3000):
        x, y = random.choices(known, k=2)
        if x in model.odd or y in model.odd:
            continue
        assert model.apart(x, y) == (model.merged(x + y, len(x)) == [x, y])


def test_awkward_rows(spark, library):
    docs = llm_rows.awkward(spark)
    got = pieces.with_pieces(docs, PATH, into="out").select(
        "doc_id", "text", F.col("out"), *pieces.digests(F.col("out"))).collect()
    assert len(got) == docs.count()
    for row in got:
        ids = library.encode(row["text"] or "")
        assert row["out"]["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["out"]["decoded"] == library.decode(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert pieces.with_pieces(docs.limit(0), PATH).count() == 0
