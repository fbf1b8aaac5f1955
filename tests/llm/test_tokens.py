"""Token counts and the BPE round trip against the libraries on whole texts."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_count

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SIGNS = st.text(alphabet=" \n\tabzAÉß0１2.,'!()<>|▁́ЖΣİKſ漢🎉\x00\x1c sStTlL") | st.text()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(SIGNS)
def test_pretokens_add_up(text):
    processor = token_count.load_pieces(PIECES)
    for cuts in ("fine", "coarse"):
        split = token_count.split_pretokens(text, cuts) if text else []
        assert sum(token_count.count_pieces(split, PIECES)) == len(processor.encode(text))


@settings(max_examples=300, deadline=None)
@given(SIGNS | st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "<|startoftext|>", "'s"])).map("".join))
def test_words_join_to_ids(text):
    tokenizer = bpe.WordTokenizer.of(WORDS)
    ids = [i for found in tokenizer.encode(tokenizer.split(text)) for i in found]
    assert ids == tokenizer.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_token_counts(messy, varied, pieces, head):
    for docs in (messy, varied):
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in docs.select("doc_id", "text").collect()), key=str)
        got = token_count.token_counts(docs, PIECES, head_words=head, limit=100).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_bpe(messy, varied, words, head):
    for docs in (messy, varied):
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = words.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(words.decode(ids, skip_special_tokens=False))))
        got = bpe.bpe_digests(docs, WORDS, head_words=head, sample_docs=90).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rows_repeated_often_are_encoded_once(spark, words):
    """A third of the rows are equal, another third equal without an id: their result comes in pieces, as often as they do."""
    texts = {0: "Alpha beta rareword!", None: "another one, 42", 1: "single"}
    docs = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 0L WHEN id % 3 = 2 THEN 1L END AS doc_id",
                                       "CASE id % 3 WHEN 0 THEN 'Alpha beta rareword!' WHEN 1 THEN 'another one, 42' ELSE concat('single', id) END AS text")
    got = bpe.bpe_round_trip(docs, WORDS, head_words=1, repeats=7).collect()
    assert len(got) == 900 and {r.doc_id for r in got} == {0, 1, None}
    for doc_id in (0, None):
        ids = words.encode(texts[doc_id], add_special_tokens=False).ids
        assert [r.ids for r in got if r.doc_id == doc_id] == [" ".join(map(str, ids))] * 300
    assert len({r.decoded for r in got if r.doc_id == 1}) == 300


def test_round_trip_texts(varied, words):
    for r in bpe.bpe_round_trip(varied, WORDS, head_words=5).collect():
        assert r.decoded == words.decode([int(i) for i in r.ids.split()], skip_special_tokens=False)


def test_empty(empty):
    assert token_count.token_counts(empty, PIECES).collect() == []
    assert bpe.bpe_digests(empty, WORDS).collect() == []


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.check_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
