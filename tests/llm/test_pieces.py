"""SentencePiece encoding against the library, token counts against plain dynamic programming."""

import hashlib

import pytest
import sentencepiece
from llm_helpers import SF, awkward_docs, needs_data
from hypothesis import given, settings
from hypothesis import strategies as st

from panelyard.llm.common import tokenizer_path
from panelyard.llm.piece_encoding import VOCABULARY, Encoder, Normaliser, decoded_column, encoded_column, op9_sentencepiece
from panelyard.llm.piece_model import read_model
from panelyard.llm.piece_model import SPACE
from panelyard.llm.token_counts import BYTE_SCORE, PieceTrie, op5_token_counts, token_counts, unigram_scores

TEXT = st.text(st.one_of(st.sampled_from("abt  \n\té▁ﬁ中😀\x00<s>ñ  ①ｶﾞ"), st.characters(codec="utf-8")), max_size=40)


@pytest.fixture(scope="module")
def data():
    with open(tokenizer_path(VOCABULARY), "rb") as f:
        return f.read()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=3))
def test_ids_and_spans_are_the_librarys(texts):
    keep = test_ids_and_spans_are_the_librarys.__dict__
    if "pair" not in keep:
        with open(tokenizer_path(VOCABULARY), "rb") as f:
            data = f.read()
        keep["pair"] = Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    encoder, library = keep["pair"]
    for text, (named, ids, begins, ends) in zip(texts, encoder(texts)):
        want = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in want] + [library.eos_id()]
        assert named.decode() == " ".join(map(str, ids.tolist()))
        assert list(zip(begins, ends))[:-1] == [(p.begin, p.end) for p in want]
        assert begins[-1] == ends[-1] == len(text.encode())


@settings(max_examples=300, deadline=None)
@given(TEXT)
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normalising_by_a_compiled_map(rule, text):
    keep = test_normalising_by_a_compiled_map.__dict__.setdefault("kept", {})
    if rule not in keep:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        keep[rule] = library, Normaliser(read_model(library.serialized_model_proto()))
    library, normalise = keep[rule]
    got, align = normalise(text.encode())
    assert got.decode() == library.Normalize(text)
    assert len(align) == len(got) + 1 and (align[1:] >= align[:-1]).all() and (align <= len(text.encode())).all()


@needs_data
def test_query(spark, data):
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert r.covered_bytes == len(texts[r.doc_id].encode())


def test_columns_round_trip(spark):
    docs = awkward_docs(spark).selectExpr("*", "1 as ids")
    got = docs.select("text", encoded_column("text").alias("e")).select("text", "e.*").withColumn("back", decoded_column("ids"))
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.back == (r.text or "") and len(r.ids) == len(r.begins) == len(r.ends) and r.ids[-1] == 2
    assert docs.limit(0).select(encoded_column("text").alias("e")).count() == 0


def best_count(word, scores):
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        size = len(word[d - 1].encode())
        found = [] if word[d - 1] in scores else [(best[d - 1][0] + size * BYTE_SCORE, -(best[d - 1][1] + size))]
        for start in range(max(0, d - 16), d):
            if word[start:d] in scores:
                found.append((best[start][0] + scores[word[start:d]], -(best[start][1] + 1)))
        top = max(found)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_trie_counts(spark, data):
    scores = unigram_scores(data)
    docs = awkward_docs(spark)
    trie = PieceTrie(scores, nodes=500)   # small: it starts anew several times
    by_text = {r.doc_id: r for r in token_counts(docs.selectExpr("*", "1 as n_tokens")).collect()}
    for r in docs.collect():
        found = (r.text or "").split()
        counts = [trie.add("▁" + w) for w in found]
        assert counts[:300] == [best_count("▁" + w, scores) for w in found[:300]]
        if r.doc_id is not None:
            assert (by_text[r.doc_id].n_pretokens, by_text[r.doc_id].n_tokens) == (len(found), sum(counts))
    assert token_counts(docs.limit(0)).count() == 0


@needs_data
def test_count_query(spark, data):
    scores = unigram_scores(data)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()}
    got = {r.doc_id: r.n_tokens for r in op5_token_counts(spark, SF).collect()}
    known = {}
    for key, text in texts.items():
        for w in text.split():
            if w not in known:
                known[w] = best_count("▁" + w, scores)
        assert got[key] == sum(known[w] for w in text.split())


def test_very_long_words_need_no_nodes(data, monkeypatch):
    """A window gives the trie's counts, and ten million characters take little memory."""
    import random
    import tracemalloc

    import panelyard.llm.token_counts as counts

    trie, draw = PieceTrie(unigram_scores(data)), random.Random(4)
    for word in ["".join(draw.choices("therandomwordsé日1", k=n)) for n in (1, 2, 5, 40, 700, 3000)]:
        assert trie.windowed(SPACE + word) == trie.add(SPACE + word)
    monkeypatch.setattr(counts, "LONG", 100)
    long = "".join(draw.choices("abcdefgh", k=300_000))
    trie.clear()
    tracemalloc.start()
    assert trie.add(long) > 0 and len(trie.best) == 1
    assert tracemalloc.get_traced_memory()[1] < 5_000_000   # the word itself is not copied
    tracemalloc.stop()
