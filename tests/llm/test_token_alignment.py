"""Alignment of two tokenizers against whole texts encoded by the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import pytest
from llm_helpers import SF, awkward_docs, needs_data

from panelyard.llm.common import tokenizer_path
from panelyard.llm.token_alignment import A_VOCABULARY, B_VOCABULARY, cross_align, op13_cross_alignment, words_of

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(rows):
    """Results of (id, text) rows: every text whole, every link a pair of token occurrences."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A_VOCABULARY))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_path(B_VOCABULARY))
    visible = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or c >= 0xAE]
    hidden = [c for c in range(256) if c not in visible]
    byte = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(hidden)}

    def spans(tokens):
        at, out = 0, []
        for i, data in tokens:
            out.append((i, at, at + len(data)))
            at += len(data)
        return out

    made, count = [], Counter()
    for key, text in rows:
        ta = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        tb = []
        for i in b.encode(text) if text else []:
            piece = b.id_to_piece(i)
            tb.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = (" " + (text or "")).encode()
        if not text or b"".join(d for _, d in ta) != want or b"".join(d for _, d in tb) != want:
            made.append((key, [], [], [], []))
            continue
        sa, sb = spans(ta), spans(tb)
        ends = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, ia, ib = [], 0, 0
        for end in ends:
            ja, jb = ia, ib
            while ja < len(sa) and sa[ja][2] <= end:
                ja += 1
            while jb < len(sb) and sb[jb][2] <= end:
                jb += 1
            groups.append(",".join(str(i) for i, _, _ in sa[ia:ja]) + "|" + ",".join(str(i) for i, _, _ in sb[ib:jb]))
            ia, ib = ja, jb
        links, jb = [], 0
        for i, lo, hi in sa:
            while sb[jb][2] <= lo:
                jb += 1
            j = jb
            while j < len(sb) and sb[j][1] < hi:
                links.append((i, sb[j][0]))
                j += 1
        count.update(links)
        made.append((key, sa, sb, groups, links))
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return sorted(((
        key, len(sa), len(sb), len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
        hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
    ) for key, sa, sb, groups, links in made), key=repr)


def got(df):
    assert df.columns[1:8] == COLUMNS
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


@needs_data
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op13_cross_alignment(spark, SF)) == plain(rows)


ODD = ["a  b\n c", " lead", "trail ", "   ", " ", "\n", "x\n y \n\nz", "tab\t tab", "<|endoftext|> <s> </s> <0x0A> <unk>", "it's we'll 'S",
       "nbsp   x", "é ﬁ 日本語 テスト", "😀 😀😀 a😀", "aaa aaaa aaaaa", "a\x00b \x1c c", "  x", "zero​", "12345 67 8",
       "un▁der", "▁", "ba▁ x", "a" * 5000, "日" * 3000, "\r\n\r\n  q", " 　 w", "don't’t"]


@pytest.mark.parametrize("hot", [0, 5, 1 << 18])
def test_odd_texts(spark, hot):
    """With few or no frequent pairs everything else goes through the join."""
    draw = random.Random(9)
    rows = list(enumerate(ODD + ["".join(draw.choice("ab \n\t.é日1'") for _ in range(60)) for _ in range(150)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(cross_align(df, hot=hot)) == plain(rows)


def test_words_join_to_the_text():
    draw = random.Random(1)
    for text in ODD + ["".join(draw.choice("ab  \n\t") for _ in range(30)) for _ in range(300)]:
        assert "".join(" " + w for w in words_of(text)) == " " + text


def test_awkward_rows(spark):
    docs = awkward_docs(spark).selectExpr("*", "1 as n_a", "2 as id", "3 as rest", "'x' as groups_sha256")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(cross_align(docs)) == plain(rows)
    assert cross_align(docs.limit(0)).count() == 0
    with_text = cross_align(docs, with_groups=True).collect()
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 if r.groups else r.groups_sha256 == "" for r in with_text)


def test_quick_ids_are_the_library_s():
    """Random texts of every kind of character, and words of random pieces."""
    import json

    from tokenizers import Tokenizer

    from panelyard.llm.token_alignment import rank_encoder

    path = tokenizer_path(A_VOCABULARY)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    quick, draw = rank_encoder(spec), random.Random(3)
    pieces = [library.decode([i]) for i in range(0, 50_000, 7)]
    kinds = [[chr(c) for c in r if not 0xD800 <= c < 0xE000] for r in (range(32, 127), range(1, 0x250), range(0x370, 0x3000, 5), range(0x3000, 0x1F700, 11))]
    texts = ["".join(draw.choices(draw.choice(kinds), k=40)) for _ in range(5000)] + ["".join(draw.choices(pieces, k=12)) for _ in range(5000)]
    assert [quick(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    spec["model"]["merges"] = spec["model"]["merges"][1:]
    assert rank_encoder(spec) is None
