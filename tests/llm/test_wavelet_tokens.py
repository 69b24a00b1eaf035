import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm.wavelet_tokens import WaveletMatrix, WordEncoder, count_tokens, drops_white_space, encode_documents, joined_crc, locate_token, read_documents, tokens_at

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER, WHOLE = WordEncoder(PATH, most=64), Tokenizer.from_file(PATH)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=2000))
def test_matrix(values):
    ids = np.array(values, np.uint16)
    m = WaveletMatrix(len(ids), *WaveletMatrix.pack(ids, 10))
    assert m.decode().tolist() == values
    for at in {0, len(ids) // 2, len(ids) - 1}:
        assert m.access(at) == values[at]
        assert m.rank(values[at], at) == values[:at].count(values[at])
        assert m.select(values[at], values[:at].count(values[at])) == at
    assert m.rank(1023, len(ids)) == values.count(1023)
    with pytest.raises(IndexError):
        m.select(values[0], values.count(values[0]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.from_regex(r"[A-Za-zÀ-ÿ]{1,9}[.,!?;:|*%$&#'<0-9]{0,3}[a-z]{0,2}", fullmatch=True), max_size=8).map(" ".join), st.text(st.characters(max_codepoint=0x17F), max_size=40)))
def test_words_alone_give_the_same_ids(text):
    code = ENCODER
    assert code.by_word and code.plain
    whole = WHOLE.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
    assert np.frombuffer(code.encode([text])[0], code.dtype).tolist() == whole


@pytest.mark.parametrize("text", ["Straße Ertzßsch", "x" * 300 + " a", "ÀÉÎÕÜ ß-ö", "a1b22 3,,4..", "e\u0301 é", "a<|endoftext|>b", "don't it's", "a\u00a0b\u2003c", ""])
def test_pieces(text):
    for code in (ENCODER, WordEncoder(PATH)):
        assert np.frombuffer(code.encode([text, text])[1], code.dtype).tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_full_table_and_long_texts():
    code = WordEncoder(PATH, most=256)
    for n in range(40):
        text = " ".join(f"w{chr(97 + (i * 7 + n) % 26)}{'abc'[i % 3] * (i % 11)}q{chr(97 + i % 26)}, the ß!" for i in range(n * 3))
        assert np.frombuffer(code.encode([text])[0], code.dtype).tolist() == WHOLE.encode(text, add_special_tokens=False).ids
    long = "Some words, and 12 more! " * 30_000 + "x" * 300_000
    assert np.frombuffer(code.encode(["", long])[1], code.dtype).tolist() == WHOLE.encode(long, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    assert not drops_white_space(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    assert not drops_white_space(json.dumps({"normalizer": None, "pre_tokenizer": None}))


@pytest.mark.parametrize("segment", [500, 1_000_000])
def test_files_by_brute_force(docs_of, odd, spark, segment, tmp_path):
    rows = [*odd, (7, "a second text"), (None, None)] + [(i, f"Document {i} <|endoftext|> it's naïve " * (i % 9)) for i in range(20, 60)]
    folder = f"file://{tmp_path}/tokens"
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in encode_documents(docs_of(rows), PATH, folder=folder, segment_tokens=segment).collect()), key=lambda r: r[0])
    tokenizer = Tokenizer.from_file(PATH)
    want, start, every = [], 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        every += ids.tolist()
    assert got == want
    assert read_documents(spark, folder).count() == len(rows)
    asked = [0, 1, len(every) // 2, len(every) - 1, len(every)]
    assert {r.position: r.token for r in tokens_at(spark, folder, asked).collect()} == {i: every[i] for i in asked[:-1]}
    tokens = [2, every[10], every[-2], 49_000, 10**9]
    assert {r.token: r.n for r in count_tokens(spark, folder, tokens).collect()} == {t: every.count(t) for t in tokens}
    assert sorted(r.position for r in locate_token(spark, folder, 2).collect()) == [i for i, t in enumerate(every) if t == 2]


@given(st.lists(st.binary(max_size=300), max_size=6))
def test_checksums_are_joined(parts):
    assert joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_empty(docs_of):
    assert encode_documents(docs_of([]), PATH).count() == 0
