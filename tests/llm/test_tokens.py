import struct

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from riskframe.llm import tokens
from llm_helpers import odd_texts, vocabulary

FILES = [("byte_bpe_50k.json", "leading"), ("word_bpe_49k.json", "dropped")]
ENCODERS = {name: (tokens.Encoder(vocabulary(name), blanks), Tokenizer.from_file(vocabulary(name))) for name, blanks in FILES}
#: Ends of sentences, capitals, letters that fold oddly, combining marks, control strings.
WORDS = ["the", "Straße.", "ÉTÉ,", "naïve", "don't.", "it's", "İstanbul.", "ŉa", "ªb.", "ΟΔΟΣ.", "x.", "x..", "3.", "é.", "́a", "ǀo,",
         "<|endoftext|>", "a<|b.", "<|x.", "|", ".", ",", "-", "hard em.", "日本.", "🙂.", "thertiontheing", ""]


def whole(plain, texts):
    found = (plain.encode(t, add_special_tokens=False).ids for t in texts)
    return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]


@pytest.mark.parametrize("name", ENCODERS)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", " ", " ", "\n", "\t", "  "])), max_size=12), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    coder, plain = ENCODERS[name]
    texts = ["".join(w + s for w, s in t).removesuffix(" ") for t in texts]
    assert coder.ids(texts) == whole(plain, texts)


@pytest.mark.parametrize("name", ENCODERS)
def test_words_are_taken_to_the_merges(name):
    coder, plain = ENCODERS[name]
    assert coder.by_model
    lead = " " if coder.blanks == "leading" else ""
    for word in ("the", "Zürich", "Ähnlichkeiten", "ætheling", "čaj"):
        assert coder._word(word) == whole(plain, [lead + word])[0]
    assert [coder._word(w) for w in ("x1", "a-b", "", "語")] == [None] * 4


@pytest.mark.parametrize("name,blanks", FILES)
def test_results_do_not_depend_on_cache_or_merges(name, blanks, monkeypatch):
    texts = [t or "" for t in odd_texts()] + [" ".join(f"{a}{b}" for b in WORDS if b) for a in ("un", "Re")]
    want = whole(ENCODERS[name][1], texts)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    coder = tokens.Encoder(vocabulary(name), blanks)
    assert [coder.ids([t])[0] for t in texts] == want == coder.ids(texts)
    coder = tokens.Encoder(vocabulary(name), blanks)
    coder.by_model = False
    assert coder.ids(texts) == want
    assert coder.ids([]) == []


@pytest.mark.parametrize("name,blanks", FILES)
def test_pieces_are_looked_up_together(name, blanks, monkeypatch):
    coder, asked = tokens.Encoder(vocabulary(name), blanks), []
    by_piece = coder._by_piece
    monkeypatch.setattr(coder, "_by_piece", lambda keys: asked.append(len(keys)) or by_piece(keys))
    texts = ["some word, other word.", "word word, x"]
    assert coder.ids(texts) == whole(ENCODERS[name][1], texts)
    assert len(asked) == 1  # bare words and those before a stop


def test_raw_texts_of_slices():
    texts = pa.array(["", "ab", "é", "", "\n🙂"], pa.large_string())
    assert tokens._raw(texts) == [t.encode() for t in texts.to_pylist()]
    assert tokens._raw(texts[1:4]) == [b"ab", "é".encode(), b""]
    assert tokens._raw(texts[:0]) == tokens._raw(pa.array([], pa.large_string())) == []
