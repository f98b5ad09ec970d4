"""Ids of words that are remembered in parts: the same as those of whole texts, with fewer words encoded."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from treelens.llm.packing import TOKENIZER, WordTokenizer

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def test_case_and_marks_do_not_make_new_words(monkeypatch):
    tokenizer, sent = WordTokenizer(PATH, 100, "<u4"), []
    inner = tokenizer.codes
    monkeypatch.setattr(tokenizer, "codes", lambda words: sent.extend(words) or inner(words))
    tokenizer.ids([b"Tide tide. TIDE, tide!? tiDE", b"tide; Boat"])
    assert len(sent) == 2


@pytest.mark.parametrize("kept", [0, 3, 1000])
def test_ids_are_those_of_whole_texts(whole, kept):
    texts = [
        "", " ", "The tide. THE TIDE! the tide,the tide##", "it's. IT'S! don't? 'S. x'. ?' &c. #tag $5.00 100% a&b a*",
        "H̱. ẖ H̱ İ! İ ΣAΣ. éé. ÉCOLE! …! a…! ß? Ä,",
        "<|endoftext|> <|ENDOFTEXT|> <|EndOfText|>. a<|endoftext|>b! x<|STARTOFTEXT|>",
        "中文. рыба! \U0001f600!! a\U0001f600. \U0001d400. �.  x. a​b. tab\tand\nline x.",
        "!!! ... .a a.b. a!.# " + "z" * 300 + ". " + "?" * 50,
    ]
    tokenizer = WordTokenizer(PATH, kept, "<u4")
    for _ in range(3):
        coded, sizes = tokenizer.ids([text.encode() for text in texts])
        for text, own, size in zip(texts, coded, sizes, strict=True):
            assert np.frombuffer(own, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text
            assert size == len(own) // 4
