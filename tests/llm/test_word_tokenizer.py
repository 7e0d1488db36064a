"""The word tokenizer's remembered words and parts give the library's own ids."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_words_and_parts_match_the_library():
    from tokenizers import Tokenizer

    from pixelspark.llm.packing import WordTokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    draw = random.Random(1)
    chars = "aAbzZéÉßÿÀ×÷'’ſİıKÅéņ̃ \n\t\x1c\x85 01٣<|>startoftext|s,.-!'st're'LL</w>"
    texts = ["".join(draw.choice(chars) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["", None, "<|startoftext|>a<|endoftext|>", "IT'S 'S''s a'lL don'T <|x", "ǅ", "Σ ΑΣ.", "x" * 5000 + " " + "ab1," * 2000]
    own, library = WordTokenizer(path), Tokenizer.from_file(path)
    assert own.by_part
    for _ in range(2):  # the second time from memory
        for text, ids in zip(texts, own.encode(texts), strict=True):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert ids == b"".join(i.to_bytes(4, "little") for i in want)
