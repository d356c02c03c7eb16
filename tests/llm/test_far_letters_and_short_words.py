"""Letters beyond U+FFFF have classes of their own, and short words the tokens of the streaming machine."""

import random

import numpy as np

from mailsift.llm import bpe, quality


def test_far_letters_are_letters():
    text = "𝐀𝐛𐐀😀𠀀𝟗".encode()
    code, bounds = quality.codes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    last = (code % quality.SYMBOLS).tolist()[:-1]
    assert last == [quality.SHIFT, 1, 2, quality.SHIFT, 1 + ord("𐐨") % 26, quality.OTHER, 1 + 0x20000 % 26, quality.DIGIT]
    assert bounds.tolist() == [0, len(last) + 1]


def test_short_words_equal_the_streaming_machine():
    with open(bpe.default_file(), encoding="utf-8") as f:
        machine = bpe.Tokenizer(f.read()).machine
    pick = random.Random(5)
    words = [w[:n].encode()[:48] for w in ("internationalisation", "straßenüber", "xqzjkv", "日本語のテキスト", "aaaaaaaaaaaaaaaaaaaa", "!!!???") for n in range(1, 21)]
    words += [bytes(pick.choice(b"etaoinshrdlu\xc3\xa9") for _ in range(pick.randint(1, 48))) for _ in range(1500)]
    want = [list(machine.tokens(w)) for w in words]
    assert [machine.short(w) for w in words] == want
    assert [machine.short(w) for w in reversed(words)] == want[::-1]  # also where beginnings are remembered
    assert len(machine.heads) <= bpe.HEADS
