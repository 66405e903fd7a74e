"""Phrase counts of texts of many blocks against a parse symbol by symbol."""

import random
import tracemalloc

import pytest

from lodestar.llm import language_id


def by_hand(parser, text, sample):
    """Phrases of a text: the longest match with anything in the sample, again and again."""
    known = parser.symbols(sample).tobytes().decode("utf-16-le")
    count, phrase = 0, None
    for c in parser.symbols(text).tobytes().decode("utf-16-le"):
        if phrase is not None and phrase + c in known:
            phrase += c
        elif phrase is None:
            count, phrase = 1, c if c in known else ""
            count += c not in known
        else:
            count, phrase = count + 1, c if c in known else ""
    return count


@pytest.mark.parametrize("block", [1, 3, 16, 256])
def test_phrases_cross_blocks(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "LANES", 7)
    draw = random.Random(block)
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(1, 8))) for _ in range(60)]
    samples = tuple((lang, " ".join(draw.choices(words, k=200))) for lang in ("x", "y"))
    cut = samples[0][1][100:700]
    texts = [cut, cut + "zz" + cut, " ".join(draw.choices(words, k=300)), "a", "zzzz", "a z b", samples[1][1], "ab" * 300, "".join(draw.choices("abcdefghz ", k=900))]
    parser = language_id.CrossParser(samples)
    found = parser.phrases([parser.symbols(t) for t in texts])
    for row, text in zip(found.tolist(), texts, strict=True):
        assert row == [by_hand(parser, text, sample) for _, sample in samples], text[:40]
    assert found[0, 0] == 1 and found[6, 1] == 1


def test_substring_is_one_phrase():
    draw = random.Random(1)
    sample = "".join(draw.choices("abcdefghijklmnopqrst ", k=3000))
    parser = language_id.CrossParser((("x", sample),))
    assert parser.phrases([parser.symbols(sample[500:2000].strip())])[0, 0] == 1


def test_thousands_of_letters():
    """A language of many letters: the table stays within what its states and letters make."""
    draw = random.Random(2)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    sample = "".join(draw.choices(letters, k=3000))
    tracemalloc.start()
    parser = language_id.CrossParser((("zh", sample), ("en", "the quick brown fox jumps over the lazy dog")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * 2**20
    lang, score = parser.predict([sample[10:60], "the lazy dog", "123", None])
    assert lang == ["zh", "en", "und", "und"] and score[0] > 0.9
