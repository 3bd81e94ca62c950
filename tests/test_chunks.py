"""The splitter on long and odd texts."""

import time

from ragloom.functions.split import CHARS, TOKENS, chunks


def test_a_long_text_is_cut_in_linear_time():
    text = "\n\n".join("word " * 60 + "end. " + "x" * 700 for _ in range(10_000))  # 10 MB
    began = time.process_time()
    quarter = chunks(text[: len(text) // 4], 300, 30)
    part = time.process_time() - began
    began = time.process_time()
    whole = chunks(text, 300, 30)
    assert time.process_time() - began < 12 * max(part, 0.05)
    assert max(map(len, whole)) <= 300 and abs(len(whole) - 4 * len(quarter)) < 8
    assert "".join("".join(whole).split()).count("end.") >= 10_000


def test_units_and_overlaps():
    assert chunks("", 10, 2) == chunks(" \n\t\n", 10, 2) == []
    assert chunks("abc\n\ndef\n\nghi", 7, 2) == ["abc\ndef", "ef\nghi"]
    assert chunks("abcdefghij" * 2, 7, 2) == ["abcdefg", "hijabcd", "efghij"]
    assert chunks("one two. three four! five", 12, 0) == ["one two.", " three four!", " five"]
    assert chunks("a b c d e f g", 3, 1, TOKENS) == ["a b c", "d e f", "f\ng"]
    assert chunks("日本語。漢字かな", 4, 0, CHARS) == ["日本語。", "漢字かな"]
