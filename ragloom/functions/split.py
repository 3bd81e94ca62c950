"""Splitting texts into packed chunks: paragraphs, else lines, else sentences, else words, else hard cuts. One pass over a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from .text import SENTENCE

_PARAGRAPH, _SENTENCE = re.compile(r"\n[ \t\n\x0b\f\r]*\n"), re.compile(SENTENCE)
_VISIBLE, _WORD = re.compile(r"[^ \t\n\x0b\f\r]"), re.compile(r"[^ \n\r\t]+")


@dataclass(frozen=True)
class Measure:
    """How a chunk is measured: the size of a text, of a joiner, a chunk's tail of a given size, a text's smallest pieces, and which
    pieces of a text are kept."""

    size: Callable[[str], int]
    gap: int
    tail: Callable[[str, int], str]
    pieces: Callable[[str, int], Iterator[str]]
    kept: Callable[[str], object]


def _cut(text: str, most: int) -> Iterator[str]:
    for word in text.split(" "):
        yield from (word[i : i + most] for i in range(0, len(word), most))


def _last_words(text: str, n: int) -> str:
    return " ".join(_WORD.findall(text)[-n:] if n else [])


CHARS = Measure(len, 1, lambda text, n: text[-n:] if n else "", _cut, _VISIBLE.search)
#: Words count as tokens.
TOKENS = Measure(lambda text: len(_WORD.findall(text)), 0, _last_words, lambda text, most: iter(_WORD.findall(text)), _WORD.search)


def packed(units: Iterator[str], most: int, overlap: int, joiner: str, m: Measure) -> list[str]:
    """Units in order, as many to a chunk as fit into ``most``; a chunk after the first starts with the tail of the one before it
    where that leaves room."""
    done: list[str] = []
    parts: list[str] | None = None
    size = 0
    for unit in units:
        n = m.size(unit)
        if parts is None:
            parts, size = [unit], n
        elif size + m.gap + n <= most:
            parts.append(unit)
            size += m.gap + n
        else:
            done.append(joiner.join(parts))
            room = min(overlap, size) + m.gap + n
            parts, size = ([m.tail(done[-1], overlap), unit], room) if overlap and room <= most else ([unit], n)
    if parts is not None:
        done.append(joiner.join(parts))
    return done


def _units(text: str, most: int, m: Measure) -> Iterator[str]:
    for paragraph in _PARAGRAPH.split(text):
        if m.size(paragraph) <= most:
            yield paragraph
            continue
        for line in paragraph.split("\n"):
            if m.size(line) <= most:
                yield line
                continue
            for sentence in _SENTENCE.findall(line):
                if m.size(sentence) <= most:
                    yield sentence
                else:
                    yield from packed(m.pieces(sentence, most), most, 0, " ", m)


def chunks(text: str, most: int, overlap: int, m: Measure = CHARS) -> list[str]:
    """Chunks of at most ``most``; a text of blanks has none."""
    return packed((u for u in _units(text, most, m) if m.kept(u)), most, overlap, "\n", m)
