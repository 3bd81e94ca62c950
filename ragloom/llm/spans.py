"""Cutting a text into spans that a tokenizer treats independently, and looking the spans up in two tiers.

A span is a run of white space with the word after it. A byte-level pre-token never goes from a word into the white space
behind it, and no piece of the merge-type model has a word-start mark after another character, so the ids of a text are the
ids of its spans one after the other.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Callable

SPECIAL = "<|endoftext|>"
_WORDS = re.compile(r"\s*\S+|\s+$")
_ODD = re.compile("[\x1c-\x1f]")
#: Marks that a byte-level tokenizer never joins to a letter before them; a piece model is asked (``tails``).
TAIL = ".,;:!?#$%&*|"


class Uneven(Exception):
    """A part that borders on more white space than one blank or line end."""


class SpanCache(dict):
    """part -> value. A part that starts with a line end stands for itself, any other for a blank and itself.

    ``first`` is the broadcast tier of frequent parts; misses are encoded once and kept up to twice ``most`` entries. ``join`` puts
    the values of a word and of the marks behind it together, so that both are looked up apart (None: never).
    """

    def __init__(self, encode: Callable[[str], object], first: dict | None = None, most: int = 600_000, join: Callable | None = operator.add):
        super().__init__(first or {})
        self.encode, self.first, self.most, self.join = encode, first or {}, most, join
        self.loose: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def __missing__(self, part: str):
        body = part[1:] if part[:1] == "\n" else part
        if not body or body[0].isspace() or body[-1].isspace():
            raise Uneven
        if len(self) >= self.most:  # two generations: what is still in use moves back from the old one
            self.old = dict(self)
            self.clear()
            self.update(self.first)
        value = self.old.get(part)
        if value is not None:
            self[part] = value
            return value
        core = part.rstrip(TAIL)
        if self.join and len(core) < len(part) and core[-1:].isalpha() and core[-1] < "\u0250":
            value = self.join(self[core], self.span(part[len(core) :]))
        else:
            value = self.encode(part if part[0] == "\n" else " " + part)
        self[part] = value
        return value

    def span(self, s: str):
        """The value of a span as it stands in the text."""
        value = self.loose.get(s)
        if value is None:
            if len(self.loose) >= self.most // 8:
                self.loose.clear()
            value = self.loose[s] = self.encode(s)
        return value


def parts_of(text: str) -> list[str]:
    return text.replace("\n", " \n").split(" ")


def values(cache: SpanCache, text: str, lead: str = "") -> list:
    """The values of a text's spans in order. ``lead``: white space that the tokenizer puts before every text."""
    if not text:
        return []
    head, *rest = parts_of(text)
    try:
        if not head or head[0].isspace() or head[-1].isspace():
            raise Uneven
        return [cache.span(lead + head), *map(cache.__getitem__, rest)]
    except Uneven:
        if _ODD.search(text):  # white space for Python, not for the tokenizers
            return [cache.encode(lead + text)]
        return [cache.span(s) for s in _WORDS.findall(lead + text)]


def frequent_parts(texts, counts: Counter, keep: int) -> None:
    """Add the parts of some texts to ``counts``, which is cut back by lossy counting beyond 16 * keep entries."""
    for text in texts:
        if text:
            counts.update(parts_of(text))
            if len(counts) > 16 * keep:
                trim(counts, 4 * keep)


def trim(counts: Counter, keep: int) -> None:
    if len(counts) > keep:
        floor = sorted(counts.values(), reverse=True)[keep]
        for k in [k for k, n in counts.items() if n <= floor]:
            del counts[k]
