"""The content-search language: plain Python, since a query is a literal of the plan."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

from .text import LOWER, UPPER, fold_text

# Marks at a word's edge that belong to the sentence.
PROSE = ".,;:!?\"'()[]{}*«»‹›“”„‟‘’‚‛¿¡…–—·「」『』（）［］｛｝【】〈〉《》、。，．：；！？"
# Scripts written without spaces.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F))
# Endings, longest first, and what takes their place.
ENDINGS = {"izations": "iz", "ization": "iz", "ations": "", "ation": "", "nesses": "", "ments": "", "ities": "", "ness": "", "ment": "", "ings": "", "ity": "", "ies": "y", "ied": "y", "ing": "", "ed": "", "ly": "", "es": "", "s": "", "e": "", "y": "i"}
_ASCII = str.maketrans(UPPER, LOWER)
_QUOTE = '"“”'


def unspaced(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in UNSPACED)


def telling(c: str) -> bool:
    """A symbol that a question may be about."""
    return not (c.isalnum() or c.isspace() or c in PROSE)


def ascii_lower_text(s: str) -> str:
    return s.translate(_ASCII)


# Per ending, the stems it is an ending of; letters that stay double.
_FITS = {"es": re.compile("(?:ch|sh|ss|x|z)$"), "s": re.compile("(?<![sui])$"), "y": re.compile("(?<![aeiou])$")}
_DOUBLED = re.compile(r"^(.*([^aeioulsz]))\2$")


def root(word: str) -> str | None:
    """The beginning that a plain English word shares with its other forms; None if there is none of four letters."""
    if not re.fullmatch("[a-z]+", word):
        return None
    ending = next((e for e in ENDINGS if word.endswith(e) and (e not in _FITS or _FITS[e].search(word[: -len(e)]))), None)
    if ending is None or len(word) - len(ending) < 4:
        return None
    stem = word[: -len(ending)] + ENDINGS[ending]
    if not ENDINGS[ending] and len(stem) >= 5:
        stem = _DOUBLED.sub(r"\1", stem)
    return stem if stem != word else None


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False

    @property
    def has_words(self) -> bool:
        return any(c.isalnum() for c in self.text)

    def expression(self) -> str:
        """The term in full-text syntax."""
        q = lambda s: '"' + s.replace('"', '""') + '"'
        low = self.text.lower()
        if self.phrase:
            return q(low) + "*"
        star = "*" if len(low) >= 3 else ""
        r = root(low)
        return f"({q(low)}{star} OR {q(r)}*)" if r else q(low) + star

    def phrases(self) -> list[tuple[list[str], bool]]:
        """Alternatives as (tokens, whether the last is a prefix)."""
        low = self.text.lower()
        out = [(tokenize(low), self.phrase or len(low) >= 3)]
        r = None if self.phrase else root(low)
        if r:
            out.append((tokenize(r), True))
        return [(t, p) for t, p in out if t]

    def spellings(self) -> list[str]:
        """As typed, and in lower case if that isn't reached by folding ASCII."""
        low = self.text.lower()
        return [self.text] if low == ascii_lower_text(self.text) else [self.text, low]


def tokenize(s: str) -> list[str]:
    """Words of a literal as the index has them."""
    folded, out = fold_text(s), [""]
    for c in folded:
        if unicodedata.category(c)[0] in "LN":
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [t for t in out if t]


@dataclass(frozen=True)
class Query:
    terms: tuple[Term, ...]
    typed: str

    @staticmethod
    def parse(typed: str) -> Query:
        """Words, all of them in any order; between quotes a phrase, an unclosed quote's running to the end."""
        terms: list[Term] = []
        for i, part in enumerate(re.split(f"[{_QUOTE}]+", typed)):
            if i % 2:
                terms.append(Term(" ".join(part.split()), True))
            else:
                terms += [Term(w) for w in part.split()]
        return Query(tuple(t for t in terms if any(c.isalnum() or telling(c) for c in t.text)), typed)

    def __bool__(self) -> bool:
        return bool(self.terms)

    def all_of(self) -> str:
        return " AND ".join(t.expression() for t in self.terms if t.has_words)

    def any_of(self) -> str:
        return " OR ".join(t.expression() for t in self.terms if t.has_words)

    def beyond_tokens(self) -> bool:
        """Whether the index would lose what the query is about."""
        words = [w for t in self.terms for w in t.text.split()]
        return any(telling(w[0]) or telling(w[-1]) for w in words) or any(unspaced(c) for c in self.typed)

    def needles(self, whole: bool = False) -> list[list[str]]:
        """Per term (or for the whole query) the spellings to find in a raw line, folded and escaped as JSON writes them."""
        groups = [Term(self.typed.strip()).spellings()] if whole or not self.terms else [t.spellings() for t in self.terms]
        out = []
        for ways in groups:
            found = dict.fromkeys(json.dumps(ascii_lower_text(w.strip()), ensure_ascii=False)[1:-1] for w in ways)
            if ways := [w for w in found if w]:
                out.append(ways)
        return out
