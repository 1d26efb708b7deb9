"""String functions over columns, all in built-in expressions.

Text that is unknown is the empty string at the public boundary; white space and
control characters are Unicode's.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What no terminal cell shows, controls aside.
BIDI = "\\u061c\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069"
UNDRAWABLE = f"[\\p{{Cc}}{BIDI}]"
UNDRAWABLE_NOT_SPACE = f"[\\p{{Cc}}{BIDI}&&[^\\t-\\r\\x85]]"
#: A JSON string's inside, possessive so that long ones cost no stack.
JSON_CHARS = r'((?:[^"\\]++|\\.)*+)'
#: Options of a JSON reader that takes strings of any length; by itself it takes 20 million characters.
LONG = {"maxStringLen": str(2**31 - 1)}
REMINDER = r"(?s)<system-reminder>.*?(?:</system-reminder>|\z)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def drawable(c: Column) -> Column:
    """Without control and direction characters."""
    return F.regexp_replace(c, UNDRAWABLE, "")


def squash(c: Column, most: int | None) -> Column:
    """White space collapsed, undrawable characters dropped, at most ``most`` characters (None: all) and no space last."""
    one_line = F.regexp_replace(F.regexp_replace(c, UNDRAWABLE_NOT_SPACE, ""), r"(?U)\s+", " ")
    return F.trim(one_line) if most is None else F.rtrim(F.left(F.trim(one_line), F.lit(most)))


def is_real_user_text(c: Column) -> Column:
    """Something typed, rather than an envelope or a caveat."""
    t = trimmed(c)
    return F.coalesce((t != "") & ~t.startswith("<") & ~t.startswith("Caveat:"), F.lit(False))


def mend_surrogates(c: Column) -> Column:
    """Escapes of half a surrogate pair become U+FFFD; whole pairs stay."""
    high = F.regexp_replace(c, r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})", r"\\ufffd")
    return F.regexp_replace(high, r"(?i)(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}", r"\\ufffd")


def json_string(c: Column, key: str) -> Column:
    """The first string value of a key in a raw JSON line, decoded; null if there is none."""
    raw = F.regexp_extract(c, f'"{key}":"{JSON_CHARS}"', 1)
    decoded = F.from_json(mend_surrogates(F.concat(F.lit('{"v":"'), raw, F.lit('"}'))), "v string", LONG)["v"]
    there = F.instr(c, f'"{key}":"') > 0
    return F.when(there, F.when(raw.contains("\\"), decoded).otherwise(raw))


def json_number(c: Column, key: str) -> Column:
    """The first unsigned integer of a key, else 0."""
    return F.coalesce(F.regexp_extract(c, f'"{key}": *([0-9]+)', 1).try_cast("bigint"), F.lit(0))


def strip_reminders(c: Column) -> Column:
    return F.regexp_replace(c, REMINDER, "")


def unescaped(c: Column) -> Column:
    """Prose of a raw JSON string: breaks and code escapes become spaces, other escapes their character."""
    marked = F.regexp_replace(F.regexp_replace(strip_reminders(c), "\u0001", ""), r"(?s)\\(.)", "\u0001$1")
    spaced = F.regexp_replace(marked, "(?s)\u0001(?:[ntr]|u.{0,4})", " ")
    return F.regexp_replace(F.regexp_replace(spaced, "\u0001", ""), r"\\$", "")


def normalize_tag(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), r"(?U)\s", "-"), r"(?U)[^\p{Alpha}\p{N}_/.-]", "")


def clean_note(c: Column) -> Column:
    return squash(trimmed(c), 500)


def short_cwd(c: Column, home: str) -> Column:
    """The home folder as ``~``."""
    if not home:
        return c
    return F.when(c == home, "~").when(c.startswith(f"{home}/"), F.concat(F.lit("~/"), F.substring(c, len(home) + 2, 1 << 30))).otherwise(c)


def model_short(c: Column) -> Column:
    return F.regexp_replace(c, "^claude-", "")


def title(custom: Column, ai: Column, first_prompt: Column, is_subagent: Column) -> Column:
    given = [F.nullif(x, F.lit("")) for x in (custom, ai, first_prompt)]
    return F.coalesce(*given, F.when(is_subagent, "(subagent)"), F.lit("(untitled session)"))


def same_prefix(a: Column, b: Column, n: int = 24) -> Column:
    """Whether two texts open alike, whatever their case."""
    x, y = F.lower(trimmed(a)), F.lower(trimmed(b))
    return (F.left(x, F.lit(n)) == F.left(y, F.lit(n))) & (x != "")


def left_off(title_: Column, first_prompt: Column, last_prompt: Column) -> Column:
    """The last prompt, else the first; blank if the title says it already."""
    cue = F.coalesce(F.nullif(last_prompt, F.lit("")), first_prompt)
    return F.when(same_prefix(cue, title_), "").otherwise(cue)


def tsv(c: Column) -> Column:
    """Safe in one field of one line."""
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    # only a text that holds such a character is taken apart, as most don't
    return F.when(~c.rlike(UNDRAWABLE), c).otherwise(F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(UNDRAWABLE), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(x))), 2, "0"))).otherwise(x)), ""))


def tag_words(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")


def clean_tmux_name(c: Column) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_-]", "-"), "^-+|-+$", ""), F.lit(32))


def tmux_name(session_id: Column) -> Column:
    return F.concat(F.lit("mn-"), F.left(clean_tmux_name(session_id), F.lit(8)))


def looks_like_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def _folding() -> tuple[str, str]:
    """Letters with marks and the letters under them, by Unicode's own decompositions."""
    a, b = [], []
    for i in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(i))[0]
        if base != chr(i) and base.isalpha():
            a.append(chr(i))
            b.append(base)
    return "".join(a), "".join(b)


_MARKED, _BARE = _folding()


def fold(c: Column) -> Column:
    """Lower case without marks, as the index reads words."""
    return F.regexp_replace(F.translate(F.lower(c), _MARKED, _BARE), r"\p{M}", "")


def fold_text(s: str) -> str:
    """fold() of a literal."""
    return "".join(x for x in s.lower().translate(str.maketrans(_MARKED, _BARE)) if not unicodedata.category(x).startswith("M"))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


EMOJI = "\ufe0f"


def _cell(c: str) -> int:
    """Terminal cells of a character by itself: wide forms take two, marks none."""
    return 0 if unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1


def _drawn_wide(c: str) -> bool:
    """Whether a selector after it makes a narrow character an emoji of two cells: a symbol, or what a keycap is made of."""
    return (unicodedata.category(c) == "So" or c in "0123456789#*") and _cell(c) == 1


def display_width(s: str) -> int:
    """Terminal cells of a literal."""
    return sum(map(_cell, s)) + sum(b == EMOJI and _drawn_wide(a) for a, b in zip(s, s[1:], strict=False))


@functools.cache
def _cells() -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of code points of equal cells begin, and their cells; 4 marks those that a selector widens."""
    every = np.array([_cell(c) + 4 * _drawn_wide(c) for c in map(chr, range(0x30000))], np.uint8)
    first = np.flatnonzero(np.diff(every, prepend=255))
    tail = [0x30000, 0x3FFFE, 0xE0000, 0xE0200]  # wide planes, then none, tags and selectors of no cell, then none
    return np.concatenate((first, tail)), np.concatenate((every[first], np.array([2, 1, 0, 1], np.uint8)))


def _prefix_cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins among all code points (n + 1), and the cells before each code point."""
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin, cells = _cells()
    kind = cells[np.searchsorted(begin, code, "right") - 1]
    width = (kind & 3).astype(np.int64)
    widened = np.flatnonzero(code == ord(EMOJI))
    widened = widened[(widened > 0) & ~np.isin(widened, starts)]
    width[widened] += kind[widened - 1] >> 2
    return starts, np.concatenate(([0], np.cumsum(width)))


def fitted(c: Column, width: int, pad: bool = False) -> Column:
    """A column's texts cut to so many cells, with an ellipsis; pad: and filled up to them. No character is cut in half."""

    @F.pandas_udf("string")
    def fit(texts: pd.Series) -> pd.Series:
        rows = [t or "" for t in texts]
        starts, before = _prefix_cells(rows)
        out = []
        for t, a, b in zip(rows, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            used = int(before[b] - before[a])
            if used > width:
                n = int(np.searchsorted(before[a : b + 1], before[a] + max(0, width - 1), "right")) - 1 if width > 1 else 0
                t, used = t[:n] + "…" * (width > 0), int(before[a + n] - before[a]) + (width > 0)
            out.append(t + " " * (width - used) if pad else t)
        return pd.Series(out)

    return fit(drawable(c))


def fit_text(s: str, width: int) -> str:
    """A literal cut to so many cells, with an ellipsis."""
    s = "".join(x for x in s if unicodedata.category(x) != "Cc" and x not in "\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069")
    if display_width(s) <= width:
        return s
    if width < 2:
        return "…" * width
    n = len(s)
    while display_width(s[:n]) > width - 1:
        n -= 1
    return s[:n] + "…"


def pad_fit(s: str, width: int) -> str:
    out = fit_text(s, width)
    return out + " " * (width - display_width(out))
