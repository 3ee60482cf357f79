"""Text functions as Column expressions: folding, cleaning, tokens, terms, citations."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.dictionaries import CONNECTIVES, SECTION_KEYWORDS

#: A token: at least two word characters, the first a letter, Unicode-aware.
TOKEN = r"(?U)\b[^\W\d_]\w+\b"


def _base(c: str, form: str) -> str:
    return "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))


@functools.cache
def _canonical() -> tuple[str, str]:
    """Lower-case letters that decompose into one base character and marks, and their bases: a rule, not a list."""
    found = [(c, _base(c, "NFD")) for c in map(chr, (*range(0xA0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000), *range(0x2070, 0x20A0), *range(0x2100, 0x2190), *range(0xFF00, 0xFFF0)))]
    pairs = [(c, base) for c, base in found if len(base) == 1 and base != c and c == c.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Syllables that decompose by arithmetic.
_HANGUL = range(0xAC00, 0xD7A4)


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """How each character folds, by rule: those that become one (or, at the end, none), what they become, and those that
    become several."""
    one, gone, several = [], [], {}
    for c in map(chr, (*range(0x41, 0xAC00), *range(0xF900, 0xFFFE), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20))):
        base = _base(c, "NFKD").casefold()
        if base == "":
            gone.append(c)
        elif len(base) > 1:
            several[c] = base
        elif base != c:
            one.append((c, base))
    return "".join(c for c, _ in one) + "".join(gone), "".join(b for _, b in one), several


def _syllable(c: Column, code: Column) -> Column:
    """A Hangul syllable's letters; null for other characters."""
    at = code - _HANGUL[0]
    letter = lambda first, n, i: F.get(F.split(F.lit("".join(map(chr, range(first, first + n)))), ""), i.cast("int"))
    tail = F.when(at % 28 == 0, "").otherwise(letter(0x11A8, 27, at % 28 - 1))
    return F.when(code.between(_HANGUL[0], _HANGUL[-1]), F.concat(letter(0x1100, 19, F.floor(at / 588)), letter(0x1161, 21, F.floor(at % 588 / 28)), tail))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside another higher-order function."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Case and accents removed, compatibility forms unified: the fold of the rule engines (T1), character by character.

    One pass maps all characters that become one or none. Only texts that hold one of the rest are looked through, and
    there only what isn't ASCII is looked up, by block of 256 and then in the block.
    """
    before, after, several = _folds()
    common = {c: several[c] for c in "ß…"}
    plain = F.translate(text, before, after)
    for c, base in common.items():
        plain = F.replace(plain, F.lit(c), F.lit(base))
    blocks: list[dict[str, str]] = [{} for _ in range(max(map(ord, several)) // 256 + 1)]
    for c, base in several.items():
        blocks[ord(c) >> 8][c] = base
    table = F.from_json(F.lit(json.dumps(blocks)), "array<map<string,string>>")
    other = lambda c, code: F.coalesce(F.try_element_at(F.get(table, F.shiftright(code, 8)), c), _syllable(c, code), c)
    each = lambda t: F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c < "\x80", c).otherwise(let(F.ascii(c), lambda code: other(c, code)))), "")
    rest = "".join(c for c in several if c not in common)
    holds = lambda t: t.rlike("[^\\x00-\\x7F]") & (t.rlike("[\uAC00-\uD7A3]") | (F.char_length(F.translate(t, rest, "")) < F.char_length(t)))
    return let(plain, lambda t: F.when(holds(t), each(t)).otherwise(t))


def fold_collapsed(text: Column) -> Column:
    """T1 with white space collapsed."""
    return collapse(fold(text))


def fold_light(text: Column) -> Column:
    """Lower case without accents, white space collapsed; no compatibility forms, ß stays."""
    return collapse(F.regexp_replace(F.translate(F.lower(text), *_canonical()), r"\p{Mn}", ""))


def fold_citation(text: Column) -> Column:
    """Case folded and white space collapsed, accents kept (T4)."""
    return collapse(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def python_fold(text: str) -> str:
    """T2 for dictionary entries on the driver, exact for all of Unicode."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " ".join(plain.split())


def alternation(terms: Sequence[str]) -> str:
    return r"(?U)\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b"


def has_term(text: Column, term: str) -> Column:
    """Whether a folded term occurs in a folded text as whole tokens; the plain search spares most texts the pattern."""
    return F.contains(text, F.lit(term)) & text.rlike(alternation([term]))


def has_any(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | has_term(text, t)
    return found


def clean(text: Column, connectives: Sequence[str] = CONNECTIVES) -> Column:
    """Lower case, connectives removed as whole words (first listed wins), white space collapsed last (T5)."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return collapse(F.regexp_replace(lowered, alternation(connectives), " ") if connectives else lowered)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


#: Buckets of a word list, so a token is compared with a few of its words only.
WORD_BUCKETS = 64


def without_words(found: Column, words: Sequence[str]) -> Column:
    """The array without the listed words."""
    if not words:
        return found
    buckets: list[list[str]] = [[] for _ in range(WORD_BUCKETS)]
    for w in sorted(set(words)):
        buckets[zlib.crc32(w.encode()) % WORD_BUCKETS].append(w)
    table = F.split(F.lit("\n".join(" ".join(b) for b in buckets)), "\n")
    own = lambda t: F.get(table, F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(WORD_BUCKETS)).cast("int"))
    return F.filter(found, lambda t: ~F.contains(F.concat(F.lit(" "), own(t), F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))


def ngrams(found: Column, low: int, high: int) -> Column:
    """All runs of low to high tokens, joined by a space (n-grams of the filtered sequence)."""
    if (low, high) == (1, 1):
        return found

    def run(t: Column, n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, every).otherwise(F.array().cast("array<string>"))

    def runs(t: Column) -> Column:
        parts = [run(t, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return let(found, runs)


def has_keyword(text: Column, keywords: Sequence[str] = SECTION_KEYWORDS) -> Column:
    """Whether a keyword occurs as whole tokens, whatever its case and accents."""
    return let(fold_collapsed(F.coalesce(text, F.lit(""))), lambda t: has_any(t, [python_fold(k) for k in keywords]))


def occurrences(text: Column, term: str) -> Column:
    """Start offsets (from 0) of all occurrences, overlapping ones too."""
    parts = F.split(text, f"(?={re.escape(term)})", -1)
    starts = F.aggregate(parts, F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")), lambda s, p: F.struct(F.concat(s["at"], F.array(s["n"])).alias("at"), (s["n"] + F.char_length(p)).alias("n")), lambda s: s["at"])
    return F.filter(starts, lambda s: F.substr(text, s + 1, F.lit(len(term))) == term)


def citation_page(quote: Column, text: Column) -> Column:
    """1-based page (line-feed separated) of the quote's first character, or null.

    Both are folded by T4; pages are folded one by one, and the page is the first whose folded end reaches the hit.
    """
    return let(fold_citation(quote), lambda needle: folded_citation_page(needle, fold_citation(text), text))


def folded_citation_page(needle: Column, folded: Column, text: Column) -> Column:
    """citation_page() of a quote and a text that are folded already."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("page"), F.lit(0).alias("found"))

    def step(s: Column, n: Column, at: Column) -> Column:
        end = s["end"] + F.when(n > 0, n + F.when(s["end"] > 0, 1).otherwise(0)).otherwise(0)
        page = s["page"] + 1
        return F.struct(end.alias("end"), page.alias("page"), F.when((s["found"] == 0) & (end >= at), page).otherwise(s["found"]).alias("found"))

    def page_of(at: Column) -> Column:
        lengths = F.transform(F.split(text, "\n"), lambda p: F.char_length(fold_citation(p)))
        return F.when(at > 0, F.aggregate(lengths, zero, lambda s, n: step(s, n, at), lambda s: s["found"]))

    return F.when(needle != "", let(F.position(needle, folded), page_of))


def evidence(text: Column, position: Column, window: int) -> Column:
    """The text from window characters before a position (from 1) to window after it, collapsed (T18). The position is
    that in the folded text, by design."""
    start = F.greatest(position - window, F.lit(1))
    return collapse(F.substr(text, start, position + window - start))


def anchor_evidence(anchor: Column, limit: int = 160) -> Column:
    """T17."""
    return F.substring(collapse(anchor), 1, limit)
