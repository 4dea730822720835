"""Sentences, LaTeX, terms, citations and numeric claims as Column expressions.

Character classes are Unicode's ((?U)): a letter with an accent is part of a word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: What a cheap test refuses is tried first: most places are no white space.
GAP = r"(?![!-~])(?=\s)"
BOUNDARY = rf"(?U){GAP}(?<=[.!?])\s+(?=[A-Z])"


#: Characters of a text that mostly hold all its search terms.
START = 256


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def found(text: Column, pattern: str, any_case: bool = False) -> Column:
    return text.rlike(("(?iU)" if any_case else "(?U)") + pattern)


def literals(pattern: str) -> tuple[str, ...]:
    """Strings in lower case of which each match of a pattern has one: the longest run of plain characters,
    or the runs of a group's alternatives. None are given where a pattern is not that simple."""
    found_, run, i = [], "", 0

    def close():
        nonlocal run
        if run:
            found_.append((run.lower(),))
        run = ""

    while i < len(pattern):
        c, j = pattern[i], i + 1
        inner = None
        if c in "|^$.*+?{":
            if c in "|*+?{":
                return ()
            close()
        elif c == "\\":
            j = i + 2
            close()
        elif c == "[":
            j = pattern.index("]", i) + 1
            close()
        elif c == "(":
            close()
            depth = 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[j], 0) if pattern[j - 1] != "\\" else 0
                j += 1
            inner = pattern[i + 1 : j - 1].removeprefix("?:")
        times = re.match(r"[*+?]|\{[^}]*\}", pattern[j:])
        if inner is None and c not in "\\[^$.":
            if times:
                close()
            else:
                run += c
        elif inner is not None and not times and not re.search(r"[()\[]", inner):
            each = [literals(x) for x in inner.split("|")]
            if all(each):
                found_.append(tuple(x for e in each for x in e))
        i = j + (times.end() if times else 0)
    close()
    return max(found_, key=lambda f: min(map(len, f)), default=())


def folded(text: Column) -> Column:
    """Lower case, as patterns in any case see it: four letters beyond ASCII stand for ASCII ones."""
    ascii = F.length(text) == F.octet_length(text)
    return F.lower(F.when(ascii, text).otherwise(F.translate(text, "\u017f\u0131\u0130\u212a", "siik")))


def may_match(low: Column, pattern: str) -> Column | None:
    """Whether a text, `folded` or in lower case, has what each match of a pattern needs; null if not known."""
    any_of = None
    for x in literals(pattern):
        hit = F.contains(low, F.lit(x))
        any_of = hit if any_of is None else any_of | hit
    return any_of


def found_in(low: Column, text: Column, pattern: str, any_case: bool = False) -> Column:
    """`found`, which is slow, only where the folded text may match."""
    may = may_match(low, pattern)
    return found(text, pattern, any_case) if may is None else may & found(text, pattern, any_case)


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def nonempty(parts: Column) -> Column:
    # Most have no space at their ends, which is cheap to see.
    ends = lambda s: F.concat(F.substring(s, 1, 1), F.substring(s, -1, 1))
    return F.filter(F.transform(parts, lambda s: F.when(found(ends(s), r"\s"), strip(s)).otherwise(s)), lambda s: s != "")


def present(parts: Column) -> Column:
    """What is not null. Unlike array_compact, which makes its lambda's variable anew in each copy of a plan,
    it lets Spark see that copies are equal, and reuse an exchange."""
    return F.filter(parts, lambda x: x.isNotNull())


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def sentences(text: Column) -> Column:
    """A document's sentences: citations set off by spaces, cut where a capital follows a full
    stop, and at line ends."""
    text = let(text, lambda t: F.when(F.contains(t, F.lit("\\cite")), F.regexp_replace(t, r"(\\cite[pt]?\{[^}]+\})", " $1 ")).otherwise(t))
    return nonempty(F.split(text, rf"(?U){GAP}(?:(?<=[.!?])\s+(?=[A-Z])|\n)"))


def abstract_sentences(text: Column) -> Column:
    return nonempty(F.split(strip_latex(F.coalesce(text, F.lit(""))), BOUNDARY))


def strip_latex(text: Column) -> Column:
    """Commands give way to their arguments, inline mathematics to its source, braces to spaces."""
    def plain(t: Column) -> Column:
        for pattern, by in ((r"\\textbf\{([^}]*)\}", "$1"), (r"\\textit\{([^}]*)\}", "$1"), (r"\\[a-zA-Z]+\{([^}]*)\}", "$1"), (r"\$([^$]*)\$", "$1"), (r"\\[a-zA-Z]+", " "), (r"[{}]", " ")):
            t = F.regexp_replace(t, pattern, by)
        return t

    some = lambda t: F.contains(t, F.lit("\\")) | F.contains(t, F.lit("$")) | F.contains(t, F.lit("{")) | F.contains(t, F.lit("}"))
    text = let(text, lambda t: F.when(some(t), plain(t)).otherwise(t))
    # Single spaces stay as they are; most places are no white space.
    odd = r"(?![!-~])(?:\s{2,}|[^\S ])"
    return let(text, lambda t: F.trim(F.when(found(t, odd), F.regexp_replace(t, "(?U)" + odd, " ")).otherwise(t)))


def citations(text: Column, patterns=rules.CITATIONS) -> Column:
    """All citations, by pattern and then by place, repeats kept."""
    none = F.array().cast("array<string>")
    first = lambda p: F.lit(p[1] if p[0] == "\\" else p[0])
    return nonempty(F.flatten(F.array(*[F.when(F.contains(text, first(p)), every(text, p, g)).otherwise(none) if re.match(r"\\[^\w]|@", p) else every(text, p, g) for p, g in patterns])))


def one_of(word: Column, words) -> Column:
    return word.isin(list(words))


def search_terms(text: Column, stop=rules.STOP_WORDS, domain=rules.DOMAIN_TERMS, most: int = 8) -> Column:
    """Up to `most` terms: domain terms that only stand inside hyphenated words, words in order of
    first appearance, then capitalised phrases."""

    def words(t: Column) -> Column:
        return F.array_distinct(F.filter(every(F.lower(t), r"(?=[A-Za-z])\b[A-Za-z][A-Za-z0-9_-]{1,}\b"), lambda w: ~one_of(w, stop)))

    def of(plain: Column) -> Column:
        phrases = F.transform(every(plain, r"(?=[A-Z])\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"), F.lower)
        pattern = rf"\b(?:{'|'.join(domain)})\b"
        special = let(F.lower(plain), lambda low: F.when(may_match(low, pattern), F.array_distinct(every(low, pattern))).otherwise(F.array().cast("array<string>")))
        # A phrase has a space, and a word none, so no phrase is among the words.
        whole = lambda s: let(words(plain), lambda w: F.slice(F.concat(F.reverse(F.array_except(s, w)), w, phrases), 1, most))
        # The rest of a long text is read only if its start, up to a space, doesn't settle the terms.
        start = F.substring(plain, 1, START)
        start = F.substring(start, F.lit(1), F.length(start) - F.length(F.substring_index(start, " ", -1)))
        first = F.when(F.length(plain) > START, words(start)).otherwise(F.array().cast("array<string>"))
        settled = lambda f, s: (F.size(f) >= most) & (F.size(F.array_except(s, f)) == 0)
        return let(special, lambda s: let(first, lambda f: F.when(settled(f, s), F.slice(f, 1, most)).otherwise(whole(s))))

    return let(strip_latex(text), of)


def title_terms(text: Column, stop=rules.TITLE_STOP_WORDS) -> Column:
    """Distinct words of three letters or more."""
    words = every(F.lower(strip_latex(text)), r"(?=[A-Za-z])\b[A-Za-z][A-Za-z0-9/-]{1,}\b")
    return F.array_distinct(F.filter(words, lambda w: ~one_of(w, stop) & (F.length(w) > 2)))


def anchor_terms(text: Column, anchors=rules.ANCHORS) -> Column:
    return let(F.lower(strip_latex(text)), lambda t: present(F.array(*[F.when(found_in(t, t, p), F.lit(label)) for label, p in anchors])))


def claims(text: Column) -> Column:
    """Numbers with the percent sign or run of letters after each: array of (value, unit)."""
    pattern = r"(\d+(?:\.\d+)?)\s*(%|[A-Za-zμµ]+)?"
    none = F.array().cast("array<string>")
    some = lambda group: F.when(text.isNotNull() & ~found(text, r"(?=[^ -/:-~])\d"), none).otherwise(every(text, pattern, group))
    return F.arrays_zip(some(1).alias("value"), some(2).alias("unit"))


def snippets(text: Column, around: int = 18) -> Column:
    """What stands around each claim, `around` characters on either side. Matches don't carry their
    places, so the text before each is rebuilt from the pieces between them."""
    pattern = r"\d+(?:\.\d+)?\s*(?:%|[A-Za-zμµ]+)?"

    def of(t: Column) -> Column:
        hits, gaps = every(t, pattern), F.split(t, "(?U)" + pattern)

        def place(h: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, g: a + F.length(g))
            start = F.greatest(F.lit(0), before - around)
            return strip(F.substring(t, start + 1, before + F.length(h) + around - start))

        return F.transform(hits, place)

    return let(text, of)


def inverted_index_text(index: Column) -> Column:
    """The text of a map from word to positions: words by position, equal positions in map order."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    placed = F.transform(pairs, lambda p, i: F.struct(p["at"].alias("at"), i.alias("i"), p["word"].alias("word")))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["word"]), " ")
