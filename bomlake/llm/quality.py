"""Line-first quality rules, on DataFrame functions only.

Each line is judged alone: symbols and decoration, navigation, shouting, boilerplate; and menus, MENU or more
lines of few words in a row that end without punctuation. Lines that fail go; a document that loses more than
`max_lost` of its words that way, or fails a base rule, is rejected. Boilerplate is a parameter, a pattern; its
default has English phrases.

Defined results: a null text is an empty one and fails the base rule on length; a line without words is
neither judged nor lost; equal lines count as duplicates but each is judged for itself; other columns,
whatever their names, pass through clean() unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once, unused

#: Fixed values of the contract.
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Line rules: a share of words (in per cent) from which a line fails, and words from which a share is meaningful.
DECORATED, SHOUTED, LEAST = 30, 60, 4
#: Phrases of lines that sites repeat on every page; a line of at most BOILERPLATE_WORDS words with one fails.
BOILERPLATE = r"(?i)cookie|copyright|all rights reserved|terms of (use|service)|privacy policy|lorem ipsum|javascript|click here|read more|subscribe|sign up|log ?in"
BOILERPLATE_WORDS = 12
#: What every line that fails by its words has: a cheap test before words are looked at.
SIGNS = r"[#*$%&|<>~^_=»·/]|::|!!|[A-Z]{2}"
#: Lines in a row that make a menu, each of so many words and characters at most.
MENU, MENU_WORDS, MENU_CHARS = 3, 3, 40
ENDS = r"[.!?;:,\"')\]\u2026\u3002\uff01\uff1f\u00bb\u201d]\s*\z"
#: Share of a document's words that lines may lose before it is rejected, in per cent.
MAX_LOST = 30


def words_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in windows that occur twice or more. Hashes bring windows together; their words are compared."""

    def window(i):
        return F.slice(words, i + 1, WINDOW)

    def joined(hashes, step):
        return F.zip_with(hashes, F.slice(hashes, step + 1, F.size(hashes)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))

    def covered(found):
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (window(x["i"]) == window(y["i"])), F.lit(False))
        places = F.sort_array(F.filter(found, lambda x, k: same(x, F.get(found, k - 1)) | same(x, F.get(found, k + 1)))["i"])
        return once(places, lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p) + 1), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x))

    def counted(hashes):
        exact = once(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), exact).otherwise(0)

    # of one word, of two, of four, of eight
    eight = once(F.transform(words, lambda w: F.xxhash64(w)), lambda one: once(joined(one, 1), lambda two: once(joined(two, 2), lambda four: joined(four, 4))))
    full = once(eight, lambda h: F.slice(h, 1, F.size(h) - (WINDOW - 1)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(once(full, counted)).cast("long")


def line_fails(line: Column, boilerplate: str = BOILERPLATE) -> Column:
    """The rules on one line; lines of few words fail only as boilerplate or bare decoration."""

    def share(words, rule, least):
        return 100 * F.size(F.filter(words, rule)) > least * F.size(words)

    def judged(words):
        decorated = share(words, lambda w: w.rlike(r"[#*$%&|<>~^_=]{2}|[#*$%&|<>]$"), DECORATED)
        shouted = share(words, lambda w: w.rlike("!!|^[^a-z]*$") & w.rlike("[A-Z]{2}|!!"), SHOUTED)
        navigation = share(words, lambda w: w.rlike(r"^(\||>|»|·|/|::)+$"), 20)
        return (F.size(words) >= LEAST) & (decorated | shouted | navigation)

    by_words = line.rlike(SIGNS) & once(words_of(line), judged)
    return by_words | (few_words(line, BOILERPLATE_WORDS) & line.rlike(boilerplate))


def few_words(line: Column, most: int) -> Column:
    """Whether a line has so many words at most; reads no further than it must."""
    gap = WORD.replace("^", "")
    return line.rlike(f"^{gap}*+(?:{WORD}++{gap}++){{0,{most - 1}}}+(?:{WORD}++)?{gap}*+\\z")


def menu_line(line: Column) -> Column:
    return (F.length(line) <= MENU_CHARS) & line.rlike(WORD) & few_words(line, MENU_WORDS) & ~line.rlike(ENDS)


def good_lines(lines: Column, boilerplate: str) -> Column:
    """Lines that no rule fails."""

    def kept(flags):
        in_menu = lambda i: F.get(flags, i) & reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.coalesce(F.get(flags, i + k - j), F.lit(False)) for j in range(MENU) if j != k]) for k in range(MENU)])
        return F.filter(lines, lambda x, i: ~(in_menu(i) | line_fails(x, boilerplate)))

    return once(F.transform(lines, menu_line), kept)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def judged(text: Column, max_lost: int, boilerplate: str = BOILERPLATE) -> Column:
    """struct of the contract's counts, base_failed, n_lost_words, kept and cleaned (the text without failing lines)."""

    def measured(t):
        counts = lambda words: lambda lines: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.when(t.rlike(f"[{SYMBOLS}]"), F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
            once(F.filter(lines, lambda x: x.rlike(WORD)), lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            once(good_lines(lines, boilerplate), lambda good: F.when(F.size(good) == F.size(lines), t).otherwise(F.array_join(good, "\n"))).alias("cleaned"),
        )
        return once(once(words_of(t), lambda words: once(lines_of(t), counts(words))), lambda m: with_losses(m, t))

    def with_losses(m, t):
        lost = F.when(F.length(m["cleaned"]) == F.length(t), 0).otherwise(m["n_words"] - F.size(words_of(m["cleaned"]))).cast("long")
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT * m["n_words"])
        own = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned")]
        return once(F.struct(*own, failed.alias("base_failed"), lost.alias("n_lost_words")), verdict)

    def verdict(m):
        kept = ~m["base_failed"] & (100 * m["n_lost_words"] <= max_lost * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "base_failed", "n_lost_words")], kept.alias("kept"))

    return once(F.coalesce(text.cast("string"), F.lit("")), measured)


def verdicts(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST, boilerplate: str = BOILERPLATE, name: str | None = None) -> DataFrame:
    """Adds a struct, see judged(), as `quality`, with underscores after it if there is such a column. A generator makes it, so filters and fields above don't compute it again."""
    return docs.select("*", F.explode_outer(F.array(judged(docs[text], max_lost, boilerplate))).alias(name or unused(docs, "quality")))


def clean(docs: DataFrame, text: str = "text", max_lost: int = MAX_LOST, boilerplate: str = BOILERPLATE) -> DataFrame:
    """Documents that pass, with failing lines taken out of their texts."""
    name = unused(docs, "quality")
    kept = verdicts(docs, text, max_lost, boilerplate, name).filter(F.col(name)["kept"])
    return kept.select(*[F.col(name)["cleaned"].alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
