"""Text as column expressions: folding, words, shingles, cleaning, repetition, fingerprints."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

SPACE = r"(?U)\s+"
#: Beyond it no character decomposes to ASCII ones, and none is a combining mark.
LAST = 0x20000


def _plain(c: str) -> str:
    """A character's compatibility decomposition without its combining marks, in lower case."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one ASCII letter or digit, and that; those that decompose to
    several characters with some of these among them (ligatures, fractions, units), and what to."""
    src, dst, wide = [], [], {}
    for code in range(0x80, LAST):
        c = chr(code)
        if unicodedata.decomposition(c) or c != c.lower():
            plain = _plain(c)
            if any(x.isascii() and x.isalnum() for x in plain):
                if len(plain) == 1:
                    src.append(c)
                    dst.append(plain)
                else:
                    wide[c] = plain
    return "".join(src), "".join(dst), wide


def _class(chars: list[str]) -> str:
    """The ranges of some characters, for a regular expression's class."""
    out: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if out and code == out[-1][1] + 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


_FROM, _TO, _WIDE = _decompositions()
_WIDE_CLASS = _class(list(_WIDE))
_MARKS = _class([chr(c) for c in range(0x80, LAST) if unicodedata.combining(chr(c)) or unicodedata.decomposition(chr(c)) and not _plain(chr(c))])
#: Characters outside the usual ones, of which none decomposes to several or is a rarer mark.
_RARE = r"[^\x00-\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u01c3\u0300-\u036f\u2010-\u2027\u20ac]"


def _spread(c: Column) -> Column:
    """With characters that decompose to several in place of these, and without rarer marks."""
    table = F.expr(f"map({', '.join(f'{chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)}' for k, v in _WIDE.items())})")
    parts = F.regexp_extract_all(F.regexp_replace(c, f"[{_MARKS}]+", ""), F.lit(f"[{_WIDE_CLASS}]|[^{_WIDE_CLASS}]+"), 0)
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def fold(c: Column) -> Column:
    """Lower case, decomposed as far as letters and digits go (NFKD), without combining marks; of an
    ASCII text that is its lower case."""
    spread = F.when(c.rlike(_RARE), _spread(c)).otherwise(c)
    plain = F.regexp_replace(F.translate(F.lower(F.translate(spread, _FROM, _TO)), _FROM, _TO), "[\\u0300-\\u036f]", "")
    return F.when(c.rlike(r"[^\x00-\x7f]"), plain).otherwise(F.lower(c))


def fold_sql(name: str) -> str:
    """``fold`` of a column by name, as SQL."""
    table = ", ".join(f"'{k}', '{v}'" for k, v in _WIDE.items())
    parts = f"regexp_extract_all(regexp_replace({name}, r'[{_MARKS}]+', ''), r'[{_WIDE_CLASS}]|[^{_WIDE_CLASS}]+', 0)"
    spread = f"case when {name} rlike r'{_RARE}' then array_join(transform({parts}, x -> coalesce(try_element_at(map({table}), x), x)), '') else {name} end"
    return f"regexp_replace(translate(lower(translate({spread}, '{_FROM}', '{_TO}')), '{_FROM}', '{_TO}'), r'[\\u0300-\\u036f]', '')"


def fold_word(word: str) -> str:
    """What ``fold`` makes of a word, on the driver."""
    plain = "".join(_WIDE.get(c, c) for c in word).translate(str.maketrans(_FROM, _TO)).lower()
    return "".join(c for c in plain.translate(str.maketrans(_FROM, _TO)) if not unicodedata.combining(c))


def normalise(c: Column) -> Column:
    """Folded runs of letters and digits, one space between."""
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def _with(value: Column, body) -> Column:
    """The body over a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _runs(tokens: Column, width: int) -> Column:
    n = F.size(tokens)
    each = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, width), " "))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def _normal_words(c: Column) -> Column:
    return F.filter(F.split(normalise(c), " "), lambda w: w != "")


def shingles(c: Column, width: int = fixed.SHINGLE_WORDS) -> Column:
    """Distinct runs of normalised words; a shorter text is one; a blank one has none."""
    return _with(_normal_words(c), lambda tokens: _runs(tokens, width))


def shingle_counts(c: Column, width: int = fixed.SHINGLE_WORDS) -> Column:
    """words and shingles of a text, as a struct; the text is normalised once."""
    return _with(_normal_words(c), lambda tokens: F.struct(F.size(tokens).alias("words"), F.size(_runs(tokens, width)).alias("shingles")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def clean_page(c: Column) -> Column:
    """Line ends as \\n, inner white space of a line as one space, lines and text stripped."""
    unified = F.regexp_replace(c, "\r\n?", "\n")
    lines = F.transform(F.split(unified, "\n"), lambda x: strip(F.regexp_replace(x, SPACE, " ")))
    return strip(F.array_join(lines, "\n"))


def strip_markdown(c: Column) -> Column:
    """What follows a chain of thought, without headings, images, emphasis and code marks."""
    rest = F.element_at(F.split(c, "</think>"), -1)
    for pattern in (r"!\[[^\]]*\]\([^)]*\)", r"(?m)^#{1,6}\s*", r"\*\*|__|`"):
        rest = F.regexp_replace(rest, pattern, "")
    return strip(rest)


def html_text(c: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments, tags and entities."""
    text = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), "&nbsp;", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_empty_page_comment(c: Column) -> Column:
    return (F.length(c) <= fixed.EMPTY_PAGE_CHARS) & c.rlike(fixed.JAVA_I + fixed.EMPTY_PAGE)


def repetition(c: Column) -> Column:
    """words, grams, distinct_grams, lines, distinct_lines of a text, as a struct; grams are told
    apart by 64-bit hashes."""

    def grams(tokens: Column) -> Column:
        n = F.size(tokens)
        each = F.transform(F.sequence(F.lit(1), F.greatest(n - fixed.GRAM_WIDTH + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, fixed.GRAM_WIDTH)))
        some = n >= fixed.GRAM_WIDTH
        return F.struct(n.alias("words"), F.when(some, F.size(each)).otherwise(0).alias("grams"), F.when(some, F.size(F.array_distinct(each))).otherwise(0).alias("distinct_grams"))

    def lines(own: Column) -> Column:
        return F.struct(F.size(own).alias("lines"), F.size(F.array_distinct(own)).alias("distinct_lines"))

    g = _with(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != ""), grams)
    x = _with(F.filter(F.transform(F.split(c, "\n"), strip), lambda v: v != ""), lines)
    return _with(F.struct(g.alias("g"), x.alias("x")), lambda s: F.struct(s["g"]["words"].alias("words"), s["g"]["grams"].alias("grams"), s["g"]["distinct_grams"].alias("distinct_grams"), s["x"]["lines"].alias("lines"), s["x"]["distinct_lines"].alias("distinct_lines")))


def drifts(r: Column, length: Column) -> Column:
    """Whether a text of that repetition and length is too long for a page, or its words or lines
    go round in circles."""
    return (
        (length > fixed.MAX_PAGE_CHARS)
        | (r["words"] > fixed.MAX_PAGE_WORDS)
        | ((r["words"] >= fixed.GRAM_WORDS) & (r["distinct_grams"] / r["grams"] < fixed.GRAM_RATIO))
        | ((r["lines"] >= fixed.LINE_COUNT) & (r["distinct_lines"] / r["lines"] < fixed.LINE_RATIO))
    )


def is_drift(c: Column) -> Column:
    return _with(repetition(c), lambda r: drifts(r, F.length(c)))


def quality_words(c: Column) -> Column:
    """Words of three characters or more, in lower case, that keep three letters (of a to z and those
    with accents) when everything else in them goes."""
    long = F.filter(words(c), lambda w: F.length(w) > 2)
    return F.filter(F.transform(long, lambda w: F.regexp_replace(F.lower(w), "[^a-zà-ÿ]", "")), lambda w: F.length(w) > 2)


def quality_score(c: Column, lexicon: Column) -> Column:
    """Share of the longer words that a small lexicon (array of words) holds; 0 without such words."""
    share = lambda tokens: F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(F.filter(tokens, lambda w: F.array_contains(lexicon, w))) / F.size(tokens))
    return _with(quality_words(c), share)


def needs_ocr(c: Column, score: Column, threshold: float = fixed.QUALITY_THRESHOLD) -> Column:
    return (strip(F.coalesce(c, F.lit(""))) != "") & (score < threshold)


def fingerprint(c: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the text with single spaces."""
    return F.substring(F.sha2(strip(F.regexp_replace(c, SPACE, " ")), 256), 1, 16)


def category(name: Column) -> Column:
    code = F.upper(F.substring(name, 1, 2))
    return F.when((F.substring(name, 3, 1) == "_") & code.isin(*fixed.CATEGORIES), code)


def natural_key(c: Column) -> Column:
    """Digit runs padded, so that names sort as people count."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("[0-9]+|[^0-9]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


#: Fixed value: the header of a register, name then code.
CITY_HEADER = r"Cahier\s+citoyen\s*\n\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\-\s]+?)\s*-\s*\d{5}\s*\n\s*\d{5}"


def find_city(c: Column) -> Column:
    found = F.regexp_extract(c, fixed.JAVA_I + CITY_HEADER, 1)
    return F.nullif(F.upper(strip(found)), F.lit(""))


def l2_normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def character_error_rate(reference: Column, other: Column) -> Column:
    """Edits over the reference's length; an empty reference gives 0 or 1."""
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(other) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, other) / n)


def embedding_words(c: Column, stop_words: Column) -> Column:
    """Folded words of two letters or more that are no stop words, joined by spaces."""
    tokens = F.split(normalise(F.regexp_replace(F.regexp_replace(c, "œ", "oe"), "æ", "ae")), " ")
    return F.array_join(F.filter(tokens, lambda w: (F.length(w) > 1) & ~F.array_contains(stop_words, w)), " ")


def document_key(level: Column, ident: Column) -> Column:
    """'42' for page level, 'd42' for document level."""
    return F.concat(F.when(level == "doleance", "d").otherwise(""), ident.cast("string"))


def parse_document_key(c: Column) -> Column:
    level = F.when(c.rlike("^d[0-9]+$"), "doleance").when(c.rlike("^[0-9]+$"), "contribution")
    return F.struct(level.alias("level"), F.regexp_extract(c, "([0-9]+)$", 1).try_cast("long").alias("id"))


def _first_place(folded: Column, word: str) -> Column:
    """Where a word of the folded text begins like this one, or like the longest beginning of it
    that is there; null without any."""
    starts = [F.regexp_instr(folded, F.lit(rf"(?U)\b{word[:n]}")) for n in range(len(word), fixed.MIN_PREFIX - 1, -1)]
    return F.coalesce(*[F.nullif(s, F.lit(0)) for s in starts], F.lit(None).cast("int"))


def excerpt(c: Column, words: list[str], width: int = fixed.WINDOW_CHARS) -> Column:
    """About ``width`` characters around the first of the folded words, a third of them before
    it, from blank to blank where one is near; short texts whole, null and blank ones empty."""
    edge, before = fixed.EDGE_CHARS, width // 3

    def around(x: Column) -> Column:
        text, n = x["text"], F.length(x["text"])
        low = F.greatest(x["at"] - before, F.lit(0))
        back = F.length(F.substring_index(F.substring(text, F.lit(1), low), " ", -1))
        start = low - F.when(back <= edge, back).otherwise(0)

        def until(start: Column) -> Column:
            aim = F.least(n, F.greatest(start, x["at"] - before) + width)
            ahead = F.length(F.substring_index(F.substring(text, aim + 1, n), " ", 1))
            end = aim + F.when(ahead <= edge, ahead).otherwise(0)
            return _with(end, lambda end: F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, " …").otherwise("")))

        return _with(start, until)

    def place(folded: Column) -> Column:
        return F.coalesce(F.array_min(F.array(*[_first_place(folded, w) for w in words])), F.lit(1)) - 1 if words else F.lit(0)

    def window(text: Column) -> Column:
        return F.when(F.length(text) <= width, text).otherwise(_with(F.struct(text.alias("text"), _with(fold(text), place).alias("at")), around))

    return _with(strip(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")), window)
