"""Text functions with offsets: spans found by forms in Arrow batches, spans and chunks as columns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from .. import fixed

SPANS = ST.ArrayType(ST.StructType([ST.StructField("start", ST.IntegerType()), ST.StructField("end", ST.IntegerType()), ST.StructField("kind", ST.StringType()), ST.StructField("detector", ST.StringType())]))


#: What every match of a form holds: texts without it are not searched for the form.
HELD = {p: {"regex_iban": ("FR",), "regex_url": ("http", "www.")}[d] for _, d, fold, p in fixed.FORMS if d in ("regex_iban", "regex_url") and not fold}
#: Forms of addresses: their matches are letters, digits and ``_.+-`` around an at sign.
AROUND_AT = frozenset(p for _, d, _, p in fixed.FORMS if d in ("email_institution", "regex_email"))


def _around_at(text: str) -> list[tuple[int, int]]:
    """The longest stretches of what addresses are made of that hold an at sign."""
    out, at = [], text.find("@")
    own = lambda c: c.isalnum() or c in "_.+-@"
    while at >= 0:
        low = high = at
        while low and own(text[low - 1]):
            low -= 1
        while high < len(text) and own(text[high]):
            high += 1
        out.append((low, high))
        at = text.find("@", high)
    return out


def form_spans(text: str, forms=fixed.FORMS) -> list[tuple[int, int, str, str]]:
    text = text or ""
    around, out = _around_at(text), []
    for kind, detector, fold, pattern in forms:
        if pattern in HELD and not any(x in text for x in HELD[pattern]):
            continue
        form = re.compile(pattern, re.IGNORECASE if fold else 0)
        for low, high in around if pattern in AROUND_AT else [(0, len(text))]:
            out += [(m.start(), m.end(), kind, detector) for m in form.finditer(text, low, high)]
    return out


def signature_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Short capitalised lines among the last few, never the first."""
    out, at = [], 0
    lines = (text or "").split("\n")
    for i, line in enumerate(lines):
        own = line.strip()
        if i >= max(1, len(lines) - fixed.SIGNATURE_TAIL) and own and len(own) <= fixed.SIGNATURE_CHARS and not set(own) & set(".!?;:"):
            tokens = own.split()
            if len(tokens) <= 4 and any(t[:1].isupper() for t in tokens):
                start = at + len(line) - len(line.lstrip())
                out.append((start, start + len(own), "nom", "signature"))
        at += len(line) + 1
    return out


def merge_spans(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Overlapping spans as one; the first kind that is not personal wins, else the earlier."""
    out: list[list] = []
    for start, end, kind, detector in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and start < out[-1][1]:
            last = out[-1]
            last[1] = max(last[1], end)
            if last[2] not in fixed.NOT_PERSONAL and kind in fixed.NOT_PERSONAL:
                last[2:] = [kind, detector]
        else:
            out.append([start, end, kind, detector])
    return [tuple(s) for s in out]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    return merge_spans(form_spans(text) + signature_spans(text))


def combine_entities(entities: list[tuple], forms: list[tuple]) -> list[tuple]:
    """Model entities beside the forms; places and institutions that touch a form go."""
    free = [e for e in entities if e[2] not in fixed.NOT_PERSONAL or not any(e[0] < f[1] and f[0] < e[1] for f in forms)]
    return merge_spans(forms + free)


def word_error_rate(reference: str, other: str) -> float:
    a, b = (reference or "").split(), (other or "").split()
    if not a:
        return 0.0 if not b else 1.0
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x], dtype=np.int64) for x in (a, b))
    at = np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a, 1):
        # Edits without insertions of this row; those are a running minimum along it.
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(best - at) + at
    return float(row[-1] / len(a))


@F.pandas_udf(SPANS)
def pii_spans(text: pd.Series) -> pd.Series:
    names = ("start", "end", "kind", "detector")
    return text.map(lambda t: [dict(zip(names, s)) for s in detect(t or "")])


def redact_sql(text: str, spans: str) -> str:
    """SQL for the text with markers for personal spans (start, end, kind, confirmed) that were not
    refused; touching ones are one, by the first kind."""
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    shown = " ".join(f"when {quoted(k)} then {quoted(m)}" for k, m in fixed.MARKERS.items())
    personal = f"filter({spans}, s -> coalesce(s.confirmed, true) and s.kind not in ({', '.join(map(quoted, fixed.NOT_PERSONAL))}))"
    ordered = f"array_sort(transform({personal}, s -> struct(cast(s.start as int) as start, cast(s.`end` as int) as `end`, s.kind as kind)))"
    new = f"concat(a.out, substring({text}, greatest(a.`end`, 0) + 1, s.start - greatest(a.`end`, 0)), case s.kind {shown} else {quoted(fixed.OTHER_MARKER)} end)"
    step = f"struct(if(s.start <= a.`end`, a.out, {new}) as out, if(s.start <= a.`end`, greatest(a.`end`, s.`end`), s.`end`) as `end`)"
    return f"aggregate(coalesce({ordered}, array()), struct('' as out, -1 as `end`), (a, s) -> {step}, a -> concat(a.out, substring({text}, greatest(a.`end`, 0) + 1, length({text}))))"


def redacted(text: str, spans: str) -> Column:
    """``redact_sql`` over two columns, by their names."""
    return F.expr(redact_sql(text, spans))


def chunks(text: Column, limit: int) -> Column:
    """Whole lines packed up to a number of words; longer lines are cut first; a blank text is one
    empty chunk."""
    line = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    cut = lambda words: F.transform(F.sequence(F.lit(0), F.ceil(F.size(words) / limit).cast("int") - 1), lambda i: F.slice(words, i * limit + 1, limit))
    none = F.array().cast("array<array<string>>")
    lines = F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.get(F.transform(F.array(line(x)), lambda words: F.when(F.size(words) > 0, cut(words)).otherwise(none)), 0)))
    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def add(s: Column, words: Column) -> Column:
        own, full = F.array_join(words, " "), s["size"] + F.size(words) > limit
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["size"] == 0), own).otherwise(F.concat(s["open"], F.lit("\n"), own)).alias("open"),
            (F.when(full, 0).otherwise(s["size"]) + F.size(words)).alias("size"),
        )

    return F.aggregate(lines, begin, add, lambda s: F.concat(s["done"], F.array(s["open"])))


@F.pandas_udf(ST.DoubleType())
def wer(reference: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([word_error_rate(a, b) for a, b in zip(reference, other)], dtype="float64")
