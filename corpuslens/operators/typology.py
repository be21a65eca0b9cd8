"""Document typology: position-aware signals as boolean columns, and two decision lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T

NAMES = tuple(dict.fromkeys(name for name, *_ in fixed.SIGNALS))


def signals(text: Column, rules=fixed.SIGNALS) -> dict[str, Column]:
    """One column for each signal; blank texts have none."""
    text = F.coalesce(text, F.lit(""))
    there = T.strip(text) != ""
    tail = F.substring(text, F.greatest(F.length(text) - fixed.CLOSING_CHARS, F.lit(0)) + 1, F.lit(fixed.CLOSING_CHARS))
    zones = {"opening": F.substring(text, 1, fixed.OPENING_CHARS), "closing": tail, "all": text}
    n = F.size(T.words(text))
    plausible = F.regexp_count(text, F.lit(fixed.JAVA_I + fixed.PLAUSIBLE_WORD))
    out = {"texte_illisible": there & (n >= fixed.PLAUSIBLE_MIN) & (plausible / n < fixed.PLAUSIBLE_SHARE), "texte_bref": there & (n <= fixed.SHORT_WORDS)}
    for name, zone, fold, pattern in rules:
        hit = there & zones[zone].rlike((fixed.JAVA_I if fold else fixed.JAVA) + pattern)
        out[name] = out[name] | hit if name in out else hit
    return out


def _named(s: dict[str, Column], *names: str) -> Column:
    return F.array_join(F.filter(F.array(*[F.when(s[n], n) for n in names]), lambda x: x.isNotNull()), "+")


def _any(s: dict[str, Column], *names: str) -> Column:
    out = s[names[0]]
    for n in names[1:]:
        out = out | s[n]
    return out


def support(s: dict[str, Column], recopied: Column) -> tuple[Column, Column]:
    """Kind of document and the signals that decided; the first rule that holds."""
    rules = [
        (s["texte_illisible"], "illisible", F.lit("texte_illisible")),
        (s["transmission"] & s["texte_bref"] & _any(s, "signature_elu", "entete_mairie"), "apparat", _named(s, "transmission", "texte_bref", "signature_elu", "entete_mairie")),
        (F.coalesce(recopied, F.lit(False)), "lettre_type", F.lit("doublon_multi_communes")),
        (s["formulaire"], "formulaire", F.lit("formulaire")),
        (_any(s, "petition", "soussignes_pluriel"), "petition", _named(s, "petition", "soussignes_pluriel")),
        (s["conseil_municipal"] & s["signature_elu"], "deliberation", _named(s, "conseil_municipal", "signature_elu")),
        (_any(s, "appel", "politesse", "objet"), "courrier", _named(s, "appel", "politesse", "objet")),
    ]
    return _first(rules, "registre", "defaut")


def author(s: dict[str, Column]) -> tuple[Column, Column]:
    """Who writes and the signals that decided."""
    together = ("nous_collectif", "organisation", "petition", "soussignes_pluriel")
    alone = ("premiere_personne", "situation_personnelle")
    rules = [
        (s["texte_illisible"], "indetermine", F.lit("texte_illisible")),
        (_any(s, "signature_elu", "conseil_municipal"), "institution", _named(s, "signature_elu", "conseil_municipal")),
        (_any(s, *together), "collectif", _named(s, *together)),
        (_any(s, *alone), "individu", _named(s, *alone)),
    ]
    return _first(rules, "indetermine", "aucun_signal")


def _first(rules: list[tuple[Column, str, Column]], value: str, why: str) -> tuple[Column, Column]:
    v, w = F, F
    for hold, name, reason in rules:
        v, w = v.when(hold, name), w.when(hold, reason)
    return v.otherwise(value), w.otherwise(why)


def classify(docs: DataFrame, rules=fixed.SIGNALS) -> DataFrame:
    """id, axis, value, detector: two rows a document (id, text, recopied)."""
    found = signals(F.col("text"), rules)
    flags = docs.select("id", "recopied", *[c.alias(n) for n, c in found.items()])
    s = {n: F.col(n) for n in found}
    (kind, why), (who, whence) = support(s, F.col("recopied")), author(s)
    axes = F.array(F.struct(F.lit("support").alias("axis"), kind.alias("value"), why.alias("detector")), F.struct(F.lit("auteur").alias("axis"), who.alias("value"), whence.alias("detector")))
    return flags.select("id", F.explode(axes).alias("a")).select("id", "a.*")
