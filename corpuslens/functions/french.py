"""French words to stems: the published Snowball rules over unaccented words, and stop words.

Words come folded (lower case, without accents), as the search configuration folds them before
it stems; so rules for accented endings never apply and are not stated.
"""

from __future__ import annotations

import re

# ---- fixed values: the usual French stop words; accented ones are never met after folding
STOP_WORDS = frozenset(
    """au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me mes moi mon ne nos notre nous on
    ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y
    suis es est sommes sont serai seras sera serons serez seront serais serait serions seriez seraient fus fut furent
    sois soit soyons soyez soient fusse fusses fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai
    as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions
    aviez avaient eut eurent aie aies ait ayons ayez aient eusse eusses eussions eussiez eussent""".split()
)

# ---- fixed values: endings of the stemmer's steps; capitals are letters that are no vowels where they stand
VOWELS = "aeiouy"
STANDARD = {
    "delete in R2": "ance iqUe isme able iste eux ances iqUes ismes ables istes",
    "ic": "atrice ateur ation atrices ateurs ations",
    "log": "logie logies",
    "u": "usion ution usions utions",
    "ent": "ence ences",
    "adverb": "ement ements",
    "if": "if ive ifs ives",
    "eau": "eaux",
    "al": "aux",
    "eux": "euse euses",
    "noun": "issement issements",
    "amment": "amment",
    "emment": "emment",
    "ment": "ment ments",
}
I_VERBS = "i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
E_VERBS = "er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
A_VERBS = "a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"
REGION_STARTS = ("par", "col", "tap")
DOUBLED = ("enn", "onn", "ett", "ell", "eill")


def _longest(endings: dict[str, str]) -> tuple[re.Pattern, dict[str, str]]:
    """A pattern for the longest of the endings, and the rule of each."""
    rule = {e: name for name, words in endings.items() for e in words.split()}
    return re.compile(f"(?:{'|'.join(sorted(rule, key=lambda e: (-len(e), e)))})$"), rule


_STANDARD, _RULE = _longest(STANDARD)
_I, _ = _longest({"i": I_VERBS})
_VERBS, _VERB = _longest({"ions": "ions", "e": E_VERBS, "a": A_VERBS})
_RESIDUAL, _ = _longest({"": "ion ier Ier e"})
_MARKS = ((re.compile(r"(?<=[aeiouy])([ui])(?=[aeiouy])"), str.upper), (re.compile(r"(?<=q)u"), str.upper), (re.compile(r"(?<=[aeiou])y|y(?=[aeiou])"), str.upper))
_AFTER = re.compile(f"[{VOWELS}][^{VOWELS}]")


def _regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    first = _AFTER.search(word)
    r1 = first.end() if first else len(word)
    second = _AFTER.search(word, r1)
    r2 = second.end() if second else len(word)
    if re.match(f"[{VOWELS}]{{2}}.", word) or word.startswith(REGION_STARTS):
        return min(3, len(word)), r1, r2
    vowel = re.compile(f"[{VOWELS}]").search(word, 1)
    return (vowel.end() if vowel else len(word)), r1, r2


def _without(word: str, ending: str, region: int, other: str = "") -> str:
    """The word with its ending replaced if that lies in the region."""
    return word[: -len(ending)] + other if word.endswith(ending) and len(word) - len(ending) >= region else word


def _standard(word: str, rv: int, r1: int, r2: int) -> tuple[str, bool]:
    """Step 1: the word, and whether verb endings are still to be looked for."""
    found = _STANDARD.search(word)
    if not found:
        return word, True
    ending, at = found[0], found.start()
    rule = _RULE[ending]
    if rule in ("delete in R2", "ic", "if"):
        if at < r2:
            return word, True
        out = word[:at]
        if rule == "if" and out.endswith("at") and len(out) - 2 >= r2:
            out, rule = out[:-2], "ic"
        if rule == "ic" and out.endswith("ic"):
            out = out[:-2] if len(out) - 2 >= r2 else out[:-2] + "iqU"
        return out, False
    if rule in ("log", "u", "ent"):
        return (word[:at] + rule, False) if at >= r2 else (word, True)
    if rule == "adverb":
        if at < rv:
            return word, True
        out = word[:at]
        if out.endswith("iv") and len(out) - 2 >= r2:
            return _without(out[:-2], "at", r2), False
        if out.endswith("eus"):
            return (out[:-3] if len(out) - 3 >= r2 else _without(out, "eus", r1, "eux")), False
        if out.endswith(("abl", "iqU")):
            return (out[:-3] if len(out) - 3 >= r2 else out), False
        return out, False
    if rule == "eau":
        return word[:at] + "eau", False
    if rule == "al":
        return (word[:at] + "al", False) if at >= r1 else (word, True)
    if rule == "eux":
        return (word[:at], False) if at >= r2 else (word[:at] + "eux", False) if at >= r1 else (word, True)
    if rule == "noun":
        return (word[:at], False) if at >= r1 and at and word[at - 1] not in VOWELS else (word, True)
    if rule in ("amment", "emment"):
        return (word[:at] + {"amment": "ant", "emment": "ent"}[rule], True) if at >= rv else (word, True)
    return (word[:at], True) if at - 1 >= rv and word[at - 1] in VOWELS else (word, True)


def _verb(word: str, rv: int, r2: int) -> str:
    """Steps 2a and 2b, within RV."""
    found = _I.search(word, rv)
    if found and found.start() - 1 >= rv and word[found.start() - 1] not in VOWELS:
        return word[: found.start()]
    found = _VERBS.search(word, rv)
    if not found:
        return word
    rule, out = _VERB[found[0]], word[: found.start()]
    if rule == "ions":
        return out if found.start() >= r2 else word
    return _without(out, "e", rv) if rule == "a" else out


def stem(word: str) -> str:
    marked = word
    for pattern, change in _MARKS:
        marked = pattern.sub(lambda m: change(m[0]), marked)
    rv, r1, r2 = _regions(marked)
    out, verbs = _standard(marked, rv, r1, r2)
    changed = out != marked
    if verbs:
        ended = _verb(out, min(rv, len(out)), r2)
        changed = ended != out or changed and ended != marked
        out = ended
    if changed:
        out = out[:-1] + "i" if out.endswith("Y") else out
    else:
        if out.endswith("s") and len(out) > 1 and out[-2] not in "aious":
            out = out[:-1]
        found = _RESIDUAL.search(out, min(rv, len(out)))
        if found and found[0] == "ion":
            if found.start() >= r2 and found.start() - 1 >= rv and out[found.start() - 1] in "st":
                out = out[: found.start()]
        elif found:
            out = out[: found.start()] + ("i" if found[0] != "e" else "")
    if out.endswith(DOUBLED):
        out = out[:-1]
    return out.lower()
