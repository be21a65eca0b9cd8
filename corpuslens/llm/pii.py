"""Personal data: fixed forms, and bootstrapped contextual extraction, in DataFrame functions only.

E-mail addresses, IP numbers, card and phone numbers found by fixed forms are the seeds.
Every seed and every other token that looks like an identifier is an instance; the words
around it are its patterns.  Patterns and instances score each other over the bipartite
graph for a few rounds; instances that confident patterns pick out become new spans of the
kind their patterns stand for.

Spans are of code points, end exclusive.  Defined results: null and empty texts have no
spans; repeated and null doc_ids are each answered; other columns are ignored; an empty
table gives no rows; whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import kept, only

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts from so many different seeds on; a new instance is taken from this score on.
PATTERN_SEEDS, PATTERN_CONFIDENCE, INSTANCE_SCORE = 3, 0.8, 0.9

# One-character stand-ins keep offsets and make every run a single character class:
# \x01 joins digits of a card, \x02 is a dot between two labels.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+\x02-]))[A-Za-z0-9._%+\x02-]++@[A-Za-z0-9-]++\x02[A-Za-z0-9\x02-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9\x01]{12,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: What looks like an identifier, between white space (longer tokens are no identifiers): groups of digits with single blanks; up to
#: 64 characters with a digit near their start; and those with an at sign, plain or in brackets.
GROUPS = r"(?<!\S)[+(\[\"']{0,2}[0-9]{2,8}[)]?(?:[\x20./-][(]?[0-9]{2,8}[)]?){1,7}+(?![^\s,.;:!?)\]\"'])"
CANDIDATE = GROUPS + r"|(?<!\S)(?=[^\s0-9]{0,32}[0-9]{3})\S{6,64}(?!\S)|(?<!\S)(?=[^\s@]{1,32}@|[^\s\[(]{1,32}[\[(]at[\])])\S{6,64}(?!\S)"
#: What is around an identifier, without brackets that its first digits are in.
TRIM = r"^((?:[^A-Za-z0-9(]|[(](?![0-9]+[)]))*)(.*?)[^A-Za-z0-9]*$"
#: Matches that are placed one after the other before the next part.
PART = 128
SPANS = "array<struct<start:int,rank:int,end:int,hit:string>>"


def _found(text: Column, form: str) -> Column:
    """start, end and string of every match: lengths of what lies between and of the hits."""
    hits = F.regexp_extract_all(text, F.lit(form), 0)
    pairs = F.zip_with(hits, F.split(text, form, -1), lambda h, gap: F.struct(h.alias("hit"), F.length(gap).alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def add(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    def placed(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), add, lambda s: s["out"])

    def several(found: Column) -> Column:
        """Part by part, so that the array that grows stays short however many matches there are."""
        part = lambda k: F.slice(found, k * PART + 1, PART)
        size = lambda k: F.aggregate(part(k), F.lit(0), lambda n, x: n + x["gap"] + F.length(x["hit"]))
        numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / PART).cast("int"))
        begins = F.aggregate(numbers, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, k: F.struct((s["at"] + size(k)).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])
        return F.flatten(F.transform(begins, lambda at, k: placed(part(k), at)))

    # Each step names the array once, so it is worked out once.
    some = F.filter(pairs, lambda x: x["hit"].isNotNull())
    return F.get(F.transform(F.array(some), lambda found: F.when(F.size(found) <= PART, placed(found, F.lit(0))).otherwise(several(found))), 0)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms, by start, then kind as listed."""
    plain = F.translate(text, "\x01\x02", "??")
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", "\x02")
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")
    email = F.when(F.contains(text, F.lit("@")), _found(dotted, EMAIL))
    ip = F.filter(_found(plain, IP), lambda m: F.forall(F.split(m["hit"], r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m["hit"], r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+(?=[0-9])", ""), 1, 3).cast("int"), F.lit(0)) <= 255))
    card = F.filter(_found(joined, CARD), lambda m: F.length(_digits(m["hit"])).between(12, 19) & _luhn(_digits(m["hit"])))
    phone = F.filter(_found(plain, PHONE), lambda m: F.length(_digits(m["hit"])).between(9, 15))
    number = text.rlike("[0-9]")
    parts = [email, F.when(number & F.contains(text, F.lit(".")), ip), F.when(number, card), F.when(F.contains(text, F.lit("+")), phone)]
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def ranked(k: int) -> Column:
        return F.transform(F.coalesce(parts[k], none), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("rank"), m["end"].alias("end"), F.translate(m["hit"], "\x01\x02", " .").alias("hit")))

    return F.array_sort(F.concat(*[ranked(k) for k in range(len(parts))])).cast(SPANS)


def _context(text: Column, start: Column, end: Column) -> Column:
    """Lower-cased words just before and after, two at most, digits as 0; ^ and $ are the text's ends."""
    low = F.greatest(start - 48, F.lit(0))
    left = F.concat(F.when(low == 0, F.lit("^ ")).otherwise(""), F.lower(F.substring(text, low + 1, start - low)))
    right = F.concat(F.lower(F.substring(text, end + 1, F.lit(48))), F.when(F.length(text) <= end + 48, F.lit(" $ ")).otherwise(""))
    before = F.regexp_extract(left, r"((?:(?<!\S)\S+\s+)?(?<!\S)\S+)\s*[\"'(\[]*$", 1)
    after = F.regexp_extract(right, r"^[^\sA-Za-z0-9]*\s*(\S+(?:\s+\S+(?=\s))?)(?=\s)", 1)
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[0-9]", "0")
    return F.struct(plain(before).alias("before"), plain(after).alias("after"))


def _instances(text: Column, base: Column) -> Column:
    """Seeds, and tokens like identifiers that touch no seed, with their surroundings."""
    trimmed = lambda m: F.regexp_extract(m["hit"], TRIM, 2)
    lead = lambda m: F.length(F.regexp_extract(m["hit"], TRIM, 1))
    own = F.transform(_found(text, CANDIDATE), lambda m: F.struct((m["start"] + lead(m)).alias("start"), F.lit(-1).alias("rank"), (m["start"] + lead(m) + F.length(trimmed(m))).alias("end"), trimmed(m).alias("hit")))
    free = F.filter(own, lambda m: (F.length(m["hit"]) >= 6) & ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    each = F.concat(base, F.when(text.rlike(r"[0-9]{3}|[0-9]{2}[)]?[\x20./-][(]?[0-9]{2}|@|[\[(]at[\])]"), free).otherwise(F.array().cast(SPANS)))
    return F.transform(each, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"), F.lower(m["hit"]).alias("hit"), _context(text, m["start"], m["end"]).alias("context")))


def score_graph(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """hit and kind of the unseen instances that confident patterns pick out.

    ``instances`` has hit, rank (-1: not a seed), before and after.  A pattern's score for
    a kind is the share of its instances' weight that has the kind; an instance's, that at
    least one of its patterns is right.  Only patterns with enough different seeds count.
    """
    last, first = F.regexp_extract("before", r"(\S+)$", 1), F.regexp_extract("after", r"^(\S+)", 1)
    word = lambda c: c.rlike(r"[^\W_]")
    patterns = F.filter(
        F.array(
            F.when(word(F.col("before")), F.concat(F.lit("b:"), "before")),
            F.when(word(last), F.concat(F.lit("w:"), last)),
            F.when(word(F.col("after")), F.concat(F.lit("a:"), "after")),
            F.when(word(last) | word(first), F.concat(F.lit("s:"), last, F.lit("|"), first)),
        ),
        lambda p: p.isNotNull(),
    )
    edges = instances.select("hit", "rank", F.explode(patterns).alias("pattern")).groupBy("pattern", "hit").agg(F.max("rank").alias("rank"))
    useful = edges.groupBy("pattern").agg(F.count_if(F.col("rank") >= 0).alias("seeds"), F.count_if(F.col("rank") < 0).alias("new")).filter((F.col("seeds") >= PATTERN_SEEDS) & (F.col("new") > 0)).select("pattern")
    edges = kept(edges.join(useful, "pattern", "left_semi"))
    scores = edges.filter("rank >= 0").select("hit", "rank").distinct().select("hit", F.col("rank").alias("kind"), F.lit(1.0).alias("score"))
    # Only an e-mail address has an at sign.
    fits = F.col("hit").rlike(r"@|[\[(]at[\])]") == (F.col("kind") == KINDS.index("email"))
    for _ in range(rounds):
        weight = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        by_pattern = edges.select("pattern", "hit").join(scores, "hit").groupBy("pattern", "kind").agg(F.sum("score").alias("good")).join(weight, "pattern").select("pattern", "kind", (F.col("good") / (F.col("n") + 0.5)).alias("trust")).filter(F.col("trust") >= PATTERN_CONFIDENCE)
        new = edges.filter("rank < 0").join(by_pattern, "pattern").filter(fits).groupBy("hit", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("score"))
        seeds = edges.filter("rank >= 0").select("hit", F.col("rank").alias("kind"), F.lit(1.0).alias("score")).distinct()
        scores = kept(seeds.unionByName(new))
    known = edges.filter("rank >= 0").select("hit").distinct()
    return scores.filter(F.col("score") >= INSTANCE_SCORE).join(known, "hit", "left_anti").groupBy("hit").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def find_pii(docs: DataFrame, *columns: str, rounds: int = ROUNDS) -> DataFrame:
    """The named columns with ``base`` and ``spans``, arrays of start, rank (kind), end, hit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = only(docs, *dict.fromkeys([*columns, "text"])).withColumn("row", F.monotonically_increasing_id()).withColumn("base", base_spans(text))
    rows = rows.withColumn("instances", _instances(text, F.col("base")))
    rows = kept(rows.select("row", *columns, "base", "instances"))
    each = rows.select("row", F.explode("instances").alias("i")).select("row", "i.start", "i.rank", "i.end", "i.hit", "i.context.before", "i.context.after")
    told = score_graph(each.select("hit", "rank", "before", "after"), rounds)
    added = each.filter("rank < 0").join(told, "hit").groupBy("row").agg(F.collect_list(F.struct("start", F.col("kind").alias("rank"), "end", "hit")).cast(SPANS).alias("added"))
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))
    return rows.join(added, "row", "left").select(*columns, "base", spans.alias("spans"))


def spans_text(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the fixed forms, their digest and all spans of every document."""
    found = find_pii(docs, "doc_id")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(F.col("doc_id").cast("long"), *[count(k) for k in range(len(KINDS))], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def redacted(text: Column, spans: str) -> Column:
    """The text with every span, overlapping ones together, as its kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(s: Column, x: Column) -> Column:
        piece = F.concat(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.get(names, x["rank"]))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], F.when(x["start"] >= s["at"], piece).otherwise("")).alias("out"))

    return F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
