"""Place codes, spellings, populations without double counting, chains of code changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..storage import materialised

# Where codes stand in file names and headers.
FILE_NAME = r"^CC_\d{5}_\d{6}_(\d[0-9AB]\d{3})_[A-Z]{2}_\d+\.pdf$"
HEADER = r"Cahier\s+citoyen\s*\n\s*[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\-'’\s]*?\s*-\s*(\d[0-9AB]\d{3})\b"


def normal_code(c: Column) -> Column:
    own = F.upper(T.strip(c))
    return F.when((F.length(own) == 5) & (own != fixed.ABSENT_CODE), own)


def code_of_file(c: Column) -> Column:
    return normal_code(F.regexp_extract(c, fixed.JAVA_I + FILE_NAME, 1))


def code_of_header(c: Column) -> Column:
    return normal_code(F.regexp_extract(c, fixed.JAVA_I + HEADER, 1))


def department(c: Column) -> Column:
    code = normal_code(c)
    return F.when(F.substring(code, 1, 2).isin("97", "98"), F.substring(code, 1, 3)).otherwise(F.substring(code, 1, 2))


def reconcile(file_code: Column, header_code: Column) -> Column:
    """The code kept, the file's first, and where it comes from."""
    origin = F.when(file_code.isNotNull() & header_code.isNotNull(), F.when(file_code == header_code, "accord").otherwise("desaccord")).when(file_code.isNotNull(), "fichier").when(header_code.isNotNull(), "entete").otherwise("aucun")
    return F.struct(F.coalesce(file_code, header_code).alias("code"), origin.alias("origin"))


def spelling_key(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(T.fold(c), "[-'’]", " "), r"(?U)\s+", " ")))


def richness(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[A-Za-z0-9 ]", ""))


def spellings(names: DataFrame, name: str = "name") -> DataFrame:
    """key, the richest spelling (ties: the first), how many spellings and rows."""
    own = names.select(T.strip(F.col(name)).alias("name")).filter("name <> ''")
    each = own.groupBy("name").agg(F.count("*").alias("n")).withColumn("key", spelling_key(F.col("name")))
    return each.groupBy("key").agg(F.min_by("name", F.struct(-richness(F.col("name")), "name")).alias("shown"), F.count("*").alias("spellings"), F.sum("n").alias("rows"))


def label(official: Column, spelling: Column, code: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(official, F.lit("")), F.nullif(spelling, F.lit("")), code), F.lit(" ("), code, F.lit(")"))


def counted_population(places: DataFrame) -> DataFrame:
    """Places (code, kind, parent_code, population) with the population to add up: a delegated
    place whose parent is there counts nothing."""
    there = places.select(F.col("code").alias("parent_code"), F.lit(True).alias("parent_there")).distinct()
    out = places.join(there, "parent_code", "left")
    twice = (F.col("kind") == "COMD") & F.coalesce("parent_there", F.lit(False))
    return out.withColumn("counted", F.when(twice, 0).otherwise(F.coalesce("population", F.lit(0)))).drop("parent_there")


def department_coverage(places: DataFrame, contributions: DataFrame) -> DataFrame:
    """places, places with contributions and contributions of each department."""
    both = places.join(contributions.select("code", "contribution"), "code", "left")
    return both.groupBy("department").agg(F.count_distinct("code").alias("places"), F.count_distinct(F.when(F.col("contribution").isNotNull(), F.col("code"))).alias("touched"), F.count("contribution").alias("contributions"))


def reference_table(places: DataFrame, geometry: DataFrame, passage: DataFrame) -> DataFrame:
    """Places with coordinates and today's code; an unchanged full place keeps its own."""
    out = places.join(geometry, "code", "left").join(passage.select(F.col("code_2019").alias("code"), "code_courant", "nom_courant"), "code", "left")
    return out.withColumn("code_courant", F.coalesce("code_courant", F.when(F.col("kind") == "COM", F.col("code"))))


def current_codes(places: DataFrame, moves: DataFrame, today: DataFrame, hops: int = fixed.CHAIN_HOPS) -> DataFrame:
    """code and today's code: earliest moves are followed until a code of today, never back to
    one already seen; none after ``hops`` moves.  Delegated places start from their parent."""
    now = today.select(F.col("code").alias("at"), F.lit(True).alias("now")).distinct()
    begin = F.when(F.col("kind") == "COMD", F.coalesce("parent_code", "code")).otherwise(F.col("code"))
    front = places.select("code", begin.alias("at"), F.array(begin).alias("seen"))
    done = None
    for k in range(hops + 1):
        front = front.join(now, "at", "left")
        arrived = front.filter("now").select("code", F.col("at").alias("current"))
        done = arrived if done is None else done.unionByName(arrived)
        if k == hops:
            break
        step = front.filter("now is null").join(moves, F.col("at") == F.col("from_code")).filter(~F.array_contains("seen", F.col("to_code")))
        w = Window.partitionBy("code").orderBy("date", "to_code")
        front = materialised(step.withColumn("place", F.row_number().over(w)).filter("place = 1").select("code", F.col("to_code").alias("at"), F.array_append("seen", F.col("to_code")).alias("seen")))
        if front.isEmpty():
            break
    return places.select("code").join(done, "code", "left")


def outlines(features: DataFrame) -> DataFrame:
    """code and outer rings as (latitude, longitude) of GeoJSON polygons and multipolygons
    (code, type, coordinates as JSON text)."""
    flip = lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, 1).alias("lat"), F.get(p, 0).alias("lon")))
    one = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.from_json("coordinates", "array<array<array<array<double>>>>")
    rings = F.when(F.col("type") == "Polygon", F.array(flip(F.get(one, 0)))).otherwise(F.transform(many, lambda p: flip(F.get(p, 0))))
    return features.select("code", rings.alias("rings"))


def pivot_places(rows: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """One place for each code (code, name, kind, parent_code, department): a full commune beats a
    delegated one of the same code; only the departments asked for, if any are."""
    own = rows.filter(F.col("department").isin(*departments)) if departments else rows
    w = Window.partitionBy("code").orderBy(F.when(F.col("kind") == "COM", 0).otherwise(1), "name")
    return own.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def build_reference(rows: DataFrame, populations: DataFrame, coordinates: DataFrame, moves: DataFrame, today: DataFrame, departments: list[str] | None = None) -> DataFrame:
    """Places of an old code list with population, rounded coordinates and what they are today.

    ``populations`` may name a code twice: its first row (by pos) counts.  ``today`` has code and
    name; a place without a chain to today's codes has none.  State: same, renamed, absorbed or
    vanished.
    """
    places = pivot_places(rows, departments)
    people = populations.groupBy("code").agg(F.min_by("population", "pos").alias("population"))
    where = coordinates.groupBy("code").agg(F.round(F.avg("latitude"), 5).alias("latitude"), F.round(F.avg("longitude"), 5).alias("longitude"))
    now = current_codes(places.select("code", "kind", "parent_code"), moves, today).select("code", F.col("current").alias("current_code"))
    names = today.select(F.col("code").alias("current_code"), F.col("name").alias("current_name"))
    out = places.join(people, "code", "left").join(where, "code", "left").join(now, "code", "left").join(names, "current_code", "left")
    state = F.when(F.col("current_code").isNull(), "vanished").when(F.col("current_code") != F.col("code"), "absorbed").when(F.col("current_name") != F.col("name"), "renamed").otherwise("same")
    return out.withColumn("state", state)


def states(reference: DataFrame) -> DataFrame:
    """How many places of each department are the same, renamed, absorbed or vanished."""
    return reference.groupBy("department", "state").agg(F.count("*").alias("places"))
