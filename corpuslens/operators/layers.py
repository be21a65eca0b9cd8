"""Versioned layers: runs with at most one active of each kind, layer tables by run, deliveries."""

from __future__ import annotations

import getpass
import os
import subprocess

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..schemas import RUN


def author(given: str | None = None) -> str:
    """The argument, the environment, git's identity, the account; blank counts as none."""
    def git(key: str) -> str:
        done = subprocess.run(["git", "config", key], capture_output=True, text=True, check=False)
        return done.stdout.strip()

    for own in (given, os.environ.get("CORPUSLENS_AUTHOR"), git("user.name"), getpass.getuser()):
        if own and own.strip():
            return own.strip()
    raise ValueError("nobody to answer for the run")


def create_run(runs: DataFrame, kind: str, label: str, who: str | None = None, activate: bool = False, **fields: str) -> tuple[DataFrame, int]:
    """The table with a new run, and its id."""
    if kind not in fixed.RUN_KINDS:
        raise ValueError(f"unknown kind: {kind}")
    ident = (runs.agg(F.max("id")).first()[0] or 0) + 1
    row = runs.sparkSession.range(1).select(*[F.lit({"id": ident, "kind": kind, "label": label, "author": author(who), "active": False, **fields}.get(f.name)).cast(f.dataType).alias(f.name) if f.name != "created_at" else F.current_timestamp().alias("created_at") for f in RUN.fields])
    out = runs.unionByName(row)
    return (activate_run(out, ident) if activate else out), ident


def activate_run(runs: DataFrame, ident: int) -> DataFrame:
    """Active becomes this run, and no other of its kind."""
    kind = runs.filter(F.col("id") == ident).select("kind").first()
    if kind is None:
        raise ValueError(f"no run {ident}")
    return runs.withColumn("active", F.when(F.col("kind") == kind["kind"], F.col("id") == ident).otherwise(F.col("active")))


def active_run(runs: DataFrame, kind: str) -> int | None:
    """The id of the active run, known before planning so that partitions are pruned."""
    found = runs.filter((F.col("kind") == kind) & F.col("active")).select("id").take(2)
    if len(found) > 1:
        raise ValueError(f"several active runs of {kind}")
    return found[0]["id"] if found else None


def latest_run(runs: DataFrame, key: str) -> DataFrame:
    """The newest run for each value of a column."""
    w = Window.partitionBy(key).orderBy(F.desc("id"))
    return runs.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def served(layer: DataFrame, run: int | None) -> DataFrame:
    """Rows of the run that is served; none without one."""
    return layer.filter(F.col("run_id") == run) if run is not None else layer.filter(F.lit(False))


def write_layer(rows: DataFrame, path: str, run: int) -> None:
    """Replaces the run's partition and leaves the others."""
    rows.withColumn("run_id", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def upsert(table: DataFrame, changes: DataFrame, key: str, empty: str | None = None, order: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those with the same key, of which null is one; rows for which
    ``empty`` holds go.  Of several changes with one key the last by ``order`` is the one that
    counts, then the largest in all columns as text."""
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in ([order] if order else [])], F.desc(F.to_json(F.struct("*"))))
    changes = changes.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_place")
    known = changes.select(F.col(key).alias("_key"))
    out = table.join(known, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(changes)
    return out.filter(f"not ({empty})") if empty else out


def load_topics(existing: DataFrame, delivered: DataFrame) -> DataFrame:
    """Topics by external_id: delivered values replace; parents that are unknown become none."""
    clean = delivered.withColumns({c: F.replace(c, F.lit("\u0000"), F.lit("")) for c, t in delivered.dtypes if t == "string"})
    out = upsert(existing, clean, "external_id")
    known = out.select(F.col("external_id").alias("parent"), F.lit(True).alias("known"))
    return out.join(known, "parent", "left").withColumn("parent", F.when(F.col("known"), F.col("parent"))).drop("known")


def resolve_documents(delivered: DataFrame, contributions: DataFrame, documents: DataFrame) -> DataFrame:
    """Delivered keys as ids of what exists; a document brings its contribution along."""
    own = delivered.withColumn("k", T.parse_document_key(F.col("external_doc_id")))
    own = own.join(documents.select(F.col("id").alias("doc"), F.col("contribution_id").alias("of_doc")), (F.col("k.level") == "doleance") & (F.col("k.id") == F.col("doc")), "left")
    own = own.join(contributions.select(F.col("id").alias("page")), (F.col("k.level") == "contribution") & (F.col("k.id") == F.col("page")), "left")
    return own.select(*delivered.columns, F.col("doc").alias("document_id"), F.coalesce("of_doc", "page").alias("contribution_id"))


def orphans(delivered: DataFrame, existing: DataFrame) -> DataFrame:
    """Delivered topics whose parent is neither delivered nor there already."""
    known = delivered.select(F.col("external_id").alias("parent")).unionByName(existing.select(F.col("external_id").alias("parent")))
    return delivered.filter("parent is not null").join(known, "parent", "left_anti")


def _labels(delivered: DataFrame) -> DataFrame:
    return delivered.select("external_doc_id", F.explode("labels").alias("l")).withColumn("name", F.replace("l.name", F.lit("\u0000"), F.lit("")))


def unknown_labels(delivered: DataFrame, topics: DataFrame) -> DataFrame:
    """Labels whose name no topic has: how often each was dropped."""
    return _labels(delivered).join(topics.select("name"), "name", "left_anti").groupBy("name").agg(F.count("*").alias("n"))


def instances_of(delivered: DataFrame, topics: DataFrame) -> DataFrame:
    """Labels (external_doc_id, labels: name, rationale, extract) as rows; unknown names are dropped."""
    each = _labels(delivered)
    return each.join(topics.select(F.col("name"), F.col("external_id").alias("topic")), "name").select("external_doc_id", "topic", F.col("l.extract").alias("verbatim"), F.col("l.rationale").alias("summary"))


def match_rate(extracts: DataFrame, texts: DataFrame, chars: int = fixed.DELIVERY_CHARS, sample: int = fixed.DELIVERY_SAMPLE) -> DataFrame:
    """Share of the first documents (doc, extract) whose text holds the start of their extract."""
    own = lambda c: T.strip(F.regexp_replace(F.lower(c), T.SPACE, " "))
    first = extracts.filter(T.strip(F.col("extract")) != "").groupBy("doc").agg(F.min("extract").alias("extract")).orderBy("doc").limit(sample)
    both = first.join(texts.select("doc", "text"), "doc")
    return both.agg(F.count("*").alias("tested"), F.count_if(F.contains(own(F.col("text")), F.substring(own(F.col("extract")), 1, chars))).alias("found"))


def missing_targets(lexicon: dict[str, str], topics: set[str]) -> set[str]:
    """Targets of a keyword lexicon that its grid does not have."""
    return set(lexicon) - topics


def check_grid(grid: dict) -> dict:
    """A hand-written grid, refused if keys are missing, ids repeat or parents are unknown."""
    if missing := {"grille", "source", "topics"} - set(grid):
        raise ValueError(f"missing: {sorted(missing)}")
    ids = [t.get("id") for t in grid["topics"]]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError("topics need ids of their own")
    if unknown := {t["parent"] for t in grid["topics"] if t.get("parent")} - set(ids):
        raise ValueError(f"unknown parents: {sorted(unknown)}")
    return grid


def enrich_places(places: DataFrame, reference: DataFrame) -> DataFrame:
    """Known places with the reference's official name and population, and how they stand:
    known, delegated, vanished, renamed or unknown.  Nothing is inserted, names stay."""
    r = reference.select("code", F.col("name").alias("ref_name"), F.col("kind").alias("ref_kind"), F.col("population").alias("ref_population"), "code_courant", "nom_courant")
    state = F.when(F.col("ref_name").isNull(), "unknown").when(F.col("ref_kind") == "COMD", "delegated").when(F.col("code_courant").isNull(), "vanished").when(F.coalesce("nom_courant", "ref_name") != F.col("ref_name"), "renamed").otherwise("known")
    return places.join(r, "code", "left").select(*places.columns, F.col("ref_name").alias("official_name"), "ref_population", state.alias("state"))


def load_delivery(topics: DataFrame, delivered_topics: DataFrame, delivered: DataFrame, contributions: DataFrame, documents: DataFrame, texts: DataFrame, least: float = fixed.DELIVERY_RATE) -> dict:
    """Topics and instances of a delivery, attached to documents if enough of its extracts are
    found in their texts (doc, text); else instances keep their external keys only.

    Gives the two tables and what was counted: tested, found, orphans, dropped labels, attached.
    """
    out = load_topics(topics, delivered_topics)
    instances = instances_of(delivered, out)
    resolved = resolve_documents(instances, contributions, documents)
    rate = match_rate(resolved.filter("document_id is not null").select(F.col("document_id").alias("doc"), F.col("verbatim").alias("extract")), texts).first()
    attached = rate["tested"] > 0 and rate["found"] / rate["tested"] >= least
    if not attached:
        resolved = resolved.withColumns({c: F.lit(None).cast("long") for c in ("document_id", "contribution_id")})
    counts = {"tested": rate["tested"], "found": rate["found"], "attached": attached, "orphans": orphans(delivered_topics, topics).count(), "dropped": unknown_labels(delivered, out).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]}
    return {"topics": out, "instances": resolved, "counts": counts}


def reopen_run(runs: DataFrame, kind: str, source: str, label: str, who: str | None = None, **fields: str) -> tuple[DataFrame, int]:
    """The newest run of a source with its fields renewed, or a new one that is not active."""
    found = runs.filter((F.col("kind") == kind) & (F.col("source") == source)).agg(F.max("id")).first()[0]
    if found is None:
        return create_run(runs, kind, label, who, source=source, **fields)
    return runs.withColumns({c: F.when(F.col("id") == found, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()}), found


def check_kind(runs: DataFrame, ident: int, kind: str) -> None:
    """Refuses a run that is not there or of another kind."""
    found = runs.filter(F.col("id") == ident).select("kind").first()
    if found is None or found["kind"] != kind:
        raise ValueError(f"no run {ident} of {kind}")


def insert_pages(pages: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of files that are not there yet, and a contribution for each: a file is all new or
    not new at all.  Ids follow file and page."""
    fresh = pages.join(done.select("file").distinct(), "file", "left_anti").withColumn("contribution_id", F.xxhash64("file", "page"))
    contributions = fresh.select(F.col("contribution_id").alias("id"), T.find_city(F.col("text")).alias("city"), F.col("file").alias("pdf_file"), F.col("page").alias("start_page"), F.col("page").alias("end_page"))
    return fresh, contributions


def segment_rows(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments (register, position, start_page, ...) with the contribution of their opening page and
    the first city that is not empty from there on in the register."""
    p = pages.select("register", F.col("page").alias("start_page"), F.col("contribution_id"), F.nullif(T.strip(F.coalesce("city", F.lit(""))), F.lit("")).alias("city"))
    ahead = Window.partitionBy("register").orderBy("start_page").rowsBetween(0, Window.unboundedFollowing)
    return segments.join(p.withColumn("city", F.first("city", ignorenulls=True).over(ahead)), ["register", "start_page"], "left")


def populate_places(places: DataFrame, contributions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places with those of new codes, named by their richest spelling, and contributions with codes
    from their files.  Places that are there stay as they are; doing it twice changes nothing."""
    from . import geography

    coded = contributions.withColumn("city_code", F.coalesce("city_code", geography.code_of_file(F.col("pdf_file"))))
    spelled = coded.filter("city_code is not null and city is not null").groupBy("city_code", "city").agg(F.count("*").alias("n"))
    best = spelled.groupBy("city_code").agg(F.min_by("city", F.struct(-geography.richness(F.col("city")), -F.col("n"), "city")).alias("name"))
    new = best.join(places.select(F.col("code").alias("city_code")), "city_code", "left_anti")
    have = {"code": F.col("city_code"), "name": F.col("name"), "department": geography.department(F.col("city_code"))}
    rows = new.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in places.schema.fields])
    return places.unionByName(rows), coded
