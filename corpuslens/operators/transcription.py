"""Transcriptions of page images: hooks for rendering and recognition, redraws, lots, fidelity.

Rendering and recognition are injected functions.  They are called batch by batch inside
tasks; what fails is a row with its error, so one bad page does not end a pass.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import spans as S
from ..functions import text as T
from ..storage import discard, materialised



class Transcriber(Protocol):
    """Recognises one page image; a page that was cut off by a limit of tokens says so."""

    def __call__(self, image: bytes, image_format: str, seed: int) -> dict: ...


class Echo:
    """A transcriber for tests: the image's own bytes as text, repeated when the seed is among
    ``drifting``."""

    def __init__(self, drifting: tuple[int, ...] = ()) -> None:
        self.drifting = drifting

    def __call__(self, image: bytes, image_format: str, seed: int) -> dict:
        text = image.decode("utf-8", "replace")
        return {"text": f"{text}\n" * 60 if seed in self.drifting else text, "layout": None, "capped": False}


def render(pages: DataFrame, renderer, dpi: int = fixed.RENDER_DPI, image_format: str = "png") -> DataFrame:
    """page_id and image of pages (page_id, file, page) by an injected function of file, page,
    resolution and format; a page out of bounds has a null image and an error."""

    def draw(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for ident, file, page in zip(batch["page_id"], batch["file"], batch["page"]):
                try:
                    rows.append((ident, renderer(file, int(page), dpi, image_format), None))
                except Exception as error:  # noqa: BLE001  one bad page does not end the pass
                    rows.append((ident, None, str(error)))
            yield pd.DataFrame(rows, columns=["page_id", "image", "error"])

    return pages.select("page_id", "file", "page").mapInPandas(draw, "page_id long, image binary, error string")


def transcribe(images: DataFrame, transcriber: Transcriber, seeds: tuple[int, ...] = fixed.REDRAW_SEEDS, image_format: str = "png") -> DataFrame:
    """Texts of page images (page_id, image).  A text that goes in circles or was cut off is drawn
    again with the next seed; the last one stays whatever it is like.

    Every seed is a pass over the pages that are still open; each pass is written before the next,
    so a broken one loses nothing of those before it.
    """

    def draw(seed: int):
        def read(batches):
            import pandas as pd

            for batch in batches:
                rows = []
                for ident, image in zip(batch["page_id"], batch["image"]):
                    try:
                        if image is None:
                            raise ValueError("no image")
                        found = transcriber(bytes(image), image_format, seed)
                        rows.append((ident, found["text"], found.get("layout"), bool(found.get("capped")), None))
                    except Exception as error:  # noqa: BLE001  one bad page does not end the pass
                        rows.append((ident, None, None, None, str(error)))
                yield pd.DataFrame(rows, columns=["page_id", "text", "layout", "capped", "error"]).astype({"capped": "boolean"})

        return read

    todo, out = images.select("page_id", "image"), None
    for k, seed in enumerate(seeds):
        again = F.col("error").isNull() & (F.col("capped") | T.is_drift(F.col("text"))) if k + 1 < len(seeds) else F.lit(False)
        drawn = todo.mapInPandas(draw(seed), "page_id long, text string, layout string, capped boolean, error string")
        fine = F.col("error").isNull()
        drawn = materialised(drawn.select("page_id", "text", "layout", "capped", F.when(fine, seed).cast("int").alias("seed"), F.when(fine, k).cast("int").alias("redraws"), "error", again.alias("again")))
        kept = drawn.filter("not again").drop("again")
        out = kept if out is None else out.unionByName(kept)
        if drawn.filter("again").isEmpty():
            break
        todo = images.select("page_id", "image").join(drawn.filter("again").select("page_id"), "page_id", "left_semi")
    return out


def still_to_do(pages: DataFrame, transcriptions: DataFrame, run: int) -> DataFrame:
    """Pages that the run has no transcription of yet: how it resumes."""
    return pages.join(transcriptions.filter(F.col("run_id") == run).select("page_id"), "page_id", "left_anti")


def take_back_drift(transcriptions: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """The table without the run's texts that go in circles, and the pages to do again."""
    bad = transcriptions.filter((F.col("run_id") == run) & T.is_drift(F.coalesce("text", F.lit("")))).select("run_id", "page_id")
    return transcriptions.join(bad, ["run_id", "page_id"], "left_anti"), bad.select("page_id")


def fidelity(pairs: DataFrame, reference: str = "reference", text: str = "text") -> DataFrame:
    """Of each page (page_id, reference, text): length ratio, character, word and folded character
    error rates, and whether it was cut off."""
    a, b = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    ratio = F.when(F.length(a) > 0, F.length(b) / F.length(a))
    capped = F.coalesce(F.col("capped"), F.lit(False)) if "capped" in pairs.columns else F.lit(False)
    return pairs.select(
        "page_id", ratio.alias("length_ratio"), T.character_error_rate(a, b).alias("cer"), S.wer(a, b).alias("wer"),
        T.character_error_rate(T.normalise(a), T.normalise(b)).alias("folded_cer"), capped.alias("capped"),
    )


def requests(images: DataFrame, prompt: str, model: str) -> DataFrame:
    """One JSON request for each image, and its size: lines of the lots that go to a batch service."""
    body = F.struct(F.lit(model).alias("model"), F.lit(prompt).alias("prompt"), F.base64("image").alias("image"))
    line = F.to_json(F.struct(F.col("page_id").cast("string").alias("custom_id"), body.alias("body")))
    return images.filter("image is not null").select(F.col("page_id").alias("id"), line.alias("line")).withColumn("size", (F.octet_length("line") + 1).cast("long"))


def lots(rows: DataFrame, limit: int = fixed.LOT_BYTES, parts: int = 64) -> DataFrame:
    """A lot number for every request (id, size), in order of id: a lot is filled until the next
    request would take it over ``limit``; a request over it is a lot of its own.

    Where a lot ends depends only on where it begins, so each request's next beginning is found
    first, from the requests of its own and the next stretch of ``limit`` bytes.  Those that follow
    from the first request are told by doubling: 2^k lots ahead, the largest k first.  Rounds grow
    with the logarithm of the number of lots, and no task holds more than two stretches.
    """
    wide = limit + 1  # a request that is larger counts as this: it stands alone either way
    bounds = rows.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)]).alias("b")).first()["b"] or []
    ranges = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<long>"), lambda x: x < F.col("id"))) if bounds else F.lit(0)
    ranged = rows.withColumn("range", ranges).withColumn("own", F.least("size", F.lit(wide)).cast("long"))
    placed = materialised(_running(ranged, "own").select("id", "size", "range", "own", (F.col("upto") - F.col("own")).alias("start")))
    stretch = F.floor(F.col("start") / wide)
    near = placed.select("id", "own", "start", F.explode(F.array(stretch, stretch - 1)).alias("stretch"), stretch.alias("home"))

    def follow(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["start", "id"])
        start, end, ident, mine = pdf["start"].to_numpy(), (pdf["start"] + pdf["own"]).to_numpy(), pdf["id"].to_numpy(), (pdf["home"] == pdf["stretch"]).to_numpy()
        at = np.maximum(np.searchsorted(end, start + limit, "right"), np.arange(len(pdf)) + 1)
        known = mine & (at < len(pdf))
        return pd.DataFrame({"id": ident[known], "to": ident[at[known]]})

    jumps = [materialised(near.groupBy("stretch").applyInPandas(follow, "id long, to long"))]
    begins = placed.agg(F.min("id").alias("id")).filter("id is not null")
    first = begins.first()
    while first is not None and not jumps[-1].filter(F.col("id") == first["id"]).isEmpty():
        twice = jumps[-1].alias("a").join(jumps[-1].alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", "b.to")
        jumps.append(materialised(twice))
    for jump in reversed(jumps):
        begins = materialised(begins.unionByName(begins.join(jump, "id").select(F.col("to").alias("id"))).distinct())
    discard(*jumps)
    marked = placed.join(begins.withColumn("new", F.lit(1)), "id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return _running(marked, "new").select("id", "size", (F.col("upto") - 1).cast("long").alias("lot"))


def _running(ranged: DataFrame, value: str) -> DataFrame:
    """With ``upto``, the sum of a column over all rows up to this one by id: the sums of the ranges
    come first, so that only one row a range meets in one place."""
    sums = ranged.groupBy("range").agg(F.sum(value).alias("all"))
    before = F.coalesce(F.sum("all").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("range", before.alias("before")))
    run = F.sum(value).over(Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(starts, "range").withColumn("upto", F.col("before") + run).drop("before")
