"""Registers into documents: a scan of each register's lines, run as a parallel prefix scan.

Whether a line begins a document depends on the lines before it only through a small state:
how many characters the document has so far, counted up to the least volume, and how many
signature lines a closing formula still allows.  Of a line, a number says all that matters; so
pages are lists of numbers, and texts are read again only where the cuts are known.  A block of
pages is a table from state to state; tables of neighbouring blocks are put together level by
level, and on the way back every block learns the state it begins in.  Blocks are read page by
page in order, and no task needs all of a register, however long it is.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T
from ..storage import discard, materialised, modest_batches

#: Pages of a block, blocks that are put together at once, and rows or pieces that a task gives at once.
BLOCK_PAGES, FAN, GIVEN = 64, 256, 1000
#: Lengths count up to the least volume, which is more than a signature line has.
SIZES, LEFTS = max(fixed.MIN_SEGMENT_CHARS, fixed.SIGNATURE_LINE_CHARS + 1) + 1, fixed.SIGNATURE_LINES + 2
TABLE = "register string, block long, states binary, cuts binary, lines long"
ENTRY = "register string, block long, state int, cuts long, lines long"
PAGE = "register string, block long, page long, pieces array<struct<position:bigint,signal:string,first_line:bigint,begin:int,n:int>>"


def opening(line: Column, openings=fixed.OPENINGS) -> Column:
    """The number, from 1, of the first opening that a line has; 0 without one."""
    return reduce(lambda out, x: F.when(line.rlike(fixed.JAVA_I + x[1][1]), x[0]).otherwise(out), reversed(list(enumerate(openings, 1))), F.lit(0))


def lines_of(text: Column) -> Column:
    """The stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda x: x != "")


def coded(pages: DataFrame, openings=fixed.OPENINGS, closing: str = fixed.CLOSING) -> DataFrame:
    """register, block, page, and a number for each line: its length up to a bound, whether it closes,
    and what it opens."""

    def code(line: Column) -> Column:
        closes = F.when(line.rlike(fixed.JAVA_I + closing), SIZES).otherwise(0)
        return F.least(F.length(line), F.lit(SIZES - 1)) + closes + 2 * SIZES * opening(line, openings)

    block = F.coalesce(F.expr(f"page div {BLOCK_PAGES}"), F.lit(-1)).cast("long")
    return pages.select("register", block.alias("block"), "page", F.transform(lines_of(F.col("text")), code).alias("codes")).filter(F.size("codes") > 0)


def _steps(openings: int):
    """Of every code and every state before a line: the state after it, and where it cuts, 1 by its
    opening, 2 after a closing formula.

    A state's ``left`` is 0 without a closing formula, else one more than the signature lines still
    allowed.
    """
    import numpy as np

    code = np.arange(2 * SIZES * (openings + 1))[:, None]
    n, closes, opens = code % SIZES, code // SIZES % 2 == 1, code // (2 * SIZES)
    left, size = np.divmod(np.arange(SIZES * LEFTS)[None, :], SIZES)
    by_opening = (size >= fixed.MIN_SEGMENT_CHARS) & (opens > 0)
    by_closing = ~by_opening & (left > 0) & ((left == 1) | (n > fixed.SIGNATURE_LINE_CHARS))
    cut = by_opening | by_closing
    size = np.minimum(np.where(cut, 0, size) + n, SIZES - 1)
    left = np.where(closes, LEFTS - 1, np.where(cut | (left == 0), 0, left - 1))
    return (left * SIZES + size).astype(np.int32), (by_opening + 2 * by_closing).astype(np.int8)


def _rows(batches):
    """The rows of some batches, one after the other."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _given(rows, schema):
    """Rows as batches of some rows, or of fewer where their last column is long lists."""
    import pyarrow as pa

    held, many = [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        many += len(row[-1]) if isinstance(row[-1], list) else 1
        if many >= GIVEN:
            yield flush()
            held, many = [], 0
    if held:
        yield flush()


def _in_groups(df: DataFrame, keys: list[str], order: list[str], columns: list[str], body, schema: str) -> DataFrame:
    """``body``'s rows of the rows, which come one after the other, those of a group together and in order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        return _given(body(_rows(batches)), out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*columns).mapInArrow(run, schema)


def _tables(openings: int):
    """Of blocks of pages their tables: for every state at the beginning, that at the end and the cuts between."""

    def body(rows):
        import numpy as np

        after, how = _steps(openings)
        cutting = how > 0
        for (register, block), pages in groupby(rows, lambda r: r[:2]):
            state, cuts, lines = np.arange(SIZES * LEFTS, dtype=np.int32), np.zeros(SIZES * LEFTS, np.int64), 0
            for _, _, codes in pages:
                for code in codes:
                    cuts += cutting[code][state]
                    state = after[code][state]
                lines += len(codes)
            yield register, block, state.tobytes(), cuts.tobytes(), lines

    return body


def _read(states: bytes, cuts: bytes):
    import numpy as np

    return np.frombuffer(states, np.int32), np.frombuffer(cuts, np.int64)


def _together(rows):
    """Of tables of neighbouring blocks one table."""
    import numpy as np

    for (register, above), tables in groupby(rows, lambda r: r[:2]):
        state, cuts, lines = np.arange(SIZES * LEFTS, dtype=np.int32), np.zeros(SIZES * LEFTS, np.int64), 0
        for _, _, own_states, own_cuts, own_lines in tables:
            states, more = _read(own_states, own_cuts)
            cuts, state, lines = cuts + more[state], states[state], lines + own_lines
        yield register, above, state.tobytes(), cuts.tobytes(), lines


def _begun(rows):
    """Where each of some neighbouring blocks begins; where they begin together comes before them."""
    state = cuts = lines = 0
    for register, block, states, more, own_lines, entry in rows:
        if entry is not None:
            state, cuts, lines = entry["state"], entry["cuts"], entry["lines"]
            continue
        yield register, block, state, cuts, lines
        states, more = _read(states, more)
        cuts, state, lines = cuts + int(more[state]), int(states[state]), lines + own_lines


def _with_entries(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows, and before those of a block (by ``key``) where it begins, as ``entry``."""
    entry = known.select("register", F.col("block").alias(key), F.struct("state", "cuts", "lines").alias("entry"))
    return df.withColumn("own", F.lit(1)).unionByName(entry.withColumn("own", F.lit(0)), allowMissingColumns=True)


def entries(codes: DataFrame, openings: int, fan: int = FAN) -> DataFrame:
    """register, block, and the state, cuts and lines before it."""
    levels = [materialised(_in_groups(codes, ["register", "block"], ["page"], ["register", "block", "codes"], _tables(openings), TABLE))]
    above = F.expr(f"block div {fan}")  # towards 0, or blocks below it would never come together with others
    while levels[-1].groupBy("register").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        below = levels[-1].withColumn("above", above)
        levels.append(materialised(_in_groups(below, ["register", "above"], ["block"], ["register", "above", "states", "cuts", "lines"], _together, TABLE)))
    known = levels[-1].select("register", "block", F.lit(0).alias("state"), F.lit(0).cast("long").alias("cuts"), F.lit(0).cast("long").alias("lines"))
    for level in reversed(levels[:-1]):
        both = _with_entries(level.withColumn("above", above), known, "above")
        known = _in_groups(both, ["register", "above"], ["own", "block"], ["register", "block", "states", "cuts", "lines", "entry"], _begun, ENTRY)
    known = materialised(known)
    discard(*levels)
    return known


def _pieces(names: list[str]):
    """Of pages, each block's after where it begins, the documents that they have a part in."""

    def body(rows):
        after, how = _steps(len(names))
        known: dict = {}
        state = position = lines = 0
        for register, block, page, codes, entry in rows:
            if entry is not None:
                state, position, lines = entry["state"], entry["cuts"], entry["lines"]
                continue
            own = []
            for at, code in enumerate(codes):
                if code not in known:
                    known[code] = after[code].tolist(), how[code].tolist()
                states, hows = known[code]
                cut, state = hows[state], states[state]
                if cut:
                    position += 1
                if cut or not at:
                    signal = "cloture" if cut == 2 else names[code // (2 * SIZES) - 1] if cut else None if lines else "debut"
                    own.append({"position": position, "signal": signal, "first_line": lines + at, "begin": at, "n": 0})
                own[-1]["n"] += 1
            lines += len(codes)
            yield register, block, page, own

    return body


def _one_by_one(pages: DataFrame) -> DataFrame:
    """Pages of one number as one page, their lines by their places."""
    each = F.collect_list(F.transform(F.split("text", "\n"), lambda line, at: F.struct(at.alias("at"), line.alias("line"))))
    lines = F.transform(F.array_sort(F.flatten(each)), lambda x: x["line"])
    return pages.groupBy("register", "page").agg(F.array_join(lines, "\n").alias("text"))


def _scanned(pages: DataFrame, openings, closing: str, fan: int) -> tuple[DataFrame, DataFrame]:
    """The pages (register, page, text), each number once, and of each the documents that it has a part in."""
    modest_batches(pages.sparkSession)
    pages = pages.filter("register is not null and text is not null").select(F.col("register").cast("string").alias("register"), F.col("page").cast("long").alias("page"), "text")
    codes = materialised(coded(pages, openings, closing))
    if codes.groupBy("register", "page").count().filter("count > 1").limit(1).count():
        pages = _one_by_one(pages)
        discard(codes)
        codes = materialised(coded(pages, openings, closing))
    both = _with_entries(codes, entries(codes, len(openings), fan), "block")
    names = [name for name, _ in openings]
    return pages, _in_groups(both, ["register", "block"], ["own", "page"], ["register", "block", "page", "codes", "entry"], _pieces(names), PAGE)


def _documents(pieces: DataFrame, *more: Column) -> DataFrame:
    """register, position, signal, first_line, n_lines, start_page and end_page of the pieces of documents."""
    place = F.struct("block", "page")
    found = pieces.groupBy("register", "position").agg(F.max("signal").alias("signal"), F.min("first_line").alias("first_line"), F.sum("n").alias("n_lines"), F.min(place).alias("first"), F.max(place).alias("last"), *more)
    whole = {c: F.col(c).cast("int").alias(c) for c in ("position", "first_line", "n_lines")}
    return found.select("register", whole["position"], "signal", whole["first_line"], whole["n_lines"], F.col("first.page").alias("start_page"), F.col("last.page").alias("end_page"), *found.columns[7:])


def cuts(pages: DataFrame, openings=fixed.OPENINGS, closing: str = fixed.CLOSING, fan: int = FAN) -> DataFrame:
    """What ``segment`` gives, without the texts, which are read once and never dealt out."""
    _, scanned = _scanned(pages, openings, closing, fan)
    return _documents(scanned.select("register", "block", "page", F.inline("pieces")))


def segment(pages: DataFrame, openings=fixed.OPENINGS, closing: str = fixed.CLOSING, fan: int = FAN) -> DataFrame:
    """register, position, signal, lines, pages and text of every document of every register.

    An opening cuts once the document has some volume; after a closing formula a few short
    signature lines still belong to it.
    """
    pages, scanned = _scanned(pages, openings, closing, fan)
    scanned = scanned.select(F.col("register").alias("own"), "block", F.col("page").alias("number"), "pieces")
    both = pages.join(scanned, (F.col("register") == F.col("own")) & F.col("page").eqNullSafe(F.col("number")))
    texts = T._with(lines_of(F.col("text")), lambda lines: F.transform("pieces", lambda p: F.struct(p["position"].alias("position"), p["signal"].alias("signal"), p["first_line"].alias("first_line"), p["n"].alias("n"), F.array_join(F.slice(lines, p["begin"] + 1, p["n"]), "\n").alias("text"))))
    held = F.array_sort(F.collect_list(F.struct("first_line", "text")))
    whole = _documents(both.select("register", "block", "page", F.inline(texts)), F.array_join(F.transform(held, lambda x: x["text"]), "\n").alias("text"))
    return whole.withColumn("num_words", F.size(T.words(F.col("text"))))


def boundaries(segments: DataFrame) -> DataFrame:
    """register and the line where each stored segment begins: a running sum of line counts."""
    before = Window.partitionBy("register").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return segments.select("register", "position", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).alias("boundary"))
