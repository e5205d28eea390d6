"""Remove chunks of lines that repeat across the whole table; the first occurrence stays.

Chunks are content-defined. A cyclic rolling hash runs over the hashes of the last
``WINDOW`` lines; a chunk ends where it has a local minimum, that is where it is
less than at the line before and not more than at the line after. Borders thus
depend on a few neighbouring lines only, find their place again after an insertion,
and are at least two lines apart, so no short line becomes a chunk of its own
inside a passage. A line of ``LONG_LINE`` characters or more is always a chunk of
its own, which makes borders around paragraphs exact. A chunk can be removed if it
has several lines and ``FEW`` characters or more, or is one long line. Characters
are code points other than blanks, so tabs and scripts without blanks count alike.

Chunks are grouped by two hashes and their length; a group counts as repeated
only if all its bodies are the same bytes. Everything runs in DataFrame
functions. Texts are shuffled twice: as chunks to their groups, where copies are
combined before the shuffle, and as rows to their removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.llm.stores import Stores

WINDOW = 3
LONG_LINE = 50
FEW = 30
_BLANKS = " \t\n\x0b\x0c\r"
#: Bits by which a line's hash is rotated for each line that follows it in the window.
_TURN = 21


def _once(value: Column) -> Column:
    """One row with ``value``: computed here, not again in every function that reads it."""
    return F.explode(F.array(value))


def _row(key: str, text: str) -> list[Column]:
    """What tells rows apart: the key, which may be null or repeated, and a hash of the text."""
    return [F.col(key).alias("key"), F.xxhash64(text).alias("print")]


def _rotated(value: Column, bits: int) -> Column:
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits)) if bits else value


def rolled(hashes: str) -> Column:
    """The cyclic polynomial hash of the window that ends at each line; lines before the first count as 0."""

    def window(x: Column, i: Column) -> Column:
        for back in range(1, WINDOW):
            x = x.bitwiseXOR(_rotated(F.coalesce(F.get(hashes, i - back), F.lit(0)), _TURN * back % 64))
        return x

    return F.transform(hashes, window)


def chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, at, n, size, body): chunks of every text, by first line, number of lines and of characters."""
    rows = docs.where(F.col(text).isNotNull()).select(*_row(key, text), _once(F.split(F.col(text), "\n", -1)).alias("lines"))
    sizes = F.transform("lines", lambda x: F.length(F.translate(x, _BLANKS, "")))
    lines = rows.select("key", "print", _once(F.struct("lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), sizes.alias("w"))).alias("x"))
    lines = lines.select("key", "print", "x.lines", "x.h", "x.w")
    lines = lines.select("key", "print", "lines", "w", _once(rolled("h")).alias("r"))

    def begins(i: Column) -> Column:
        least = (F.get("r", i - 1) < F.get("r", i - 2)) & (F.get("r", i - 1) <= F.get("r", i))
        return (i == 0) | (F.get("w", i) >= LONG_LINE) | (F.get("w", i - 1) >= LONG_LINE) | F.coalesce(least, F.lit(False))

    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), begins)
    cut = lines.select("key", "print", "lines", "w", _once(starts).alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("lines")))
    cut = cut.select("key", "print", "lines", "w", _once(F.arrays_zip(F.col("starts").alias("at"), ends.alias("end"))).alias("spans"))

    def chunk(z: Column) -> Column:
        n = z["end"] - z["at"]
        total = F.aggregate(F.slice("w", z["at"] + 1, n), F.lit(0), lambda s, x: s + x)
        return F.struct(z["at"].alias("at"), n.alias("n"), total.alias("size"), F.array_join(F.slice("lines", z["at"] + 1, n), "\n").alias("body"))

    return cut.select("key", "print", F.inline(F.transform("spans", chunk)))


def _removable(found: DataFrame) -> DataFrame:
    long_enough = (F.col("size") >= LONG_LINE) | (F.col("size") >= FEW) & (F.col("n") > 1)
    place = F.struct(F.col("key").isNull().alias("unnamed"), "key", "print", "at")
    marks = [F.xxhash64("body").alias("h1"), F.hash("body").alias("h2"), F.length("body").alias("length")]
    return found.where(long_enough).select("key", "print", "at", "n", place.alias("place"), *marks, "body")


def repeated(docs: DataFrame, key: str, text: str, stores: Stores) -> DataFrame:
    """(key, print, at, n) of every removable chunk whose bytes occur at an earlier place.

    Places are ordered by key (nulls last), text hash and line.
    """
    found = _removable(chunks(docs, key, text))
    # Equal bytes are one element of the set: a group carries its body once through the shuffle.
    groups = found.groupBy("h1", "h2", "length").agg(F.count("*").alias("times"), F.min("place").alias("first"), F.collect_set("body").alias("bodies"))
    groups = stores.keep(groups.where((F.col("times") > 1) & (F.size("bodies") == 1)).select("h1", "h2", "length", "first"), "groups")
    again = found.drop("body").join(groups, ["h1", "h2", "length"]).where("place <> first")
    return stores.keep(again.select("key", "print", "at", "n"), "again")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and the columns lines and removed_lines.

    Null texts stay null (no lines); an empty text is one empty line. A text
    whose every chunk is a repeat becomes empty. Rows that agree in key and
    text are one occurrence and stay alike. Columns named lines or
    removed_lines are replaced.
    """
    stores = Stores(docs.sparkSession)
    again = repeated(docs, key, text, stores)
    cuts = again.groupBy("key", "print").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("__cuts"))
    cuts = cuts.select(F.col("key").alias("__key"), F.col("print").alias("__print"), "__cuts")
    kept = [c for c in docs.columns if c not in ("lines", "removed_lines")]
    rows = docs.select(*kept, F.xxhash64(text).alias("__own"))
    both = rows.join(cuts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__print")), "left")
    both = both.select(*kept, "__cuts", _once(F.split(F.col(text), "\n", -1)).alias("__lines"))
    spans = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda x: x["at"] + x["n"])).alias("b"),
        F.concat(F.transform("__cuts", lambda x: x["at"]), F.array(F.size("__lines"))).alias("e"),
    )
    left = F.flatten(F.transform("__spans", lambda z: F.slice("__lines", z["b"] + 1, z["e"] - z["b"])))
    both = both.select(*kept, "__cuts", "__lines", F.when(F.col("__cuts").isNotNull(), spans).alias("__spans"))
    removed = F.aggregate("__cuts", F.lit(0), lambda s, x: s + x["n"])
    shown = [F.when(F.col("__cuts").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(c) for c in kept]
    return both.select(*shown, F.coalesce(F.size("__lines"), F.lit(0)).alias("lines"), F.coalesce(removed, F.lit(0)).alias("removed_lines"))
