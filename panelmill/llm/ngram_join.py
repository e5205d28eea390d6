"""Exact similarity join of documents on sets of word shingles, and the groups it links.

Two documents link when the Jaccard similarity of their shingle sets is at
least ``percent`` / 100. The join filters by prefix: shingles are ordered
rare first, and two linked sets must share one of the first
n - ceil(percent * n / 100) + 1 of each. Length, positional and suffix filters
cut the candidates; every pair that is left is verified once, on whole texts.

Rare first: one pass counts all shingles in a table of ``2 ** SLOT_BITS`` hashed
slots. The order is (count of the slot, hash), the same for every document, so
the join stays exact whatever falls into one slot; the table has a fixed size
at every scale and is the only thing that is broadcast.

Copies and large groups: equal sets become one class first. The first rounds link
each class to pivots of its prefix shingles, which is linear in the postings and
joins a group of near copies without its pairs. The pivot of a shingle is the
class with the fewest rarer shingles: of near copies that is the one with the
fewest changes, to which all others are closest, so what stays apart from it
is cut by the positional filter from almost all the rest as well. Each class is
verified against a few pivots with which it shares most of its prefix, then against
more of those to which it is not joined yet. While many pairs are left, further rounds
compare each class with the pivot of the largest other group of a shingle. The
last round takes the shingles that still meet in different groups and verifies
all of those pairs that the filters leave, so no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelmill.llm import kernels as K
from panelmill.llm.graph import components
from panelmill.llm.idfilter import passing
from panelmill.llm.stores import Stores

SLOT_BITS = 18
_PART = 1 << 12
_HISTOGRAM = 64
#: Postings of one shingle beyond what all slots hold on average that one task takes.
_HOT = 1 << 16
_SALT = 0xFFFF
#: Classes that one task remembers, to leave out postings of copies.
_SEEN = 1 << 16
#: Pivots that a class is compared with in the first rounds; the last round takes all that is left.
_PIVOT_TRIES = (4, 12)
#: Pairs for each posting from which another round of pivots comes before the last one.
_MANY_PAIRS = 64

_SCAN = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("spread", pa.list_(pa.int32())), ("part", pa.int32()), ("counts", pa.binary())]
)
_POSTINGS = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("np", pa.int64())])


def _scan(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            ids, rows = batch.column(0), []
            for s in K.shingles(batch.column(1), size):
                s = np.unique(s)
                slots += 0 if not len(s) else np.bincount(s >> np.uint64(64 - SLOT_BITS), minlength=len(slots)) if len(s) > 1 << 16 else 0
                if 0 < len(s) <= 1 << 16:
                    np.add.at(slots, (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64), 1)
                rows.append(
                    (
                        len(s),
                        np.sum(K.mix(s), dtype=np.uint64).astype(np.int64),
                        np.sum(K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64).astype(np.int64),
                        np.bincount((s >> np.uint64(8)) & np.uint64(_HISTOGRAM - 1), minlength=_HISTOGRAM).astype(np.int32),
                    )
                )
            n, fp, fp2, spread = zip(*rows, strict=True) if rows else ((), (), (), ())
            none = [None] * len(rows)
            yield K.batch_of(_SCAN, ids, n, fp, fp2, list(spread), none, none)
        for part in range(len(slots) // _PART):
            counts = slots[part * _PART : (part + 1) * _PART]
            if counts.any():
                yield K.batch_of(_SCAN, [None], [None], [None], [None], [None], [part], [counts.astype("<i8").tobytes()])

    return run


def _add_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the slot parts that a partition holds; there are as many parts as the table has, whatever the input."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            values = np.frombuffer(counts, "<i8")
            sums[part] = sums[part] + values if part in sums else values
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<i8").tobytes() for v in sums.values()])], names=["part", "counts"])


def _slot_table(scan: DataFrame) -> np.ndarray:
    """The counts of all slots, 2 MB at every scale."""
    parts = scan.where("part is not null").select("part", "counts").repartition(8, "part")
    table = np.zeros(1 << SLOT_BITS, np.int64)
    for row in parts.mapInArrow(_add_parts, "part int, counts binary").collect():
        table[row.part * _PART : (row.part + 1) * _PART] = np.frombuffer(row.counts, "<i8")
    return table


def _postings(size: int, percent: int, slots):
    """Prefix postings (key, fp, np): the last two bytes of a key are the salt (1 or more) of a hot shingle, else 0; np holds size and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        usual = int(2 * table.mean())
        salts = np.clip((table - usual) // _HOT, 0, _SALT).astype(np.uint64)
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            keys, fps, packed = [], [], []
            pending = 0
            for s in K.shingles(batch.column(0), size):
                s = np.unique(s)
                n = len(s)
                if not n:
                    continue
                fp = np.sum(K.mix(s), dtype=np.uint64)
                same = n, int(fp), int(np.sum(s, dtype=np.uint64))
                if same in seen:  # copies within a task; those of other tasks are dropped after the shuffle
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(same)
                take = n - -(-percent * n // 100) + 1
                slot = (s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                order = np.lexsort((s, table[slot]))[:take]
                many = salts[slot[order]]
                salt = np.where(many > 0, K.mix(fp[None]) % np.maximum(many, np.uint64(1)) + np.uint64(1), np.uint64(0))
                keys.append((s[order] & ~np.uint64(_SALT)) | salt)
                fps.append(np.full(take, fp))
                packed.append((n << 32) + np.arange(take, dtype=np.int64))
                pending += take
                if pending > 1 << 18:
                    yield K.batch_of(_POSTINGS, K.signed(np.concatenate(keys)), K.signed(np.concatenate(fps)), np.concatenate(packed))
                    keys, fps, packed, pending = [], [], [], 0
            if pending:
                yield K.batch_of(_POSTINGS, K.signed(np.concatenate(keys)), K.signed(np.concatenate(fps)), np.concatenate(packed))

    return run


def _can_reach(n: Column, m: Column, rest: Column, percent: int) -> Column:
    """Length and positional filter: ``rest`` is the most that the sets can still share."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (rest * (100 + percent) >= (n + m) * percent)


def _size(np_: str) -> Column:
    return F.shiftright(np_, 32)


def _place(np_: str) -> Column:
    return F.col(np_).bitwiseAND(F.lit(0xFFFFFFFF))


def _positional(a: str, b: str, percent: int) -> Column:
    rest = F.least(_size(a) - _place(a), _size(b) - _place(b))
    return _can_reach(_size(a), _size(b), rest, percent)


def _verify(size: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            texts = zip(K.shingles(batch.column(2), size), K.shingles(batch.column(3), size), strict=True)
            for x, y, (left, right) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                left, right = np.unique(left), np.unique(right)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both and 100 * both >= percent * (len(left) + len(right) - both):
                    a.append(x)
                    b.append(y)
            yield K.batch_of(schema, a, b)

    return run


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, stores: Stores, size: int, percent: int) -> DataFrame:
    """Edges (a, b) of representative rows among candidate pairs of classes (fa, fb)."""
    left = classes.select(F.col("fp").alias("fa"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("spread").alias("sa"))
    right = classes.select(F.col("fp").alias("fb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("spread").alias("sb"))
    named = pairs.join(left, "fa").join(right, "fb").where("a <> b")
    named = named.where(_may_share("sa", "sb", F.col("na"), F.col("nb"), percent))
    # The text of a is sent on to b once per pair, so b is the side with many partners: the pivot.
    named = stores.keep(named.select("a", "b").distinct(), "pairs")
    wanted = named.select(F.col("a").alias("row")).unionByName(named.select(F.col("b").alias("row"))).distinct()
    held = passing(texts, "row", wanted)
    told = named.join(held.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a")
    told = told.join(held.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")
    found = told.select("a", "b", "ta", "tb").mapInArrow(_verify(size, percent), "a long, b long")
    return stores.keep(found, "edges")


def _central(np_: str = "np", fp: str = "fp") -> Column:
    """Sorts classes of a shingle by their number of rarer shingles, the larger set first among equals."""
    return F.struct(_place(np_).alias("place"), (-_size(np_)).alias("less"), F.col(fp).alias("fp"), F.col(np_).alias("np"))


def _may_share(a: str, b: str, na: Column, nb: Column, percent: int) -> Column:
    """Suffix filter on histograms; an unknown one passes."""
    most = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(_can_reach(na, nb, most.cast("long"), percent), F.lit(True))


def _placed(shared: DataFrame, place: DataFrame) -> DataFrame:
    """(key, fp, np, group): a class that is linked to nothing is a group of its own."""
    own = F.struct(F.lit(True).alias("alone"), F.col("fp").alias("at"))
    return shared.select("key", "fp", "np").join(place, "fp", "left").withColumn("group", F.coalesce("group", own))


def _open(placed: DataFrame) -> DataFrame:
    """The postings of shingles that several groups share."""
    open_keys = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    return placed.join(open_keys, "key", "left_semi")


def _others(left_over: DataFrame, percent: int) -> DataFrame:
    """(fp, pf): every class of a shingle with the pivot of the largest group there that is not its own."""
    groups = left_over.groupBy("key", "group").agg(F.count("*").alias("n"), F.min(_central()).alias("pivot"))
    by_size = Window.partitionBy("key").orderBy(F.desc("n"), "group")
    top = groups.withColumn("rank", F.row_number().over(by_size)).where("rank <= 2")
    top = top.select("key", "rank", F.col("group").alias("of"), F.col("pivot.fp").alias("pf"), F.col("pivot.np").alias("pn"))
    # A member of the largest group meets the second one, everyone else the largest.
    largest = F.max(F.when(F.col("rank") == 1, F.col("of"))).over(Window.partitionBy("key"))
    met = left_over.join(top.withColumn("largest", largest), "key").where((F.col("group") == F.col("largest")) == (F.col("rank") == 2))
    return met.where(_positional("np", "pn", percent)).select("fp", "pf")


def _places(classes: DataFrame, groups: DataFrame, stores: Stores) -> DataFrame:
    """(fp, group) of the classes that are linked so far."""
    at = classes.join(groups, F.col("rep") == F.col("node")).groupBy("fp").agg(F.min("component").alias("at"))
    return stores.keep(at.select("fp", F.struct(F.lit(False).alias("alone"), "at").alias("group")), "places")


def _joined(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (a, b) that link what ``groups`` (node, component) and the edges ``found`` link: each group as a star."""
    return groups.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)


def _apart(pairs: DataFrame, place: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of classes that are not in one group yet."""
    left = place.select(F.col("fp").alias(a), F.col("group").alias("ga"))
    right = place.select(F.col("fp").alias(b), F.col("group").alias("gb"))
    return pairs.join(left, a, "left").join(right, b, "left").where("ga is null or gb is null or ga <> gb").drop("ga", "gb")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id: long, text).

    component_id is the smallest doc_id reachable by links, the row's own
    included. Null, empty and wordless texts have no shingles and link with
    nothing. Texts of fewer than ``size`` words are one shingle. Rows without
    doc_id come back with a null component and link with nothing. Repeated
    doc_ids are one node of the graph; each row keeps its own text. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    stores = Stores(spark)
    rows = docs.select("doc_id", "text")
    texts = rows.where("doc_id is not null").select(F.col("doc_id").alias("row"), "text")
    scan = stores.keep(rows.mapInArrow(_scan(size), "doc_id long, n long, fp long, fp2 long, spread array<int>, part int, counts binary"), "scan")
    slots = spark.sparkContext.broadcast(_slot_table(scan))
    meta = scan.where("part is null").select("doc_id", "n", "fp", "fp2", "spread")
    known = meta.where("doc_id is not null and n > 0")
    classes = stores.keep(known.groupBy("n", "fp", "fp2").agg(F.min("doc_id").alias("rep"), F.any_value("spread").alias("spread")), "classes")

    postings = texts.select("text").mapInArrow(_postings(size, percent, slots), "key long, fp long, np long")
    # One row per class and key first: a pivot with copies would else count as its own neighbour.
    by_key = Window.partitionBy("key").orderBy("fp", "np")
    once = postings.withColumn("previous", F.lag("fp").over(by_key)).where("previous is null or previous <> fp").drop("previous")
    # Rows of a shingle are kept only where several classes share it; of a hot shingle
    # the pivot always, as the other class may have another salt.
    whole = Window.partitionBy("key")
    shared = once.withColumns({"pivot": F.min(_central()).over(whole), "many": F.count("*").over(whole)})
    salted = F.col("key").bitwiseAND(F.lit(_SALT)) != 0
    shared = shared.where((F.col("many") > 1) | (salted & (F.col("fp") == F.col("pivot.fp"))))
    shingle = F.col("key").bitwiseAND(F.lit(~_SALT)).alias("key")
    shared = stores.keep(shared.select(shingle, "fp", "np", F.col("pivot.fp").alias("pf"), F.col("pivot.np").alias("pn")), "shared")

    direct = shared.where("fp <> pf").where(_positional("np", "pn", percent)).select("fp", "pf")
    heads = shared.where("fp = pf")
    hubs = heads.groupBy("key").agg(F.min(_central()).alias("hub"), F.count("*").alias("salts")).where("salts > 1")
    between = heads.join(hubs, "key").where("fp <> hub.fp").select("fp", "np", F.col("hub.fp").alias("pf"), F.col("hub.np").alias("pn"))
    tries = direct.unionByName(between.where(_positional("np", "pn", percent)).select("fp", "pf"))
    tries = stores.keep(tries.groupBy("fp", "pf").agg(F.count("*").alias("common")), "tries")

    tried = classes.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1").select(F.col("fp").alias("fa"), F.col("fp").alias("fb"))
    groups, place = None, None

    def compared(ahead: DataFrame, most: int) -> None:
        """Verify up to ``most`` of the (fp, pf, common) of each class that are apart and new; find the groups again."""
        nonlocal groups, place, tried
        if place is not None:
            known_pairs = tried.select(F.col("fa").alias("fp"), F.col("fb").alias("pf"))
            ahead = _apart(ahead, place, "fp", "pf").join(known_pairs, ["fp", "pf"], "left_anti")
        by_common = Window.partitionBy("fp").orderBy(F.desc("common"), "pf")
        best = ahead.withColumn("rank", F.row_number().over(by_common)).where(F.col("rank") <= most)
        best = stores.keep(best.select(F.col("fp").alias("fa"), F.col("pf").alias("fb")), "best")
        # Classes that share one fingerprint are compared in the first round.
        found = _verified(best.unionByName(tried) if place is None else best, classes, texts, stores, size, percent)
        tried = best if place is None else tried.unionByName(best)
        groups = components(found if groups is None else _joined(groups, found), stores)
        place = _places(classes, groups, stores)

    for most in _PIVOT_TRIES:
        compared(tries, most)
    pairs_before = None
    while True:
        left_over = stores.keep(_open(_placed(shared, place)), "open")
        pairs = left_over.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
        rows, pairs = pairs.agg(F.sum("s"), F.sum(((F.col("s") * F.col("s") - F.col("q")) / 2).cast("double"))).first()
        if not rows or pairs <= _MANY_PAIRS * rows or (pairs_before is not None and pairs > 0.8 * pairs_before):
            break
        pairs_before = pairs
        others = stores.keep(_others(left_over, percent).groupBy("fp", "pf").agg(F.count("*").alias("common")), "others")
        compared(others, max(_PIVOT_TRIES))

    one_spread = classes.groupBy("fp").agg(F.count("*").alias("k"), F.any_value("spread").alias("spread")).select("fp", F.when(F.col("k") == 1, F.col("spread")).alias("spread"))
    shown = stores.keep(left_over.join(one_spread, "fp"), "shown")
    one, two = shown.alias("x"), shown.alias("y")
    near = _positional("x.np", "y.np", percent) & _may_share("x.spread", "y.spread", _size("x.np"), _size("y.np"), percent)
    met = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.group") != F.col("y.group")) & near)
    rest = met.select(F.col("x.fp").alias("fa"), F.col("y.fp").alias("fb")).distinct()
    done = tried.select(F.least("fa", "fb").alias("fa"), F.greatest("fa", "fb").alias("fb"))
    more = _verified(rest.join(done, ["fa", "fb"], "left_anti"), classes, texts, stores, size, percent)

    final = components(_joined(groups, more), stores)
    ends = classes.join(final, F.col("rep") == F.col("node"), "left").select("n", "fp", "fp2", F.coalesce("component", "rep").alias("component_id"))
    linked = known.join(ends, ["n", "fp", "fp2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = meta.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    stores.drop(shared, left_over, shown)
    return linked.unionByName(alone)
