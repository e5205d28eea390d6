r"""Personal data: base patterns with exact places, and identifiers found by bootstrapped contexts.

The base entities are seeds. Their contexts (the two words before; the word
before with the word after) are lexical patterns. A graph joins patterns and the
values they surround, seeds and unknown identifier-like tokens alike. In each
round a pattern's confidence is the mean confidence of its values, and a
value's confidence is that of all its accepted patterns together (noisy or).
Values that end above ``VALUE_CONFIDENCE`` with two patterns or more are reported
with the kind of the seeds that led to them.

Everything runs in DataFrame functions. A text's places follow from splitting
it at the matches: what lies between two matches has a length, and running sums
of the lengths are taken in one window per text and kind.

Each base expression is written so that it scans long runs once, and means the same:
email and ip start where a run of their first class starts or where the last
match ended; a separator between two digits is made a mark first, so that a
card is one run of one class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelmill.llm.stores import Stores

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = "[0-9][0-9\u0001]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that may be identifiers: five characters or more, with a digit.
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{4,}+"
_BYTE_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

ROUNDS = 3
#: Different values that must support a pattern.
SUPPORT = 5
PATTERN_CONFIDENCE = 0.8
VALUE_CONFIDENCE = 0.9
#: Parts into which the links of one pattern are dealt.
_SALTS = 16


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    doubled = lambda x: F.when(x["i"] % 2 == 0, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)
    return F.aggregate(places, F.lit(0), lambda s, x: s + doubled(x)) % 10 == 0


def _matches(kind: str, text: Column, pattern: str, when: Column) -> Column:
    """Array of (kind, i, gap, value, left, right) for every match of ``pattern``."""
    gaps = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    one = lambda z: F.struct(
        F.lit(kind).alias("kind"),
        F.length(z["gap"]).alias("gap"),
        z["value"].alias("value"),
        # Two whole words before, found from the end, and one after.
        F.reverse(F.regexp_extract(F.reverse(z["gap"]), r"^(\s*+\S*+\s*+\S*+)", 1)).alias("left"),
        F.regexp_extract(z["next"], r"^(\s*+\S*+)", 1).alias("right"),
    )
    zipped = F.arrays_zip(gaps.alias("gap"), values.alias("value"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    found = F.filter(F.transform(zipped, one), lambda x: x["value"].isNotNull())
    return F.when(when, found)


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    card = F.length(digits).between(16, 19) & luhn(digits)
    checks = {"email": F.lit(True), "ip": F.col("value").rlike(_BYTE_PARTS), "card": card, "phone": F.length(digits).between(8, 15)}
    out = F.length(F.regexp_replace("value", "[^0-9]", "")) >= 3
    for kind, check in checks.items():
        out = F.when(F.col("kind") == kind, check).otherwise(out)
    return out


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, print, kind, start, end, value, left, right) of base entities and of tokens (kind ``token``).

    Tokens that overlap a base entity are parts of a known value, not unknown ones, and are left out.
    """
    t = F.col(text)
    marked = F.regexp_replace(F.translate(t, "\u0001", "x"), r"(?<=[0-9])[ -](?=[0-9])", "\u0001")
    digit = t.rlike("[0-9]")
    kinds = [
        _matches("email", t, EMAIL, F.contains(t, F.lit("@"))),
        _matches("ip", t, IP, digit),
        _matches("card", marked, CARD, digit),
        _matches("phone", t, PHONE, F.contains(t, F.lit("+"))),
        _matches("token", t, TOKEN, digit),
    ]
    rows = docs.where(t.isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("print"), *[k.alias(f"k{i}") for i, k in enumerate(kinds)])
    parts = []
    for i in range(len(kinds)):
        parts.append(F.coalesce(F.transform(f"k{i}", lambda x, j: F.struct(j.alias("i"), x["kind"].alias("kind"), x["gap"].alias("gap"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right"))), F.array()))
    flat = rows.select("key", "print", F.inline(F.concat(*parts)))
    before = Window.partitionBy("key", "print", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(before)
    # Rows that agree in key and text agree in their matches: each is kept once.
    placed = flat.dropDuplicates(["key", "print", "kind", "i"]).withColumn("end", end.cast("long"))
    placed = placed.where(_valid()).withColumn("start", F.col("end") - F.length("value"))
    token = F.col("kind") == "token"
    inside = Window.partitionBy("key", "print").orderBy("start", token)
    passed = F.max(F.when(~token, F.col("end"))).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    coming = F.min(F.when(~token, F.col("start"))).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    placed = placed.withColumns({"passed": passed, "coming": coming})
    clear = F.coalesce(F.col("passed") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("coming") >= F.col("end"), F.lit(True))
    placed = placed.where(~token | clear)
    return placed.select("key", "print", "kind", "start", "end", F.translate("value", "\u0001", " ").alias("value"), "left", "right")


def _patterns() -> Column:
    word = r"(\S+)\s*$"
    last = F.lower(F.regexp_extract("left", word, 1))
    two = F.lower(F.regexp_extract("left", r"(\S+\s+\S+)\s*$", 1))
    following = F.lower(F.regexp_extract("right", r"^\s*(\S+)", 1))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), r"\s+", " ")
    before = F.when(two != "", F.concat(F.lit("2 "), plain(two)))
    around = F.when((last != "") & (following != ""), F.concat(F.lit("1 "), plain(last), F.lit(" _ "), plain(following)))
    return F.array_compact(F.array(before, around))


def _commonest(kind: str) -> Column:
    """The kind with the largest sum of n, the first by name among equals; unknown kinds do not count."""
    return F.min(F.when(F.col(kind).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(kind).alias("kind"))))["kind"]


def bootstrap(found: DataFrame, stores: Stores) -> DataFrame:
    """(value, kind) of the tokens that the patterns around the seeds lead to.

    Equal seeds or contexts count once; ties between kinds go to the first by name.
    """
    edges = found.select("kind", F.lower("value").alias("value"), F.explode(_patterns()).alias("pattern")).distinct()
    edges = stores.keep(edges, "edges")
    values = stores.keep(edges.groupBy("value").agg(F.max((F.col("kind") != "token").cast("double")).alias("c"), F.min(F.when(F.col("kind") != "token", F.col("kind"))).alias("seed")), "values")
    salt = F.pmod(F.xxhash64("value"), F.lit(_SALTS)).cast("int").alias("salt")
    links = stores.keep(edges.select("value", "pattern", salt).distinct(), "links")
    trust = values
    for _ in range(ROUNDS):
        known = links.join(trust.select("value", "c", "seed"), "value")
        # Summed by kind first, then by pattern: a hot pattern is combined in every task and has a few rows after that.
        by_kind = known.groupBy("pattern", "seed").agg(F.sum("c").alias("c"), F.count("*").alias("n"), F.sum((F.col("c") >= 0.5).cast("long")).alias("support"))
        patterns = by_kind.groupBy("pattern").agg((F.sum("c") / F.sum("n")).alias("p"), F.sum("support").alias("support"), _commonest("seed").alias("kind"))
        good = patterns.where((F.col("p") >= PATTERN_CONFIDENCE) & (F.col("support") >= SUPPORT))
        good = stores.keep(good.select("*", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt")), "good")
        met = links.join(good, ["pattern", "salt"])
        of_kind = met.groupBy("value", "kind").agg(F.sum(F.log(1 - F.least(F.col("p"), F.lit(0.99)))).alias("doubt"), F.count("*").alias("n"))
        told = of_kind.groupBy("value").agg(F.sum("doubt").alias("doubt"), _commonest("kind").alias("kind"), F.sum("n").alias("n"))
        trust = values.select("value", F.col("c").alias("c0"), F.col("seed").alias("s0")).join(told, "value", "left")
        trust = trust.select(
            "value",
            F.greatest("c0", F.when(F.col("n") >= 2, 1 - F.exp("doubt")).otherwise(0.0)).alias("c"),
            F.coalesce("s0", F.when(F.col("n") >= 2, F.col("kind"))).alias("seed"),
            F.col("c0"),
        )
        trust = stores.keep(trust, "trust")
    return trust.where((F.col("c0") == 0) & (F.col("c") >= VALUE_CONFIDENCE) & F.col("seed").isNotNull()).select("value", F.col("seed").alias("kind"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Places count code points, the end is exclusive. A null or empty text has no
    spans (and the SHA-256 of the empty string). Rows that agree in key and text get
    the same spans; a null key is a key. Found tokens that overlap a base span
    are left out. Other columns are ignored.
    """
    stores = Stores(docs.sparkSession)
    found = stores.keep(occurrences(docs, key, text), "found")
    more = bootstrap(found, stores).withColumnRenamed("kind", "as")
    tokens = found.where("kind = 'token'").withColumn("v", F.lower("value")).join(more.withColumnRenamed("value", "v"), "v")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct(order.alias("o"), "start", "end", "kind", "base")
    base = found.where("kind <> 'token'").select("key", "print", "kind", "start", "end", F.lit(True).alias("base"))
    extra = tokens.select("key", "print", F.col("as").alias("kind"), "start", "end", F.lit(False).alias("base"))
    grouped = base.unionByName(extra).groupBy("key", "print").agg(F.array_sort(F.collect_list(span)).alias("all"))
    seeds = F.filter("all", lambda x: x["base"])
    grouped = grouped.select(F.col("key").alias("__key"), "print", "all", F.explode(F.array(seeds)).alias("seeds"))
    free = F.filter("all", lambda x: x["base"] | ~F.exists("seeds", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("seeds", lambda x: x["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("__print"))
    both = rows.join(grouped, F.col("doc_id").eqNullSafe(F.col("__key")) & (F.col("__print") == F.col("print")), "left")
    return both.select("doc_id", *[counted(k) for k in KINDS], F.sha2(F.coalesce(told(F.col("seeds")), F.lit("")), 256).alias("base_sha256"), F.coalesce(told(free), F.lit("")).alias("spans"))
