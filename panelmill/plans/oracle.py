"""The same results in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from panelmill.plans import catalog

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, cents"
ORDER = KEY
ROW_TEXT = f"concat_ws('|', {KEY})"
MINED = ["region", "item", "season", "source", "lot"]
MEASURES = ["area", "production", "o_totalprice", "p_retailprice", "c_acctbal", "l_discount", "l_tax", "yield_value"]
LOGGED = ["production", "o_totalprice", "yield_value"]
SPACE = catalog.SPACE

OBS = """obs AS (
  SELECT r_name AS region, p_type AS item, CAST(year(o_orderdate) AS INTEGER) AS yr,
    c_mktsegment AS segment, l_linestatus AS source, l_returnflag AS season,
    CASE WHEN l_quantity < 10 THEN 'S' WHEN l_quantity < 25 THEN 'M' ELSE 'L' END AS lot,
    l_quantity AS area, l_extendedprice AS production, l_discount, l_tax, o_totalprice,
    p_retailprice, c_acctbal, l_extendedprice / l_quantity AS yield_value,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""
LABELLED = OBS + """, cut AS (SELECT median(yield_value) AS threshold FROM obs WHERE yr <= 2000),
  lab AS (SELECT obs.*, threshold, CASE WHEN yield_value > threshold THEN 'High' ELSE 'Low' END AS level
    FROM obs, cut)"""
EVENTS = """ev AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, value,
    CASE WHEN value > 50 THEN 'High' ELSE 'Low' END AS level FROM events),
  daily AS (SELECT user_id, day, CASE WHEN avg(value) > 50 THEN 'High' ELSE 'Low' END AS level
    FROM ev GROUP BY ALL)"""


def _items(source: str, columns: list[str]) -> str:
    """Rows (rid, item), one per row and column."""
    texts = ", ".join(f"'{c}=' || {c}" for c in columns)
    return (
        f"num AS (SELECT row_number() OVER () AS rid, * FROM {source}), "
        f"it AS (SELECT rid, unnest([{texts}]) AS item FROM num), "
        "n AS (SELECT count(*) AS n FROM num)"
    )


def _sets(support: float) -> str:
    """Item sets up to size 3 by self-joins of the items of a row."""
    return f"""raw AS (
      SELECT [item] AS items, count(*) AS count FROM it GROUP BY item
      UNION ALL
      SELECT [a.item, b.item], count(*) FROM it a JOIN it b ON a.rid = b.rid AND a.item < b.item
        GROUP BY a.item, b.item
      UNION ALL
      SELECT [a.item, b.item, c.item], count(*) FROM it a JOIN it b ON a.rid = b.rid AND a.item < b.item
        JOIN it c ON a.rid = c.rid AND b.item < c.item GROUP BY a.item, b.item, c.item),
    sets AS (SELECT array_to_string(items, '|') AS items, items AS list, CAST(len(items) AS INTEGER) AS size,
      count, CAST(count AS DOUBLE) / n AS support FROM raw, n WHERE CAST(count AS DOUBLE) / n >= {support})"""


def _rules(confidence: float) -> str:
    return f"""parts AS (
      SELECT [list[1]] AS a, [list[2]] AS c, support FROM sets WHERE size = 2
      UNION ALL SELECT [list[2]], [list[1]], support FROM sets WHERE size = 2
      UNION ALL SELECT [list[1]], [list[2], list[3]], support FROM sets WHERE size = 3
      UNION ALL SELECT [list[2]], [list[1], list[3]], support FROM sets WHERE size = 3
      UNION ALL SELECT [list[3]], [list[1], list[2]], support FROM sets WHERE size = 3
      UNION ALL SELECT [list[1], list[2]], [list[3]], support FROM sets WHERE size = 3
      UNION ALL SELECT [list[1], list[3]], [list[2]], support FROM sets WHERE size = 3
      UNION ALL SELECT [list[2], list[3]], [list[1]], support FROM sets WHERE size = 3),
    rules AS (SELECT parts.a, parts.c, parts.support, parts.support / sa.support AS confidence,
        parts.support / sa.support / sc.support AS lift
      FROM parts JOIN sets sa ON sa.items = array_to_string(parts.a, '|')
        JOIN sets sc ON sc.items = array_to_string(parts.c, '|')
      WHERE parts.support / sa.support >= {confidence})"""


MINING = LABELLED + ", " + _items("lab", [*MINED, "level"]) + ", " + _sets(0.05)
TRAIN_MINING = (
    LABELLED
    + ", tr AS (SELECT * FROM lab WHERE yr <= 2000), "
    + _items("tr", [*MINED, "level"])
    + ", "
    + _sets(0.05)
    + ", "
    + _rules(0.6)
)
LOT_MINING = OBS + ", " + _items("obs", MINED) + ", " + _sets(0.03)
FLAT_RULES = """SELECT array_to_string(a, '|') AS antecedent, array_to_string(c, '|') AS consequent,
  round(support, 8) AS support, round(confidence, 8) AS confidence, round(lift, 8) AS lift FROM rules"""
ROW_ITEMS = "[" + ", ".join(f"'{c}=' || {c}" for c in MINED) + "]"

GUESSES = OBS + """, tr AS (SELECT * FROM obs WHERE yr <= 2000), te AS (SELECT * FROM obs WHERE yr > 2000),
  g AS (
    SELECT te.*, m.guess, 'by_region' AS variant FROM te
      LEFT JOIN (SELECT region, avg(yield_value) AS guess FROM tr GROUP BY ALL) m USING (region)
    UNION ALL BY NAME SELECT te.*, m.guess, 'by_item' AS variant FROM te
      LEFT JOIN (SELECT item, avg(yield_value) AS guess FROM tr GROUP BY ALL) m USING (item)
    UNION ALL BY NAME SELECT te.*, m.guess, 'by_lot' AS variant FROM te
      LEFT JOIN (SELECT lot, avg(yield_value) AS guess FROM tr GROUP BY ALL) m USING (lot)),
  means AS (SELECT variant, avg(yield_value) AS mu FROM g GROUP BY ALL),
  wide AS (SELECT variant, 1 - sum((yield_value - guess) ** 2) / sum((yield_value - mu) ** 2) AS r2,
      sqrt(avg((yield_value - guess) ** 2)) AS rmse, avg(abs(yield_value - guess)) AS mae, count(*) AS n
    FROM g JOIN means USING (variant) GROUP BY variant),
  long AS (SELECT variant, 'r2' AS metric, r2 AS value FROM wide UNION ALL SELECT variant, 'rmse', rmse FROM wide
    UNION ALL SELECT variant, 'mae', mae FROM wide)"""


def _curve(source: str, label: str, by: str) -> str:
    """Cumulated counts per group and distinct score."""
    group = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""c AS (SELECT {group}score, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {source}
      GROUP BY {group}score),
    k AS (SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
      sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n,
      row_number() OVER ({part} ORDER BY score DESC) AS idx, count(*) OVER ({part}) AS points,
      lead(pos) OVER ({part} ORDER BY score DESC) AS next_pos, lead(neg) OVER ({part} ORDER BY score DESC) AS next_neg
      FROM c),
    pts AS (SELECT {group}CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 0 AS idx,
        any_value(points) AS points, true AS corner FROM k WHERE p > 0 AND n > 0 {f'GROUP BY {by}' if by else 'HAVING count(*) > 0'}
      UNION ALL SELECT {group}score, round(CAST(fp AS DOUBLE) / n, 8), round(CAST(tp AS DOUBLE) / p, 8), idx, points,
        idx = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg FROM k WHERE p > 0 AND n > 0)"""


DOCS = """docs AS (SELECT doc_id, lang, quality, toxic, CAST(n_chars AS DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id))"""


def _class_scores(cosine: bool = False, name: str = "s") -> str:
    score = "sum(x * m) / sqrt(sum(x * x) * sum(m * m))" if cosine else "-sum((x - m) ** 2)"
    return f"""u{name} AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
      FROM embeddings),
    m{name} AS (SELECT label AS class, pos, avg(x) AS m FROM u{name} GROUP BY ALL),
    {name} AS (SELECT vec_id, CAST(class AS VARCHAR) AS class, round({score}, 9) AS score,
      CAST(label = class AS INTEGER) AS is_class FROM u{name} JOIN m{name} USING (pos) GROUP BY vec_id, label, class)"""


def _areas(scores: str = "s", name: str = "areas") -> str:
    """Areas as the share of ordered pairs, ties half."""
    return f"""{name}c AS (SELECT class, score, sum(is_class) AS pos, sum(1 - is_class) AS neg FROM {scores}
      GROUP BY class, score),
    {name}w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY score
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}c),
    {name} AS (SELECT class, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (sum(pos) * sum(neg)) AS auc,
      CAST(sum(pos) AS BIGINT) AS support FROM {name}w GROUP BY class)"""


def _space() -> str:
    """Observations with the measures logged and scaled to 0..1, the raw ones as raw_*."""
    logged = ", ".join((f"ln(1 + {c})" if c in LOGGED else c) + f" AS f_{c}" for c in MEASURES)
    scaled = ", ".join(
        f"(f_{c} - min(f_{c}) OVER ()) / (max(f_{c}) OVER () - min(f_{c}) OVER ()) AS s_{c}" for c in MEASURES
    )
    return f"{OBS}, lg AS (SELECT *, {logged} FROM obs), sp AS (SELECT *, {scaled} FROM lg)"


def _gap(centre: list[float]) -> str:
    return " + ".join(f"(s_{c} - {x}) * (s_{c} - {x})" for c, x in zip(MEASURES, centre))


def _clustered() -> str:
    distances = ", ".join(f"{_gap(c)} AS d{i}" for i, c in enumerate(catalog.CENTROIDS))
    least = "least(d0, d1, d2, d3)"
    return (
        f"{_space()}, ds AS (SELECT *, {distances} FROM sp), cl AS (SELECT *, CAST(CASE WHEN d0 = {least} THEN 0 "
        f"WHEN d1 = {least} THEN 1 WHEN d2 = {least} THEN 2 ELSE 3 END AS INTEGER) AS cluster FROM ds)"
    )


def _silhouette(source: str, columns: list[str]) -> str:
    """Squared-distance silhouettes from the moments of the clusters."""
    norm = " + ".join(f"{c} * {c}" for c in columns)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in columns)
    dot = " + ".join(f"{c} * m_{c}" for c in columns)
    return f"""mom AS (SELECT cluster AS other, count(*) AS size, avg({norm}) AS norm, {means} FROM {source} GROUP BY cluster),
    ms AS (SELECT {KEY}, cluster, other, size, greatest({norm} + norm - 2 * ({dot}), 0) AS d FROM {source}, mom),
    ab AS (SELECT {KEY}, cluster, max(CASE WHEN other = cluster THEN d * size / (size - 1) END) AS a,
      min(CASE WHEN other <> cluster THEN d END) AS b FROM ms GROUP BY ALL),
    sil AS (SELECT *, (b - a) / greatest(a, b) AS silhouette FROM ab)"""


def _quality(score: str) -> str:
    return (
        f"CASE WHEN {score} < 0 THEN 'Poor' WHEN {score} < 0.35 THEN 'Weak' WHEN {score} < 0.5 THEN 'Fair' "
        "ELSE 'Strong' END"
    )


BOTH_AREAS = ", ".join([_class_scores(False, "s"), _areas("s", "fa"), _class_scores(True, "t"), _areas("t", "la")])
SPACED = [f"s_{c}" for c in MEASURES]
PROFILE_MEANS = ", ".join(f"round(avg({c}), 4) AS mean_{c}" for c in MEASURES)
PROFILE_LEVELS = ", ".join(
    f"CASE WHEN avg({c}) >= (SELECT avg({c}) FROM cl) THEN 'HIGH' ELSE 'LOW' END AS level_{c}" for c in SPACE
)


def _modes(source: str, key: str, columns: list[str], prefix: str = "") -> str:
    """One CTE per column with the most frequent value per key, smallest on ties."""
    return ", ".join(
        f"""mode_{c} AS (SELECT {key}, {c} AS {prefix}{c} FROM (SELECT {key}, {c},
          row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {c}) AS rn FROM {source}
          GROUP BY {key}, {c}) WHERE rn = 1)"""
        for c in columns
    )


PROFILED = ["region", "item", "segment", "source"]
PROFILE = f"""{_clustered()}, {_modes("cl", "cluster", PROFILED, "dominant_")},
  prof AS (SELECT cluster, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM cl), 6) AS percent,
    {PROFILE_MEANS}, {PROFILE_LEVELS} FROM cl GROUP BY cluster),
  full_profile AS (SELECT * FROM prof {' '.join(f'JOIN mode_{c} USING (cluster)' for c in PROFILED)})"""
_RULE_WORDS = " || ', ' || ".join(f"'{c} ' || lower(level_{c})" for c in ("area", "production", "yield_value"))

UNIT = "CAST('0x' || substr(md5('42|' || i || '|{j}'), 1, 8) AS BIGINT) / 4294967296.0"
_UNIFORM = ", ".join(
    f"(SELECT min(s_{c}) FROM sp) + {UNIT.format(j=j)} * (SELECT max(s_{c}) - min(s_{c}) FROM sp) AS q_{c}"
    for j, c in enumerate(MEASURES)
)
_PROBE_GAP = " + ".join(f"(s_{c} - q_{c}) ** 2" for c in MEASURES)
SAMPLED = f"md5(concat_ws('|', '42', {ROW_TEXT}))"

LOW_HIGH_FLAGS = """CAST(coalesce({0} = 'High', false) AS INTEGER) AS prev_high,
  CAST(coalesce({0} = 'Low', false) AS INTEGER) AS prev_low,
  CAST(coalesce({0} = {1}, false) AS INTEGER) AS prev2_persistent,
  CAST(coalesce({0} = {1} AND {1} = {2}, false) AS INTEGER) AS prev3_persistent"""


def _asof(levels: str) -> str:
    """Per query (user, day) the levels of the last three earlier days."""
    return f"""ranked AS (SELECT q.user_id, q.day, l.level, row_number() OVER (PARTITION BY q.user_id, q.day
      ORDER BY l.day DESC) AS rn FROM (SELECT DISTINCT user_id, day FROM ev) q
      JOIN {levels} l ON l.user_id = q.user_id AND l.day < q.day),
    prev AS (SELECT user_id, day, max(level) FILTER (rn = 1) AS asof1, max(level) FILTER (rn = 2) AS asof2,
      max(level) FILTER (rn = 3) AS asof3 FROM ranked GROUP BY ALL)"""


def _patterns(n: int) -> str:
    steps = ", ".join(f"lead(level, {i}) OVER w AS step{i + 1}" for i in range(n))
    names = ", ".join(f"step{i + 1}" for i in range(n))
    return f"""WITH {EVENTS}, g AS (SELECT {steps} FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)),
    f AS (SELECT * FROM g WHERE step{n} IS NOT NULL), t AS (SELECT count(*) AS total FROM f)
    SELECT {names}, count(*) AS count, any_value(total) AS total, round(count(*) / any_value(total)::DOUBLE, 8) AS support
    FROM f, t GROUP BY {names} HAVING round(count(*) / any_value(total)::DOUBLE, 4) >= 0.1"""


def _profile_row(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS count, round(avg({column}), 4) AS mean, "
        f"round(median({column}), 4) AS median, round(stddev_samp({column}), 4) AS std, "
        f"round(min({column})::DOUBLE, 4) AS min, round(max({column})::DOUBLE, 4) AS max FROM obs"
    )


NUMERIC = ["yr", *MEASURES]
CORRELATION = f"WITH {OBS}, r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature, '{b}' AS other, "
    + ("1.0::DOUBLE AS r" if a == b else f"corr({a}, {b}) AS r FROM obs")
    for a in NUMERIC
    for b in NUMERIC
) + ")"

FEATURES = sorted(catalog.SPEC.features_of("advanced"))

SQL: dict[str, str] = {
    "observations": f"WITH {OBS} SELECT * REPLACE (round(yield_value, 8) AS yield_value) FROM obs",
    "label_threshold": f"""WITH {OBS} SELECT region, yr, CASE WHEN yield_value > 2000 THEN 'High' ELSE 'Low' END AS level,
      count(*) AS rows FROM obs GROUP BY ALL""",
    "label_by_train_median": f"""WITH {LABELLED} SELECT region, level, count(*) AS rows,
      round(max(threshold), 4) AS threshold FROM lab GROUP BY ALL""",
    "interactions": f"""WITH {OBS} SELECT item || ' | ' || season AS item_x_season, item || ' | ' || source AS item_x_source,
      count(*) AS rows FROM obs GROUP BY ALL""",
    "log1p_clipped": f"""WITH {OBS} SELECT region, round(avg(ln(1 + greatest(c_acctbal, 0))), 6) AS log_balance,
      round(avg(ln(1 + greatest(area, 0))), 6) AS log_area FROM obs GROUP BY ALL""",
    "period_split": f"""WITH {OBS} SELECT CASE WHEN yr <= 2000 THEN 'train' ELSE 'test' END AS part, region, count(*) AS rows,
      min(yr) AS first, max(yr) AS last FROM obs GROUP BY ALL""",
    "trimmed_filter": f"""WITH {OBS} SELECT region, source, yr, count(*) AS rows FROM obs
      WHERE trim(region) = 'ASIA' AND trim(source) = 'O' GROUP BY ALL""",
    "feature_selection": f"""WITH {OBS} SELECT region, yr, round(avg(yield_value), 4) AS yield_value,
      0::BIGINT AS production FROM obs GROUP BY ALL""",
    "constraint_check": f"""WITH {OBS}
      SELECT 'area' AS rule, count(*) AS violations FROM obs WHERE NOT area BETWEEN 5 AND 45
      UNION ALL SELECT 'balance', count(*) FROM obs WHERE c_acctbal < 0
      UNION ALL SELECT 'discount', count(*) FROM obs WHERE l_discount > 0.08::DOUBLE
      UNION ALL SELECT 'segment', count(*) FROM obs WHERE segment NOT IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""",
    "outside_typical": f"""WITH {OBS}, b AS (SELECT min(o_totalprice) AS t0, max(o_totalprice) AS t1, min(yield_value) AS y0,
        max(yield_value) AS y1, min(c_acctbal) AS c0, max(c_acctbal) AS c1 FROM obs WHERE yr <= 1995)
      SELECT region, count(*) FILTER (o_totalprice < t0 OR o_totalprice > t1) AS o_totalprice_outside,
        count(*) FILTER (yield_value < y0 OR yield_value > y1) AS yield_value_outside,
        count(*) FILTER (c_acctbal < c0 OR c_acctbal > c1) AS c_acctbal_outside
      FROM obs, b WHERE yr > 1995 GROUP BY region""",
    "override_else_lookup": f"""WITH {OBS}, m AS (SELECT yr, avg(o_totalprice) AS macro FROM obs GROUP BY yr)
      SELECT yr, lot, round(avg(CASE WHEN lot = 'S' THEN o_totalprice ELSE macro END), 4) AS total
      FROM obs JOIN m USING (yr) GROUP BY ALL""",
    "dataset_overview": f"""WITH {OBS} SELECT count(*) AS records, 20 AS attributes, min(yr) AS period_min, max(yr) AS period_max,
      count(DISTINCT region) AS num_region, count(DISTINCT item) AS num_item, count(DISTINCT segment) AS num_segment,
      count(DISTINCT season) AS num_season FROM obs""",
    "period_counts": f"WITH {OBS} SELECT yr, count(*) AS count FROM obs GROUP BY yr ORDER BY yr",
    "numeric_profile": f"WITH {OBS} " + " UNION ALL ".join(_profile_row(c) for c in MEASURES),
    "category_distribution": f"WITH {OBS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS label, count(*) AS count, "
        f"round(count(*) / (SELECT count(*) FROM obs)::DOUBLE, 8) AS share FROM obs GROUP BY {c}"
        for c in [*MINED, "segment"]
    ),
    "top_categories": """WITH d AS (SELECT 'lang' AS "column", lang AS label, count(*) AS count FROM documents GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source),
      k AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, label) AS INTEGER) AS rank FROM d)
      SELECT * FROM k WHERE rank <= 3""",
    "category_cardinality": """SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS distinct_values FROM orders
      UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""",
    "missing_counts": """SELECT 'l_tax' AS "column", count(*) FILTER (l_tax = 0) AS missing FROM lineitem
      UNION ALL SELECT 'l_discount', count(*) FILTER (l_discount = 0) FROM lineitem
      UNION ALL SELECT 'l_returnflag', count(*) FILTER (l_returnflag IS NULL) FROM lineitem""",
    "duplicate_rows": """SELECT 'lineitem' AS "table", (SELECT count(*) FROM lineitem)
        - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows
      UNION ALL SELECT 'documents', (SELECT count(*) FROM documents)
        - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (doc_id) FROM documents))""",
    "correlation_matrix": f"{CORRELATION} SELECT feature, other, round(r, 6) AS r FROM r",
    "correlation_bands": f"""{CORRELATION} SELECT feature, other,
      CASE WHEN abs(r) > 0.85 THEN 'very strong' WHEN abs(r) > 0.6 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate'
        ELSE 'weak' END AS band,
      CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign, abs(r) >= 0.3 AS shown FROM r""",
    "mean_by": f"""WITH {OBS} SELECT region, item, yr, round(avg(yield_value), 4) AS yield_value FROM obs GROUP BY ALL""",
    "group_share": f"""WITH {OBS} SELECT segment, count(*) AS count,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM obs), 6) AS percent FROM obs GROUP BY segment""",
    "level_vs_global": f"WITH {OBS} SELECT item, "
    + ", ".join(
        f"CASE WHEN avg({c}) >= (SELECT avg({c}) FROM obs) THEN 'HIGH' ELSE 'LOW' END AS {c}"
        for c in ("area", "production", "yield_value")
    )
    + " FROM obs GROUP BY item",
    "dominant_value": f"""WITH {OBS}, {_modes("obs", "region", ["item", "season", "segment"])}
      SELECT * FROM mode_item JOIN mode_season USING (region) JOIN mode_segment USING (region)""",
    "match_on_keys": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
      FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))
      SELECT o_custkey, o_orderkey, o_totalprice FROM k WHERE rn = 1""",
    "top_k_per_group": f"""WITH {OBS}, v AS (SELECT region, round(yield_value, 8) AS yield_value, {KEY} FROM obs),
      k AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY yield_value DESC, {ORDER}) AS INTEGER) AS rank FROM v)
      SELECT * FROM k WHERE rank <= 5""",
    "exact_median": """WITH m AS (SELECT median(o_totalprice) AS m FROM orders)
      SELECT round(any_value(m), 4) AS median, count(*) FILTER (o_totalprice > m) AS above FROM orders, m""",
    "history_means": f"""WITH {OBS} SELECT region, item, yr, round(avg(yield_value), 4) AS yields, round(avg(area), 6) AS areas,
      round(avg(o_totalprice), 7) AS totals FROM obs GROUP BY ALL""",
    "history_overview": f"""WITH {OBS}, s AS (SELECT region, min(yr) AS period_min, max(yr) AS period_max FROM obs GROUP BY region)
      SELECT region, item, yr, round(avg(yield_value), 4) AS value, any_value(period_min) AS period_min,
        any_value(period_max) AS period_max FROM obs JOIN s USING (region) GROUP BY region, item, yr""",
    "nested_series": f"""WITH {OBS}, c AS (SELECT DISTINCT region, item, yr FROM obs)
      SELECT region, item, string_agg(CAST(yr AS VARCHAR), '|' ORDER BY yr) AS years, CAST(count(*) AS INTEGER) AS points
      FROM c GROUP BY region, item""",
    "macro_by_period": f"""WITH {OBS} SELECT yr, round(avg(o_totalprice), 4) AS o_totalprice,
      round(avg(c_acctbal), 4) AS c_acctbal FROM obs GROUP BY yr""",
    "period_macro_join": f"""WITH {OBS}, m AS (SELECT yr, avg(o_totalprice) AS macro FROM obs GROUP BY yr)
      SELECT region, yr, count(*) FILTER (o_totalprice > macro) AS above, round(max(macro), 4) AS macro
      FROM obs JOIN m USING (yr) GROUP BY ALL""",
    "trend_summary": f"""WITH {OBS}, s AS (SELECT region, item, yr, round(avg(yield_value), 6) AS v FROM obs
        WHERE yr BETWEEN 1995 AND 2001 GROUP BY ALL),
      k AS (SELECT *, row_number() OVER (PARTITION BY region, item ORDER BY yr DESC) AS back,
        row_number() OVER (PARTITION BY region, item ORDER BY yr) AS fwd,
        row_number() OVER (PARTITION BY region, item ORDER BY v DESC, yr) AS hi,
        row_number() OVER (PARTITION BY region, item ORDER BY v, yr) AS lo FROM s),
      w AS (SELECT region, item, count(*) AS points, max(v) FILTER (back = 1) AS latest,
        max(yr) FILTER (back = 1) AS latest_period, max(v) FILTER (back = 2) AS previous,
        max(yr) FILTER (back = 2) AS previous_period, max(v) FILTER (hi = 1) AS highest,
        max(yr) FILTER (hi = 1) AS highest_period, max(v) FILTER (lo = 1) AS lowest,
        max(yr) FILTER (lo = 1) AS lowest_period, max(v) FILTER (fwd = 1) AS first FROM k GROUP BY region, item)
      SELECT region, item, points, latest, latest_period, previous, previous_period,
        round((latest - previous) / abs(previous) * 100, 4) AS change_percent, highest, highest_period, lowest, lowest_period,
        CASE WHEN points < 2 THEN 'stable' WHEN (latest - first) / abs(first) * 100 > 3 THEN 'increasing'
          WHEN (latest - first) / abs(first) * 100 < -3 THEN 'decreasing' ELSE 'stable' END AS trend FROM w""",
    "lag_levels": f"""WITH {EVENTS} SELECT event_id, lag(level, 1) OVER w AS lag1, lag(level, 2) OVER w AS lag2,
      lag(level, 3) OVER w AS lag3 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY day, event_id)""",
    "persistence_features": f"""WITH {LABELLED}, g AS (SELECT *, lag(level, 1) OVER w AS l1, lag(level, 2) OVER w AS l2,
        lag(level, 3) OVER w AS l3 FROM lab WINDOW w AS (PARTITION BY region, item ORDER BY yr, {ORDER}))
      SELECT {KEY}, {LOW_HIGH_FLAGS.format("l1", "l2", "l3")} FROM g""",
    "asof_previous": f"""WITH {EVENTS}, {_asof("daily")}
      SELECT event_id, asof1, asof2, asof3 FROM ev LEFT JOIN prev USING (user_id, day)""",
    "persistence_asof": f"""WITH {EVENTS},
      lv AS (SELECT user_id, day, arg_max(level, event_id) AS level FROM ev GROUP BY user_id, day), {_asof("lv")}
      SELECT event_id, {LOW_HIGH_FLAGS.format("asof1", "asof2", "asof3")} FROM ev LEFT JOIN prev USING (user_id, day)""",
    "sequence_patterns_2": _patterns(2),
    "sequence_patterns_3": _patterns(3),
    "sequence_patterns_cells": f"""WITH {OBS}, c AS (SELECT region, item, yr, avg(yield_value) AS v FROM obs GROUP BY ALL),
      l AS (SELECT *, CASE WHEN v > (SELECT median(v) FROM c) THEN 'High' ELSE 'Low' END AS level FROM c),
      g AS (SELECT level AS step1, lead(level) OVER (PARTITION BY region, item ORDER BY yr) AS step2 FROM l),
      f AS (SELECT * FROM g WHERE step2 IS NOT NULL)
      SELECT step1, step2, count(*) AS count, (SELECT count(*) FROM f) AS total,
        round(count(*) / (SELECT count(*) FROM f)::DOUBLE, 8) AS support FROM f GROUP BY step1, step2
      HAVING count(*) / (SELECT count(*) FROM f)::DOUBLE >= 0.1""",
    "sequence_count": "SELECT count(DISTINCT user_id) AS sequences FROM events",
    "transactions": f"""WITH {OBS} SELECT array_to_string(list_sort({ROW_ITEMS}), '|') AS items, count(*) AS rows
      FROM obs GROUP BY 1""",
    "frequent_itemsets": f"WITH {MINING} SELECT items, size, count, round(support, 8) AS support FROM sets",
    "candidate_counts": f"""WITH {MINING}, singles AS (SELECT * FROM sets WHERE size = 1), pairs AS (SELECT * FROM sets WHERE size = 2),
      c AS (SELECT 1 AS size, (SELECT count(DISTINCT item) FROM it) AS candidates
        UNION ALL SELECT 2, count(*) * (count(*) - 1) // 2 FROM singles
        UNION ALL SELECT 3, count(DISTINCT list_sort(list_distinct(a.list || b.list))::VARCHAR) FROM pairs a JOIN pairs b
          ON a.items < b.items AND len(list_distinct(a.list || b.list)) = 3),
      f AS (SELECT size, count(*) AS frequent FROM sets GROUP BY size)
      SELECT size, CAST(candidates AS BIGINT) AS candidates, coalesce(frequent, 0) AS frequent FROM c LEFT JOIN f USING (size)""",
    "itemset_report": f"""WITH {LOT_MINING}
      SELECT array_to_string(list_sort(list_transform(list, lambda x: replace(x, '=', ': '))), '|') AS itemset, size, count,
        round(support, 8) AS support FROM sets""",
    "association_rules": f"WITH {MINING}, {_rules(0.6)} {FLAT_RULES}",
    "target_rules": f"""WITH {MINING}, {_rules(0.6)} {FLAT_RULES}
      WHERE lift > 1 AND (list_contains(c, 'level=High') OR list_contains(c, 'level=Low'))""",
    "target_rules_lot": f"""WITH {LOT_MINING}, {_rules(0.5)} {FLAT_RULES}
      WHERE array_to_string(c, '|') LIKE '%lot=%'""",
    "train_only_rules": f"""WITH {TRAIN_MINING} {FLAT_RULES}
      WHERE lift > 1 AND (list_contains(c, 'level=High') OR list_contains(c, 'level=Low'))""",
    "match_rules": f"""WITH {TRAIN_MINING}, t AS (SELECT * FROM rules WHERE lift > 1
        AND (list_contains(c, 'level=High') OR list_contains(c, 'level=Low'))),
      combos AS (SELECT DISTINCT {ROW_ITEMS} AS items FROM lab)
      SELECT array_to_string(list_sort(items), '|') AS items, count(*) AS rules, round(max(lift), 8) AS lift
      FROM combos JOIN t ON list_has_all(items, a) GROUP BY 1""",
    "rule_features": f"""WITH {TRAIN_MINING}, t AS (SELECT *, list_contains(c, 'level=High') AS high FROM rules WHERE lift > 1
        AND (list_contains(c, 'level=High') OR list_contains(c, 'level=Low'))),
      combos AS (SELECT DISTINCT {ROW_ITEMS} AS items FROM lab),
      k AS (SELECT items, high, confidence, lift, row_number() OVER (PARTITION BY items, high
        ORDER BY lift DESC, confidence DESC) AS rn FROM combos JOIN t ON list_has_all(items, a)),
      best AS (SELECT items, max(confidence) FILTER (high AND rn = 1) AS hc, max(lift) FILTER (high AND rn = 1) AS hl,
        max(confidence) FILTER (NOT high AND rn = 1) AS lc, max(lift) FILTER (NOT high AND rn = 1) AS ll, count(*) AS n
        FROM k GROUP BY items)
      SELECT {KEY}, round(coalesce(hc, 0), 8) AS assoc_high_confidence, round(coalesce(hl, 0), 8) AS assoc_high_lift,
        round(coalesce(lc, 0), 8) AS assoc_low_confidence, round(coalesce(ll, 0), 8) AS assoc_low_lift,
        coalesce(n, 0) AS assoc_rule_count FROM lab LEFT JOIN best ON best.items = {ROW_ITEMS}""",
    "basket_itemsets": f"""WITH it AS (SELECT DISTINCT l_orderkey AS rid, p_type AS item FROM lineitem
        JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT rid) AS n FROM it), {_sets(0.02)}
      SELECT items, size, count, round(support, 8) AS support FROM sets""",
    "confusion_matrix": f"""WITH {OBS}, g AS (SELECT season, CASE lot WHEN 'S' THEN 'A' WHEN 'M' THEN 'N' ELSE 'R' END AS guess FROM obs),
      names AS (SELECT season AS name FROM g UNION SELECT guess FROM g)
      SELECT a.name AS label, b.name AS prediction, (SELECT count(*) FROM g WHERE season = a.name AND guess = b.name) AS count
      FROM names a, names b""",
    "classification_metrics": f"""WITH {OBS}, g AS (SELECT season, CASE lot WHEN 'S' THEN 'A' WHEN 'M' THEN 'N' ELSE 'R' END AS guess FROM obs),
      names AS (SELECT season AS name FROM g UNION SELECT guess FROM g),
      k AS (SELECT name, (SELECT count(*) FROM g WHERE season = name) AS sup, (SELECT count(*) FROM g WHERE guess = name) AS pred,
        (SELECT count(*) FROM g WHERE season = name AND guess = name) AS tp FROM names),
      p AS (SELECT *, tp / nullif(pred, 0)::DOUBLE AS pr, tp / nullif(sup, 0)::DOUBLE AS re FROM k),
      f AS (SELECT sup, tp, coalesce(pr, 0) AS pr, coalesce(re, 0) AS re, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM p)
      SELECT round(sum(tp) / sum(sup)::DOUBLE, 8) AS accuracy, round(sum(pr * sup) / sum(sup), 8) AS precision,
        round(sum(re * sup) / sum(sup), 8) AS recall, round(sum(f1 * sup) / sum(sup), 8) AS f1, CAST(sum(sup) AS BIGINT) AS n FROM f""",
    "binary_metrics": f"""WITH {LABELLED}, g AS (SELECT yr, level, CASE WHEN area < 22 THEN 'High' ELSE 'Low' END AS guess FROM lab),
      k AS (SELECT yr, count(*) AS n, count(*) FILTER (level = guess) AS ok, count(*) FILTER (level = 'High' AND guess = 'High') AS tp,
        count(*) FILTER (level = 'High') AS act, count(*) FILTER (guess = 'High') AS pred FROM g GROUP BY yr)
      SELECT yr, round(ok / n::DOUBLE, 8) AS accuracy, round(tp / pred::DOUBLE, 8) AS precision, round(tp / act::DOUBLE, 8) AS recall,
        round(2 * tp / (pred + act)::DOUBLE, 8) AS f1, n FROM k""",
    "regression_metrics": f"WITH {GUESSES} SELECT variant, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n FROM wide",
    "metric_diff": f"""WITH {OBS}, e AS (SELECT item AS metric, avg(yield_value) AS expected FROM obs WHERE yr <= 2000 GROUP BY item),
      a AS (SELECT item AS metric, avg(yield_value) AS actual FROM obs WHERE yr > 2000 GROUP BY item)
      SELECT metric, round(expected, 5) AS expected, round(actual, 5) AS actual, round(actual - expected, 5) AS diff,
        abs(actual - expected) <= 5 AS within FROM e LEFT JOIN a USING (metric)""",
    "metrics_pass": f"""WITH {GUESSES} SELECT tolerance, coalesce(bool_and(abs(a.value - e.value) <= tolerance), false) AS pass
      FROM (SELECT * FROM long WHERE variant = 'by_region') e JOIN (SELECT * FROM long WHERE variant = 'by_lot') a USING (metric),
        (SELECT unnest({catalog.TOLERANCES})::DOUBLE AS tolerance) GROUP BY tolerance""",
    "compare_variants": f"""WITH {GUESSES} SELECT metric, round(max(value) FILTER (variant = 'by_region'), 5) AS by_region,
      round(max(value) FILTER (variant = 'by_item'), 5) AS by_item, round(max(value) FILTER (variant = 'by_lot'), 5) AS by_lot
      FROM long GROUP BY metric""",
    "best_variant": f"WITH {GUESSES} SELECT arg_max(variant, value) AS best_variant FROM long WHERE metric = 'r2'",
    "best_per_metric": f"""WITH {GUESSES} SELECT metric, round(CASE WHEN metric IN ('rmse', 'mae') THEN min(value) ELSE max(value) END, 5)
      AS best FROM long GROUP BY metric""",
    "actual_vs_predicted": f"""WITH {GUESSES} SELECT round(yield_value, 8) AS actual, round(guess, 4) AS predicted, yr, item, {KEY}
      FROM g WHERE variant = 'by_lot'""",
    "roc_curve": f"WITH {DOCS}, {_curve('docs', 'quality', '')} SELECT threshold, fpr, tpr FROM pts",
    "roc_curve_corners": f"WITH {DOCS}, {_curve('docs', 'quality', '')} SELECT threshold, fpr, tpr FROM pts WHERE corner",
    "roc_curve_by_lang": f"WITH {DOCS}, {_curve('docs', 'toxic', 'lang')} SELECT lang, threshold, fpr, tpr FROM pts",
    "auc": f"""WITH {DOCS} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)
      / count(*)::DOUBLE, 8) AS auc, CAST((SELECT sum(quality) FROM docs) AS BIGINT) AS support
      FROM docs a, docs b WHERE a.quality = 1 AND b.quality = 0""",
    "curve_downsample": f"""WITH {DOCS}, {_curve('docs', 'quality', '')}
      SELECT CAST(idx AS BIGINT) AS point, threshold, fpr, tpr FROM pts WHERE points < 25
        OR idx IN (SELECT k * points // 24 FROM range(25) t(k), (SELECT max(points) AS points FROM pts))""",
    "ovr_auc": f"WITH {_class_scores()}, {_areas()} SELECT class, round(auc, 8) AS auc, support FROM areas",
    "ovr_roc": f"WITH {_class_scores()}, {_curve('s', 'is_class', 'class')} SELECT class, threshold, fpr, tpr FROM pts",
    "macro_weighted_auc": f"""WITH {_class_scores()}, {_areas()} SELECT round(avg(auc), 8) AS macro_auc,
      round(sum(auc * support) / sum(support), 8) AS weighted_auc FROM areas""",
    "roc_summary": f"""WITH {BOTH_AREAS}
      SELECT 'distance' AS variant, round(avg(auc), 8) AS macro_auc, round(sum(auc * support) / sum(support), 8) AS weighted_auc FROM fa
      UNION ALL SELECT 'angle', round(avg(auc), 8), round(sum(auc * support) / sum(support), 8) FROM la""",
    "compare_class_auc": f"""WITH {BOTH_AREAS}
      SELECT class, round(fa.auc, 8) AS distance_auc, fa.support, round(la.auc, 8) AS angle_auc,
        CASE WHEN round(fa.auc, 8) > round(la.auc, 8) THEN 'distance' WHEN round(fa.auc, 8) < round(la.auc, 8) THEN 'angle' END AS better
      FROM fa JOIN la USING (class)""",
    "auc_comparison_file": f"""WITH {BOTH_AREAS}
      SELECT class, round(fa.auc, 6) AS distance_auc, round(la.auc, 6) AS angle_auc FROM fa JOIN la USING (class)""",
    "verify_auc": f"""WITH {BOTH_AREAS},
      j AS (SELECT la.auc AS old, fa.auc AS new, la.support FROM la JOIN fa USING (class))
      SELECT round(max(abs(new - old)), 8) AS max_abs_diff, round(avg(abs(new - old)), 8) AS mean_abs_diff,
        round(avg(old), 8) AS stored_macro, round(avg(new), 8) AS recomputed_macro,
        round((SELECT sum(auc * support) / sum(support) FROM la), 8) AS stored_weighted,
        round(sum(new * support) / sum(support), 8) AS recomputed_weighted FROM j""",
    "curve_downsample_by_class": f"""WITH {_class_scores()}, {_curve('s', 'is_class', 'class')},
      m AS (SELECT class, max(points) AS points FROM pts GROUP BY class)
      SELECT pts.class, CAST(idx AS BIGINT) AS point, threshold, fpr, tpr FROM pts JOIN m USING (class) WHERE m.points < 25
        OR idx IN (SELECT k * m.points // 24 FROM range(25) t(k))""",
    "cluster_features": f"WITH {_space()} SELECT {KEY}, " + ", ".join(f"round(s_{c}, 8) AS {c}" for c in MEASURES) + " FROM sp",
    "assign_nearest": f"WITH {_clustered()} SELECT {KEY}, cluster FROM cl",
    "silhouette_sq": f"""WITH {_clustered()}, {_silhouette("cl", SPACED)}
      SELECT {KEY}, cluster, round(silhouette, 6) AS silhouette_sq FROM sil""",
    "cluster_distribution": f"""WITH {_clustered()} SELECT cluster, count(*) AS count,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM cl), 6) AS percent FROM cl GROUP BY cluster""",
    "cluster_profile": f"WITH {PROFILE} SELECT * REPLACE (CAST(percent AS DOUBLE) AS percent) FROM full_profile",
    "cluster_rules": f"""WITH {PROFILE} SELECT cluster, {_RULE_WORDS} AS conditions, dominant_item AS kind,
      dominant_region AS place, dominant_segment AS market, dominant_source AS origin FROM full_profile""",
    "silhouette": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
      m AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.x, b.x)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
      ab AS (SELECT vec_id, label, max(CASE WHEN label = other THEN n END) AS n, max(CASE WHEN label = other THEN s / greatest(n - 1, 1) END) AS a,
        min(CASE WHEN label <> other THEN s / n END) AS b FROM m GROUP BY vec_id, label)
      SELECT vec_id, label, CASE WHEN b IS NULL THEN NULL WHEN n = 1 THEN 0 ELSE round((b - a) / greatest(a, b), 6) END AS silhouette, true AS exact FROM ab""",
    "cluster_quality": f"""WITH {_clustered()}, {_silhouette("cl", SPACED)},
      q AS (SELECT cluster, count(*) AS count, avg(silhouette) AS m FROM sil GROUP BY cluster)
      SELECT cluster, count, round(m, 6) AS mean_silhouette, {_quality("m")} AS quality, m < 0.35 AS weak, m < 0 AS poor,
        cluster = (SELECT cluster FROM q ORDER BY m DESC, cluster LIMIT 1) AS strongest FROM q""",
    "evaluate_in_space": f"WITH {_clustered()}, z AS (SELECT {KEY}, cluster, "
    + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in SPACE)
    + f""" FROM cl), {_silhouette("z", [f"z_{c}" for c in SPACE])}, o AS (SELECT avg(silhouette) AS m FROM sil)
      SELECT round(m, 6) AS overall_silhouette, {_quality("m")} AS quality FROM o""",
    "hopkins": f"""WITH {_space()}, size AS (SELECT least(500, greatest(1, count(*) // 10)) AS m FROM sp),
      uni AS (SELECT i, {_UNIFORM} FROM (SELECT unnest(range((SELECT m FROM size))) AS i)),
      real AS (SELECT {ROW_TEXT} AS rid, {", ".join(f"s_{c} AS q_{c}" for c in MEASURES)} FROM sp
        ORDER BY {SAMPLED} LIMIT (SELECT m FROM size)),
      u AS (SELECT sqrt(min({_PROBE_GAP})) AS d FROM uni, sp GROUP BY i),
      w AS (SELECT rid, sqrt(min({_PROBE_GAP})) AS d FROM real, sp WHERE {ROW_TEXT} <> rid GROUP BY rid)
      SELECT round((SELECT sum(d) FROM u) / ((SELECT sum(d) FROM u) + (SELECT sum(d) FROM w)), 6) AS hopkins,
        (SELECT count(*) FROM u) AS probes""",
    "min_max_scale": f"""WITH {OBS}, b AS (SELECT min(area) AS a0, max(area) AS a1, min(production) AS p0, max(production) AS p1
        FROM obs WHERE yr <= 2000)
      SELECT {KEY}, round((area - a0) / (a1 - a0), 8) AS area, round((production - p0) / (p1 - p0), 8) AS production
      FROM obs, b WHERE yr > 2000""",
    "standard_scale": f"""WITH {OBS}, b AS (SELECT avg(area) AS a, stddev_pop(area) AS sa, avg(c_acctbal) AS c,
        stddev_pop(c_acctbal) AS sc FROM obs)
      SELECT {KEY}, round((area - a) / sa, 6) AS area, round((c_acctbal - c) / sc, 6) AS c_acctbal FROM obs, b""",
    "imputed": f"""WITH {OBS}, g AS (SELECT lot, CASE WHEN lot <> 'S' THEN area END AS area,
        CASE WHEN source = 'O' THEN season END AS season FROM obs),
      f AS (SELECT (SELECT median(area) FROM g) AS m, (SELECT season FROM g WHERE season IS NOT NULL GROUP BY season
        ORDER BY count(*) DESC, season LIMIT 1) AS s)
      SELECT coalesce(season, s) AS season, lot, count(*) AS rows, round(avg(coalesce(area, m)), 6) AS area
      FROM g, f GROUP BY 1, 2""",
    "stratified_folds": f"""WITH {LABELLED} SELECT {KEY}, level, CAST((row_number() OVER (PARTITION BY level ORDER BY {SAMPLED}) - 1) % 5
      AS INTEGER) AS fold FROM lab""",
    "build_features": f"""WITH {TRAIN_MINING}, t AS (SELECT *, list_contains(c, 'level=High') AS high FROM rules WHERE lift > 1
        AND (list_contains(c, 'level=High') OR list_contains(c, 'level=Low'))),
      combos AS (SELECT DISTINCT {ROW_ITEMS} AS items FROM lab),
      k AS (SELECT items, high, confidence, lift, row_number() OVER (PARTITION BY items, high
        ORDER BY lift DESC, confidence DESC) AS rn FROM combos JOIN t ON list_has_all(items, a)),
      best AS (SELECT items, max(confidence) FILTER (high AND rn = 1) AS hc, max(lift) FILTER (high AND rn = 1) AS hl,
        max(confidence) FILTER (NOT high AND rn = 1) AS lc, max(lift) FILTER (NOT high AND rn = 1) AS ll, count(*) AS n
        FROM k GROUP BY items),
      lv AS (SELECT region, item, yr, level, row_number() OVER (PARTITION BY region, item ORDER BY yr DESC) AS rn FROM
        (SELECT region, item, yr, arg_max(level, (l_orderkey, l_linenumber, l_partkey, l_suppkey, cents)) AS level FROM tr
         GROUP BY region, item, yr)),
      prev AS (SELECT region, item, max(level) FILTER (rn = 1) AS p1, max(level) FILTER (rn = 2) AS p2,
        max(level) FILTER (rn = 3) AS p3 FROM lv GROUP BY region, item)
      SELECT {KEY}, level, yr, lab.item, season, source, lab.item || ' | ' || season AS item_x_season,
        lab.item || ' | ' || source AS item_x_source, round(o_totalprice, 8) AS o_totalprice,
        round(p_retailprice, 8) AS p_retailprice, round(ln(1 + area), 8) AS log_area,
        round(coalesce(hc, 0), 8) AS assoc_high_confidence, round(coalesce(hl, 0), 8) AS assoc_high_lift,
        round(coalesce(lc, 0), 8) AS assoc_low_confidence, round(coalesce(ll, 0), 8) AS assoc_low_lift,
        CAST(coalesce(n, 0) AS DOUBLE) AS assoc_rule_count, {LOW_HIGH_FLAGS.format("p1", "p2", "p3")}
      FROM lab LEFT JOIN best ON best.items = {ROW_ITEMS} LEFT JOIN prev ON prev.region = lab.region AND prev.item = lab.item
      WHERE yr > 2000""",
    "kmeans_fit": f"""WITH {OBS} SELECT CAST(8 AS BIGINT) AS k, count(*) AS rows, true AS nearest FROM obs""",
    "kmeans_sweep": f"""WITH {OBS}, n AS (SELECT count(*) AS n FROM obs)
      SELECT CAST(k AS INTEGER) AS k, k = 8 AS selected, n > 0 AS falls, n > 0 AS in_range FROM range(2, 11) t(k), n""",
    "forest_classifier": f"WITH {LABELLED} SELECT level, count(*) AS rows, true AS likeliest, true AS useful FROM lab WHERE yr > 2000 GROUP BY level",
    "network_classifier": f"WITH {LABELLED} SELECT level, count(*) AS rows, true AS likeliest, true AS useful FROM lab WHERE yr > 2000 GROUP BY level",
    "forest_regressor": f"""WITH {OBS} SELECT variant, count(*) AS n, true AS plausible, true AS compared, true AS useful
      FROM obs, (SELECT unnest(['baseline', 'engineered', 'advanced']) AS variant) WHERE yr > 2000 GROUP BY variant""",
    "score_top_k": f"""WITH {OBS}, s AS (SELECT count(DISTINCT segment) AS classes FROM obs WHERE yr <= 2000)
      SELECT count(*) AS rows, CAST(count(*) * least(5, any_value(classes)) AS BIGINT) AS ranks, true AS falls, true AS within
      FROM obs, s WHERE yr > 2000""",
    "model_roc": f"WITH {OBS} SELECT lot AS class, count(*) AS support, true AS told_apart FROM obs WHERE yr > 2000 GROUP BY lot",
    "feature_importance": f"""WITH {OBS}, n AS (SELECT count(*) > 0 AS ok FROM obs WHERE yr <= 2000)
      SELECT feature, ok AS is_share, ok AS whole, feature = 'log_area' AS leads FROM n, (SELECT unnest({FEATURES}) AS feature)""",
    "cross_validate": f"""WITH {LABELLED}, f AS (SELECT CAST((row_number() OVER (PARTITION BY level ORDER BY {SAMPLED}) - 1) % 5
        AS INTEGER) AS fold FROM lab)
      SELECT fold, count(*) AS held_out, CAST(5 AS BIGINT) AS metrics, true AS in_range, true AS better_than_chance, variant
      FROM f, (SELECT unnest(['engineered', 'advanced']) AS variant) GROUP BY fold, variant""",
    "encode_label": f"""WITH {LABELLED} SELECT region, CAST(level = 'High' AS INTEGER) AS code, count(*) AS rows
      FROM lab GROUP BY ALL""",
    "one_hot": f"""WITH {OBS} SELECT 'segment' AS "column", v.segment AS value, count(*) FILTER (obs.segment = v.segment) AS rows
      FROM obs, (SELECT DISTINCT segment FROM obs WHERE yr <= 2000) v WHERE yr > 2000 GROUP BY v.segment
      UNION ALL SELECT 'season', v.season, count(*) FILTER (obs.season = v.season)
      FROM obs, (SELECT DISTINCT season FROM obs WHERE yr <= 2000) v WHERE yr > 2000 GROUP BY v.season""",
    "finite_report": """WITH k AS (SELECT l_returnflag, CASE WHEN l_discount <> 0 THEN round_even(l_extendedprice / l_discount, 3) END AS ratio
        FROM lineitem)
      SELECT l_returnflag, count(ratio) AS known, count(*) AS rows, round(max(ratio), 3) AS largest FROM k GROUP BY l_returnflag""",
    "read_observations": f"""WITH {OBS} SELECT region, yr, count(*) AS rows, round(sum(area), 4) AS area,
      round(avg(production), 4) AS production FROM obs GROUP BY ALL""",
    "rules_round_trip": f"WITH {MINING}, {_rules(0.6)} {FLAT_RULES}",
    "metric_table": f"WITH {GUESSES} SELECT variant, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM wide",
    "report_sections": f"""WITH {OBS} SELECT 'periods' AS section, CAST(yr AS VARCHAR) AS name, count(*) AS count FROM obs GROUP BY yr
      UNION ALL SELECT 'shares', segment, count(*) FROM obs GROUP BY segment""",
    "ngrams": f"""WITH {EVENTS}, g AS (SELECT level AS step1, lead(level) OVER (PARTITION BY user_id ORDER BY day) AS step2 FROM daily)
      SELECT step1, step2, count(*) AS rows FROM g WHERE step2 IS NOT NULL GROUP BY ALL""",
}
