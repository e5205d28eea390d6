"""DuckDB SQL for the queries of this subpackage that SQL can express, written apart from the Spark code."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Full rescans of every codebook in every round."""
    out = [
        f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""part AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS u
          FROM kept, (SELECT unnest(range({parts})) AS p))""",
        f"""b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, u AS c FROM part
          WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))""",
    ]
    for i in range(rounds + 1):
        gap = "list_sum(list_transform(list_zip(u, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        out.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, label, p, u, n.d AS d, n.e AS e FROM (
              SELECT vec_id, any_value(label) AS label, part.p AS p, any_value(u) AS u, min({{'d': CAST({gap} AS BIGINT), 'e': e}}) AS n
              FROM part JOIN b{i} ON part.p = b{i}.p GROUP BY vec_id, part.p))"""
        )
        if i < rounds:
            out.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT b{i}.p AS p, b{i}.e AS e, coalesce(m.c, b{i}.c) AS c FROM b{i} LEFT JOIN (
                  SELECT p, e, list(q ORDER BY j) AS c FROM (SELECT p, e, j, CAST((s - ((s % n) + n) % n) / n AS BIGINT) AS q FROM (
                    SELECT p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
                    FROM (SELECT p, e, unnest(u) AS x, generate_subscripts(u, 1) AS j FROM a{i}) GROUP BY p, e, j)) GROUP BY p, e) m
                ON b{i}.p = m.p AND b{i}.e = m.e)"""
            )
    last = f"a{rounds}"
    return (
        ", ".join(out)
        + f""", sums AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM {last} GROUP BY vec_id)
          SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM sums"""
    )


def importance(buckets: int = 10_000, percent: int = 10, least: int = 20) -> str:
    """crc32 byte by byte over the distinct words; weights as plain sums."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    bits = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    return f"""WITH RECURSIVE step AS (SELECT i, i AS x, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, {bits}, k + 1 FROM step WHERE k < 8),
      crc AS (SELECT list(x ORDER BY i) AS t FROM step WHERE k = 8),
      own AS MATERIALIZED (SELECT doc_id, {words} AS ws FROM documents),
      aim AS MATERIALIZED (SELECT unnest({words}) AS w FROM benchmark),
      raw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w FROM own),
      bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM raw UNION SELECT w FROM aim)),
      hashed AS MATERIALIZED (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295,
          list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))),
          lambda c, b: xor(c >> 8, t[xor(c, b) & 255 + 1]))) % {buckets} AS bucket FROM bytes, crc),
      s AS (SELECT bucket, count(*) AS n FROM raw JOIN hashed USING (w) GROUP BY bucket),
      t AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (w) GROUP BY bucket),
      total AS (SELECT (SELECT count(*) FROM raw) + {buckets} AS s, (SELECT count(*) FROM aim) + {buckets} AS t),
      gain AS (SELECT s.bucket AS bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * total.s AS DOUBLE) / CAST((s.n + 1) * total.t AS DOUBLE))) AS BIGINT) AS g
        FROM s LEFT JOIN t ON s.bucket = t.bucket, total),
      summed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM raw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
      noise AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
          CAST('0x' || left(sha256('2024:' || CAST(doc_id AS VARCHAR)), 8) AS BIGINT) AS h FROM own LEFT JOIN summed USING (doc_id)),
      scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM noise),
      fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {least})
      SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank
      FROM scored LEFT JOIN fit USING (doc_id)""".replace("xor(c, b) & 255 + 1", "(xor(c, b) & 255) + 1")


def quality_rules() -> str:
    """Every rule on every text; windows of three words are unnested."""
    blank = r"[\x20\x09-\x0D]"
    share = "len(list_filter(ls, lambda x: regexp_matches(x, '{}')))"
    return rf"""WITH txt AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
      m AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws, string_split(text, chr(10)) AS ls FROM txt),
      win AS MATERIALIZED (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM m WHERE len(ws) > 3)),
      twice AS (SELECT r, x FROM win GROUP BY r, x HAVING count(*) > 1),
      rep AS (SELECT r, count(DISTINCT i + j) AS n FROM win JOIN twice USING (r, x), (SELECT unnest(range(3)) AS j) GROUP BY r),
      c AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '{blank}', '', 'g')) AS word_chars,
          length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
          len(list_filter(ls, lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
          coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS letters, len(ls) AS lines,
          {share.format(rf"(\.\.\.|…){blank}*\z")} AS ellipsis, {share.format(rf"\A{blank}*[-*•]")} AS bullets
        FROM m LEFT JOIN rep USING (r)),
      b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
      SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words OR 10 * letters < 8 * n_words
          OR 10 * n_dup_lines > 3 * lines OR 10 * ellipsis > 3 * lines OR 10 * bullets > 9 * lines) AS kept FROM b"""


def ngram_join(size: int = 5, percent: int = 75) -> str:
    """All pairs that share a shingle, then the smallest reachable id by a recursive walk."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
      sh AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) >= {size} THEN list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i : i + {size - 1}], ' '))
          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS x FROM w)),
      n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
      pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
      links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
      edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
      walk AS (SELECT DISTINCT a AS node, a AS seen FROM edges UNION SELECT walk.node, edges.b FROM walk JOIN edges ON walk.seen = edges.a),
      least AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
      SELECT w.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
      FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.node = w.doc_id"""


SQL = {
    "op4_ngram_join": ngram_join(),
    "op11_vector_codes": vector_codes(),
    "op12_importance": importance(),
    "op13_quality_rules": quality_rules(),
}
