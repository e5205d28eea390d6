import collections
import random

import pytest
import xxhash

from panelmill.llm import line_dedup
from panelmill.llm.line_dedup import FEW, LONG_LINE, without_repeats


def brute(rows):
    """The same chunks and removals, line by line."""
    seen, out = set(), {}
    turn = lambda x, k: (x << k | x >> (64 - k)) & (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for key, text in sorted(rows):
        lines = text.split("\n")
        h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in lines]
        w = [len("".join(x.split())) for x in lines]
        r = [signed(x ^ (turn(h[i - 1], 21) if i else 0) ^ (turn(h[i - 2], 42) if i > 1 else 0)) for i, x in enumerate(h)]
        starts = [
            i
            for i in range(len(lines))
            if i == 0 or w[i] >= LONG_LINE or w[i - 1] >= LONG_LINE or i > 1 and r[i - 1] < r[i - 2] and r[i - 1] <= r[i]
        ]
        kept = []
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            body, size = "\n".join(lines[a:b]), sum(w[a:b])
            if size >= LONG_LINE or b - a > 1 and size >= FEW:
                if body in seen:
                    continue
                seen.add(body)
            kept += lines[a:b]
        out[key] = "\n".join(kept)
    return out


def passage(seed, n, blank):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    return [blank.join(word() for _ in range(5)) for _ in range(n)]


@pytest.mark.parametrize("blank", [" ", "\t", ""])
def test_of_a_repeated_passage_only_the_edges_stay(spark, blank):
    """Said of lines, not of the formula: 20 short lines in six texts, between heads and tails of their own."""
    left = []
    for seed in range(8):
        lines = passage(seed, 20, blank)
        texts = [(i, "\n".join([*passage(f"{seed} head {i}", i + 1, " "), *lines, *passage(f"{seed} tail {i}", 3, " ")])) for i in range(6)]
        found = {r.doc_id: r.text.split("\n") for r in without_repeats(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        assert found[0] == texts[0][1].split("\n")
        for i in range(1, 6):
            assert [x for x in found[i] if x not in lines] == [x for x in texts[i][1].split("\n") if x not in lines]
            stay = [x in found[i] for x in lines]
            inner = stay.index(False), 20 - stay[::-1].index(False)
            assert not any(stay[inner[0] : inner[1]])  # what stays is at the edges
            left.append(sum(stay))
    assert sum(left) / len(left) < 9


def test_borders_find_their_place_after_an_insertion(spark):
    lines = passage(1, 60, " ")
    texts = [(0, "\n".join(lines)), (1, "\n".join([*lines[:30], "a new line", *lines[30:]]))]
    found = {(r.key, r.body) for r in line_dedup.chunks(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect()}
    first, second = ({b for k, b in found if k == i} for i in (0, 1))
    assert len(first - second) <= 3 and min(b.count("\n") for b in first - {"\n".join(lines[-1:])}) >= 1


def test_every_line_of_the_window_decides(spark):
    row = spark.createDataFrame([([1, 2, 4, 8],)], "h array<long>").select(line_dedup.rolled("h").alias("r")).first().r
    assert row[3] == 8 ^ 4 << 21 ^ 2 << 42 and row[0] == 1


def test_removals_equal_those_of_a_loop(spark):
    passage = "\n".join(f"line {i} of a passage that stands in many documents and is long enough" for i in range(5))
    short = "a b\nc d e\nf g h i\nj k\nl m n\no p"
    rows = [(i, f"head {i}\n{passage if i % 2 else short}\ntail {i} of the text\n{short}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in without_repeats(df).collect()}
    expected = brute(rows)
    assert {i: r.text for i, r in found.items()} == expected
    assert sum(passage.split("\n")[2] in r.text for r in found.values()) == 1
    assert all(r.removed_lines == len(dict(rows)[i].split("\n")) - len(r.text.split("\n")) for i, r in found.items() if r.text)


def test_odd_rows(spark, rich):
    df = rich.withColumnRenamed("score", "lines")
    found = without_repeats(df).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.doc_id].append(r)
    assert len(found) == 8 and by[1][0].text is None and by[1][0].lines == 0
    assert [r.text for r in by[3]] == ["one two three four five six"] * 2
    assert by[2][0].text == "" and by[2][0].lines == 1 and by[-4][0].text.startswith("idiot")
    assert without_repeats(df.limit(0)).count() == 0


def test_main_path_has_no_python(spark, rich):
    plan = without_repeats(rich)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
