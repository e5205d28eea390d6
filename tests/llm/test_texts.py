import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelmill.llm import decontaminate, kernels, order_minhash, packing, pii, queries


def test_packing_is_an_exact_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    tokenizer = Tokenizer.from_str(queries.vocabulary())
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = packing.packed(docs, queries.vocabulary()).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    covered, rows = {i: 0 for i in ids}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == covered[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == p.ids_crc32
        covered[p.doc_id] += p.length
        rows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all(covered[i] == len(x) for i, x in ids.items())
    for number, parts in rows.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 2048 or number == max(rows)
    assert set(rows) == set(range(len(rows)))


def test_words_are_coded_as_in_their_text():
    odd = ["It's a dog's *** 12ab x²y", "é́ Áb!! \x1c y\x1cz <|endoftext|> b", "", "\n\t ", "ﬁ ǅ İI ΑΣ! [x]{y} a_b DON'T"]
    coder = packing._WordIds(queries.vocabulary())
    found = [np.frombuffer(x, coder.kind).tolist() for x in coder.encode([t.encode() for t in odd])]
    assert found == [e.ids for e in Tokenizer.from_str(queries.vocabulary()).encode_batch(odd, add_special_tokens=False)]


def test_packing_takes_odd_rows(spark, rich):
    pieces = packing.packed(rich, queries.vocabulary()).collect()
    assert {p.doc_tokens for p in pieces if p.doc_id in (1, 2, 5)} == {1} and sum(p.doc_id is None for p in pieces) == 1
    assert packing.packed(rich.limit(0), queries.vocabulary()).count() == 0


def test_fingerprints_follow_the_edited_text(spark, sf):
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, [*order[1:], order[0]]):
        text, cut = texts[i], len(texts[i]) // 3
        changed = text[: len(text) - cut] + texts[following][:cut]
        r = found[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == order_minhash.signatures(text).astype(">u2").tobytes().hex()
        assert r.edited_fingerprint == order_minhash.signatures(changed).astype(">u2").tobytes().hex()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert np.mean([r.near_edited for r in found.values()]) > 0.4 > 0.2 > np.mean([r.near_next for r in found.values()])


WHOLE = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & WHOLE
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & WHOLE
    return x ^ x >> 31


def plain_seeds(n, stream):
    return [plain_mix(((stream << 32) + i * 0x9E3779B97F4A7C15) & WHOLE) | 1 for i in range(1, n + 1)]


def plain_signatures(text):
    """By loops over k-mers: number them by occurrence, deal them into bins, take the two smallest of each in text order."""
    if not text:
        return [0] * order_minhash.SIGNATURES
    k = min(order_minhash.KMER, len(text))
    factors, seen, numbered = plain_seeds(k, 5), collections.Counter(), []
    for place in range(len(text) - k + 1):
        gram = plain_mix(sum(ord(c) * f for c, f in zip(text[place : place + k], factors)) & WHOLE) >> 21
        numbered.append((plain_mix((gram + seen[gram] * 0xD6E8FEB86659FD93) & WHOLE) >> 21, place))
        seen[gram] += 1
    numbered.sort()
    out = []
    for s in range(order_minhash.SIGNATURES):
        first = sum(v < s << 37 for v, _ in numbered)
        picked = sorted((numbered[(first + i) % len(numbered)] for i in range(order_minhash.TUPLE)), key=lambda x: x[1])
        out.append(plain_mix(sum(v * f for (v, _), f in zip(picked, plain_seeds(order_minhash.TUPLE, 6))) & WHOLE) >> 48)
    return out


def test_signatures_equal_those_of_plain_loops():
    rng = random.Random(12)
    texts = ["", "a", "abcde", "abcdef", "aaaaaaaaaaaaaaaaaaaa", "é😀" * 9]
    texts += ["".join(rng.choice("abc d") for _ in range(rng.randrange(400))) for _ in range(60)]
    for text in texts:
        assert order_minhash.signatures(text).tolist() == plain_signatures(text), text


def test_order_counts_in_fingerprints():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    text, turned = " ".join(words), " ".join(words[150:] + words[:150])
    one_edit = " ".join([*words[:100], "other", *words[101:]])
    near = [order_minhash.likeness(order_minhash.signatures(text), order_minhash.signatures(t)) for t in (text, one_edit, turned)]
    assert near[0] == 1 and near[1] > 0.85 and near[2] < near[1]
    high = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    short = order_minhash._ordered(high, np.arange(5000, dtype=np.uint64))
    order_minhash_place, order_minhash._PLACE = order_minhash._PLACE, 12
    order_minhash._PLACE = order_minhash_place
    assert (np.diff(short[0].astype(np.int64)) >= 0).all()


def test_fingerprints_take_odd_rows(spark, rich):
    rows = order_minhash.fingerprints(rich).collect()
    assert len(rows) == 8 and {r.n_chars for r in rows if r.doc_id in (1, 2)} == {0}
    assert order_minhash.fingerprints(rich.limit(0)).count() == 0
    one = order_minhash.fingerprints(rich.where("doc_id = 7")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    unnamed = rich.where("doc_id is null").collect()
    assert len(order_minhash.fingerprints(rich.where("doc_id is null")).collect()) == len(unnamed)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 7, 20, 45, 80, 300])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, items[0][1])]
    rows = []
    for i in range(150):
        noise = [rng.choice(vocabulary) for _ in range(rng.choice([0, 30, 200]))]
        kind, item = i % 3, items[i % 60][1].split()
        if kind == 1:
            at = rng.randrange(len(noise) + 1)
            noise[at:at] = item
        elif kind == 2 and len(item) > 40:
            item[rng.randrange(len(item))] = "changed"
            noise += item
        rows.append((i, " ".join(noise).upper() if i % 7 == 0 else " ".join(noise)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(w):
        from collections import Counter

        return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))

    expected = set()
    for i, text in rows:
        w = words_of(text)
        for k, item in items:
            v = words_of(item or "")
            if not v:
                continue
            goal = shingles(v)
            for s in range(max(0, len(w) - len(v)) + 1):
                other = shingles(w[s : s + len(v)]) if w else None
                if other and sum((goal & other).values()) >= 0.75 * sum((goal | other).values()):
                    expected.add((i, k))
                    break
    assert expected <= set(found) and all(v >= 0.75 for v in found.values()) and len(set(found) - expected) <= 2


def best_of_all_passages(text, item):
    from collections import Counter

    w, v = words_of(text), words_of(item)
    goal, best = Counter(tuple(v[j : j + 5]) for j in range(max(1, len(v) - 4))), 0.0
    for low in range(len(w)):
        other = Counter()
        for high in range(low + 1, len(w) + 1):
            if high - low > 5:
                other[tuple(w[high - 5 : high])] += 1
            else:
                other = Counter([tuple(w[low:high])])
            both = sum(min(n, goal[k]) for k, n in other.items() if k in goal)
            best = max(best, both / (sum(goal.values()) + max(1, high - low - 4) - both))
    return best


def leak_of(text, item):
    import pyarrow as pa

    index = decontaminate.build([(0, item)])
    return [found[2] for found in decontaminate._leaks(index, pa.array([text], pa.large_string()), 0.75)]


def test_decontamination_finds_cut_and_resized_passages():
    rng = random.Random(4)

    def some(n):
        return [f"word{rng.randrange(5000)}" for _ in range(n)]

    for size, edit in (
        (100, lambda v: v[:80]),
        (100, lambda v: v[:50] + some(12) + v[50:]),
        (50, lambda v: v[:42]),
        (20, lambda v: v[:17]),
        (50, lambda v: v[:24] + some(4) + v[24:]),
        (60, lambda v: v[:30] + v[35:]),
        (3, lambda v: v),
    ):
        v = some(size)
        item, text = " ".join(v), " ".join([*some(15), *edit(v), *some(15)])
        best = best_of_all_passages(text, item)
        assert best >= 0.75 and leak_of(text, item) == [pytest.approx(best)], size
    again = "a b c d e f a b c d e f g h i a b c d e f"
    for text in (again, f"x y {again} z", "a b c d e f " * 6, f"{again[:30]} q {again[31:]}"):
        best = best_of_all_passages(text, again)
        assert leak_of(text, again) == ([pytest.approx(best)] if best >= 0.75 else [])


def test_decontamination_windows_fit_every_item_of_a_class():
    rng = random.Random(6)
    for size, edits in ((1, 0), (2, 0), (48, 1), (60, 2), (74, 2), (78, 2), (84, 2), (89, 2), (130, 3)):
        for _ in range(150 if edits else 3):
            v = [f"word{rng.randrange(5000)}" for _ in range(size)]
            item, w = " ".join(v), list(v)
            for _ in range(edits):
                at = rng.randrange(size)
                w[at : at + 2 if size == 48 else at + 1] = ["x"] * (2 if size == 48 else 1)
            noise = [f"word{rng.randrange(5000)}" for _ in range(rng.randrange(20, 40))]
            text = " ".join([*noise, *w, *noise])
            goal, other = (set(zip(*(u[j:] for j in range(min(5, size))))) for u in (v, w))
            if len(goal & other) >= 0.75 * len(goal | other):
                assert leak_of(text, item), (size, edits)
    for length in range(1, 400):
        shortest = 1
        while int(shortest * decontaminate._GROWTH["runs"]) + 1 <= length:
            shortest = int(shortest * decontaminate._GROWTH["runs"]) + 1
        window, step = decontaminate._window_of(shortest, "runs")
        assert window + step - 1 <= decontaminate._run_of(length)


def test_decontamination_takes_odd_rows(spark, rich):
    items = spark.createDataFrame([(0, "three four five six seven eight"), (1, None), (2, "one two three four five six")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(rich, items).collect()} == {(3, 2), (7, 2)}
    clean = decontaminate.without_leaks(rich, items)
    assert clean.columns == rich.columns and {r.doc_id for r in clean.collect()} == {1, None, 2, 5, -4}
    assert decontaminate.leaks(rich, items.limit(0)).count() == 0 and decontaminate.leaks(rich.limit(0), items).count() == 0


def base_spans(text):
    def luhn(digits):
        total = 0
        for i, c in enumerate(reversed(digits)):
            x = int(c) * (1 + i % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m)]


@pytest.fixture(scope="module")
def personal():
    rng = random.Random(2)
    pieces = ["a@b.cd", "x.y@z.com_q@w.org", "@", "a@b", "1.2.3.4.5", "256.1.1.1", "007.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "1  2", "12 34-56", "+1 (743) 555-3824", "+12", "+1-", "é😀", "4\u00011", "1 ", "-", ".", " ", "\n", "٤٥", "+44.20 7946 0958", "0000000000000000"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for i in range(400)]
    return [*rows, (900, "7 " * 3000 + "4111111111111111"), (901, "a" * 20000 + "@b.c"), (902, "9" * 20000)]


def test_base_spans_equal_those_of_the_plain_expressions(spark, personal):
    df = spark.createDataFrame(personal, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, text in personal:
        spans = base_spans(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, text[:200], spans, found[i].spans)
        assert found[i].n_card == sum(s.startswith("card") for s in spans)


def test_contexts_lead_to_unseen_identifiers(spark):
    seeds = [(i, f"please call me at +1 (743) 555-{3000 + i} before noon") for i in range(12)]
    hidden = [(100 + i, f"please call me at 743555{i:04d}x before noon") for i in range(2)]
    other = [(200 + i, f"model number abc{i:04d}z weighs little") for i in range(20)]
    df = spark.createDataFrame(seeds + hidden + other, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert found[100] == "phone:18:29" and found[101] == "phone:18:29"
    assert all(found[200 + i] == "" for i in range(20)) and found[0].startswith("phone:18:")


def test_personal_data_takes_odd_rows(spark, rich):
    rows = pii.personal_data(rich).collect()
    assert len(rows) == 8 and {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(rich.limit(0)).count() == 0
    plan = pii.personal_data(rich)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def edited(rng, words, vocabulary):
    """A passage at a similarity of 0.75 or a little more: words changed, cut off, added or moved until one more would be too many."""
    goal = collections.Counter(zip(*(words[i:] for i in range(5))))

    def near(passage):
        own = collections.Counter(zip(*(passage[i:] for i in range(5))))
        both = sum((goal & own).values())
        return both / (sum(goal.values()) + sum(own.values()) - both)

    now = list(words)
    for _ in range(40):
        new, place = list(now), rng.randrange(len(now))
        kind = rng.randrange(4)
        if kind == 0:
            new[place] = rng.choice(vocabulary)
        elif kind == 1:
            new.insert(place, rng.choice(vocabulary))
        elif kind == 2:
            del new[place]
        else:
            new = new[1:] if rng.random() < 0.5 else new[:-1]
        if near(new) < 0.75:
            break
        now = new
    return now


@pytest.mark.parametrize("size, kinds", [(24, 3000), (50, 3000), (110, 3000), (260, 3000), (60, 5)])
def test_recall_of_each_way_to_candidates(size, kinds):
    rng = random.Random(size + kinds)
    vocabulary = [f"w{i}" for i in range(kinds)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(size + rng.randrange(size // 5)))) for i in range(20)]
    texts = []
    for _, text in items * 4:
        passage = edited(rng, text.split(), vocabulary)
        head = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        texts.append(" ".join([*head, *passage, *(rng.choice(vocabulary) for _ in range(rng.randrange(60)))]))
    hashes, first = kernels.words(pa.array(texts, pa.large_string()))
    recall = {}
    for ways in (("runs",), ("whole",), ("runs", "whole")):
        found = {(r, i) for r, i, _ in decontaminate._candidates(decontaminate.build(items, ways), hashes, first).tolist()}
        recall[ways] = sum((r, r % 20) in found for r in range(len(texts))) / len(texts)
    assert recall["runs", "whole"] >= 0.98
    assert kinds < 100 or recall["runs",] >= 0.98 and recall["whole",] >= 0.9
