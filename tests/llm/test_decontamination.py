"""Spaced-seed overlaps against comparing every pair of windows."""

import random
from itertools import combinations

from textloom.llm import decontamination as D

DOCS = "doc_id long, text string, item_id long"
ITEMS = "item_id long, text string, extra string"


def test_masks_lose_nothing():
    for length in range(D.SHORTEST, D.WINDOW + 1):
        found = D.masks(length)
        for gone in combinations(range(length), D.allowed(length)):
            assert any(not set(gone) & set(m) for m in found)
        assert all(len(m) < length for m in found) and all(len(m) >= 2 for m in found)


def cases():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([5, 7, 9, 12, 13, 14, 20, 40, 40, 3])]
    items += [(20, items[6][1]), (21, ""), (22, None)]
    docs = [(0, None), (1, ""), (2, "w1 w2")]
    for i in range(3, 160):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))]
        if i % 2:
            passage = rnd.choice(items[:9])[1].upper().split()
            for _ in range(rnd.randrange(0, 5)):
                passage[rnd.randrange(len(passage))] = "zz"
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage[rnd.randrange(3) :]
        docs.append((i, "\n".join(words)))
    docs += [(5, docs[5][1]), (None, docs[5][1]), (999, "filler " * 30000 + items[7][1])]
    return items, docs


def brute(text, items):
    words, hits, covered, ids = (text or "").lower().split(), set(), set(), set()
    for item, t in items:
        own = (t or "").lower().split()
        n = min(D.WINDOW, len(own))
        if n < D.SHORTEST:
            continue
        for j in range(len(own) - n + 1):
            for i in range(len(words) - n + 1):
                if sum(a != b for a, b in zip(words[i : i + n], own[j : j + n], strict=True)) <= n // 5:
                    hits.add((i, tuple(own[j : j + n])))
                    covered.update(range(i, i + n))
                    ids.add(item)
    return len(hits), len(covered), sorted(ids)


def frames(spark):
    items, docs = cases()
    return items, docs, spark.createDataFrame([(i, t, 1) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)


def test_overlaps_equal_brute_force(spark):
    items, docs, left, right = frames(spark)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_hits, r.n_overlap_words, list(r.item_ids)) for r in D.overlaps(left, right).collect())
    want = sorted((-1 if i is None else i, *brute(t, items)) for i, t in docs[:-1])
    assert [g for g in got if g[0] != 999] == want
    assert [g for g in got if g[0] == 999][0][3] == [7] and sum(w[1] > 0 for w in want) > 30


def test_clean_and_slices(spark, monkeypatch):
    items, docs, left, right = frames(spark)
    want = sorted((-1 if i is None else i) for i, t in docs[:-1] if not brute(t, items)[0])
    for limit in (D.SLICE, 60):
        monkeypatch.setattr(D, "SLICE", limit)
        kept = D.clean(left, right)
        assert kept.columns == left.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == want
        flags = D.overlaps(left, right).collect()
        assert sorted(-1 if r.doc_id is None else r.doc_id for r in flags if r.kept) == want and len(flags) == len(docs)


def test_figures_do_not_depend_on_slices(spark, monkeypatch):
    items, docs, left, right = frames(spark)
    left = left.where("doc_id is null or doc_id != 999")
    want = sorted((-1 if i is None else i, *brute(t, items)) for i, t in docs[:-1])
    for limit in (1, 30, 60):
        monkeypatch.setattr(D, "SLICE", limit)
        for right_ in (right.coalesce(1), right.repartition(3)):
            got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_hits, r.n_overlap_words, list(r.item_ids)) for r in D.overlaps(left, right_).collect())
            assert got == want, limit


def test_items_without_id(spark, monkeypatch):
    left = spark.createDataFrame([(1, "x a b c d e f g y", 1), (2, "h i j k l m", 1), (3, "nothing of that kind in here", 1), (4, "x p q r s t", 1)], DOCS)
    right = spark.createDataFrame([(None, "a b c d e f g", ""), (7, "h i j k l m", ""), (None, "h i j k l m", ""), (8, None, ""), (None, "p q r s t", "")], ITEMS).coalesce(1)
    for limit in (D.SLICE, 1):
        monkeypatch.setattr(D, "SLICE", limit)
        got = {r.doc_id: (r.n_hits, r.n_overlap_words, r.item_ids, r.kept) for r in D.overlaps(left, right).collect()}
        assert got == {1: (1, 7, [], False), 2: (1, 6, [7], False), 3: (0, 0, [], True), 4: (1, 5, [], False)}
        assert [r.doc_id for r in D.clean(left, right).collect()] == [3]


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b c d e f", 1)], DOCS)
    assert D.overlaps(docs, none).first().kept and D.overlaps(docs.limit(0), none).count() == 0
