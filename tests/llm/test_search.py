"""Operators 5, 6, 9 and 10 against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import corpus, prose, table, words

from mergeloom.llm import exact, jaccard, substring, suffix
from mergeloom.llm.tokens import Words


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(3).persist()


def extra(docs):
    """Columns with the names that the operators use themselves."""
    return docs.selectExpr("*", "1 as bucket", "2 as pivot", "3 as fp", "4 as hits", "5 as keep_id", "6 as n", "7 as u", "8 as root", "9 as doc_a")


def brute_exact(rows):
    by = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            by[t].add(i)
    return {(i, min(ids)) for ids in by.values() for i in ids if i != min(ids)}


def brute_repeats(rows, length, across):
    seen = defaultdict(set)
    ids = defaultdict(set)
    for i, t in rows:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - length + 1):
            seen[tuple(w[k : k + length])].add((i, k))
            ids[i].add(k)
    marks = defaultdict(dict)
    for places in seen.values():
        again = len({i for i, _ in places}) > 1 if across else len(places) > 1
        if again:
            for i, k in places:
                marks[i][k] = marks[i].get(k, False) or (i, k) == min(places)
    out = set()
    for i, at in marks.items():
        run = None
        for k in sorted(at):
            if run and run[1] == k - 1 and run[2] == at[k]:
                run[1] = k
            else:
                if run:
                    out.add((i, run[0], run[1] - run[0] + length, run[2]))
                run = [k, k, at[k]]
        out.add((i, run[0], run[1] - run[0] + length, run[2]))
    return out


def grams(text, n=3):
    w = words(text)
    return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[k : k + n]) for k in range(len(w) - n + 1)])


def brute_pairs(rows, t):
    """{(a, b)}: documents of J >= t, a < b."""
    sets = [(i, grams(text)) for i, text in set(rows) if i is not None and grams(text)]
    out = set()
    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1 :]:
            if a != b and len(x & y) >= t * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def brute_classes(rows, t):
    """{(doc_id, class_id, n_links)}; no doc_id may come with two texts."""
    pairs = brute_pairs(rows, t)
    root = {i: i for p in pairs for i in p}
    links = Counter(i for p in pairs for i in p)
    for _ in root:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return {(i, root[i], links[i]) for i in root}


def single(rows):
    return [r for r in rows if r[0] != 909]


def test_exact_copies(docs, rows):
    for d in (docs, extra(docs)):
        assert {tuple(r) for r in exact.exact_copies(d).collect()} == brute_exact(rows)
    # with few bits there are false suspects; bytes decide
    assert {tuple(r) for r in exact.exact_copies(docs, spare=0).collect()} == brute_exact(rows)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 500):
        v = np.sort(rng.integers(1000, 1 << 40, n).astype(np.uint64))
        for k in (20, 33):
            assert (exact.unrice(exact.rice(v, 900, k), n, 900, k) == v).all()
    same = np.full(9, 7, np.uint64)
    assert (exact.unrice(exact.rice(same, 7, 1), 9, 7, 1) == same).all()


@pytest.mark.parametrize("length", [8, 50])
def test_substring(docs, rows, length):
    want = brute_repeats([r for r in rows if r[0] != 909], length, True)
    got = substring.repeated_passages(extra(docs).where("doc_id is null or doc_id <> 909"), length=length, k=min(16, length // 2)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("length, period", [(8, 3), (50, 7), (50, 13)])
def test_suffix(docs, rows, length, period):
    want = brute_repeats(single(rows), length, False)
    got = suffix.suffix_repeats(extra(docs).where("doc_id is null or doc_id <> 909"), length=length, period=period).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_suffixes_are_sorted_by_ranks_of_the_sample():
    """Order and classes of a block's suffixes are those of their symbols, and ranks decide them."""
    rng = np.random.default_rng(2)
    for v in suffix.COVERS:
        shifts, depth = suffix.Shifts(v), 2 * v + 1
        text = np.concatenate([rng.integers(0, 3, 40), np.full(30, 1), np.tile([0, 1, 2], 30), rng.integers(0, 2, 200)]).astype(np.uint64)
        n = len(text) - depth - v
        doubling = suffix.Doubling(text, np.array([len(text)]))
        at = np.arange(n)
        by_depth = {d: doubling.ranks(d).astype(np.int64) for d in range(depth - v + 1, depth + 1)}
        # any ranks that are in order at their depth will do
        ranks = np.stack([[by_depth[depth - s][i + s] for i, s in zip(at, shifts.ahead[at % v, k])] for k in range(shifts.ahead.shape[1])], axis=1)
        order, same = suffix.sort_ties(doubling.ranks(v)[:n], at % v, ranks, shifts)
        plain = [tuple(text[i : i + depth].tolist()) for i in at]
        assert [plain[i] for i in order] == sorted(plain)
        assert all((same[i] == same[j]) == (plain[i] == plain[j]) for i in at[::7] for j in at)
        _, blind = suffix.sort_ties(doubling.ranks(v)[:n], at % v, np.ones_like(ranks), shifts)
        assert len(set(blind)) < len(set(same))


def test_ranks_decide_what_repeats(spark, monkeypatch):
    """Passages that agree in 45 words are told apart only by what follows; with the ranks made equal they are not."""
    rng = random.Random(4)
    base = prose(rng, 45)
    rows = [(k, base + " " + prose(rng, 30)) for k in range(8)]
    assert suffix.suffix_repeats(table(spark, rows)).count() == 0 == len(brute_repeats(rows, 50, False))
    block = suffix.sort_ties(np.ones(2, np.uint64), np.zeros(2, int), np.array([[5] * 3, [6] * 3]), suffix.Shifts(7))
    assert len(set(block[1])) == 2
    assert len(set(suffix.sort_ties(np.ones(2, np.uint64), np.zeros(2, int), np.ones((2, 3)), suffix.Shifts(7))[1])) == 1


@pytest.mark.parametrize("across", [True, False])
def test_a_passage_in_very_many_documents(spark, across):
    """Blocks hold it once for each slice, whatever the number of documents."""
    rng = random.Random(8)
    passage, n = prose(rng, 60), 20_000
    df = spark.range(n).selectExpr("id as doc_id", f"concat_ws(' ', repeat(concat('w', id, ' '), 3), '{passage}', 'x', id) as text")
    got = substring.repeated_passages(df) if across else suffix.suffix_repeats(df)
    assert {tuple(r) for r in got.groupBy("start_word", "n_words", "is_first").count().collect()} == {(3, 61, True, 1), (3, 61, False, n - 1)}


def test_search_without_broadcasts(docs, rows, monkeypatch):
    monkeypatch.setattr(substring.C, "BROADCAST_BYTES", 0)
    some = docs.where("doc_id is null or doc_id <> 909")
    assert {tuple(r) for r in suffix.suffix_repeats(some).collect()} == brute_repeats(single(rows), 50, False)
    monkeypatch.setattr(substring.C, "BROADCAST_IDS", 0)
    assert {tuple(r) for r in substring.repeated_passages(some).collect()} == brute_repeats(single(rows), 50, True)
    assert {tuple(r) for r in exact.exact_copies(docs).collect()} == brute_exact(rows)


def test_bad_parameters(docs):
    for call in (lambda: substring.repeated_passages(docs, 5, 9), lambda: jaccard.near_classes(docs, threshold=0.5), lambda: suffix.cover(1000), lambda: suffix.suffix_repeats(docs, 7, 1, 7)):
        with pytest.raises((ValueError, KeyError)):
            call()


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_jaccard(docs, rows, threshold):
    want = brute_classes(single(rows), threshold)
    got = jaccard.near_classes(extra(docs), threshold=threshold).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def large_group(n):
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    rows = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = f"w{rng.randrange(9)}"
        rows.append((k, " ".join(t)))
    return rows


def apart(n):
    """Documents that share a third with one base, and near copies of each."""
    rng = random.Random(3)
    base = prose(rng, 400)
    rows = []
    for k in range(n):
        own = base + " " + prose(rng, 120)
        w = own.split(" ")
        w[rng.randrange(len(w))] = "other"
        rows += [(2 * k, own), (2 * k + 1, " ".join(w))]
    return rows


@pytest.mark.parametrize("big", [4096, 40])
def test_jaccard_of_a_large_group(spark, monkeypatch, big):
    """Regions are divided in a task, and with a lower bound by shuffles and into blocks."""
    monkeypatch.setattr(jaccard, "BIG", big)
    rounds = []
    divide = jaccard._divide
    monkeypatch.setattr(jaccard, "_divide", lambda *x: rounds.append(1) or divide(*x))
    rows = large_group(120) + [(1000 + i, t) for i, t in apart(40)]
    assert {tuple(r) for r in jaccard.near_classes(table(spark, rows)).collect()} == brute_classes(rows, 0.7)
    assert bool(rounds) == (big == 40)


def test_a_common_passage_does_not_copy_its_region(spark, monkeypatch):
    """Unrelated documents that share a passage lie in one region; it is refined, not copied into cells of pivots."""
    monkeypatch.setattr(jaccard, "BIG", 40)
    held, stored = [], jaccard.C.stored

    def count(df, *x):
        back = stored(df, *x)
        if back.columns == jaccard.WORK:
            held.append(back.count())
        return back

    monkeypatch.setattr(jaccard.C, "stored", count)
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(14))
    rows = []
    for k in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(25)]
        rows.append((2 * k, " ".join(own) + " " + passage))
        if k % 10 == 0:
            own[k % 25] = "other"
            rows.append((2 * k + 1, " ".join(own) + " " + passage))
    got = jaccard.near_classes(table(spark, rows), threshold=0.53, slack=0.05).collect()
    assert {tuple(r) for r in got} == brute_classes(rows, 0.53) and len(got) == 60
    assert held[0] > 100 and len(held) > 1 and sum(held[1:]) <= held[0]


def test_jaccard_without_broadcasts(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard.C, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard.C, "BROADCAST_BYTES", 0)
    assert {tuple(r) for r in jaccard.near_classes(docs).collect()} == brute_classes(single(rows), 0.7)


def test_regions_meet_each_pair_once():
    rng = np.random.default_rng(0)
    base = [np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64)) for _ in range(5)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.1], rng.integers(0, 1 << 40, 6).astype(np.uint64)])) for b in base * 70]
    known = [set(s.tolist()) for s in sets]
    near = np.array([[i != j and len(x & y) / len(x | y) >= 0.7 for j, y in enumerate(known)] for i, x in enumerate(known)])
    for m in (350, 300):  # the rest are guests
        region = jaccard.Region(sets, [np.zeros(0, np.int64)] * 350, np.ones(350, np.int64), 0.7)
        region.join(np.arange(m), np.arange(m, 350))
        want = near.copy()
        want[m:, m:] = False
        assert (region.links == want.sum(axis=1)).all() and region.divided >= 1
        assert all(region.root[i] == region.root[j] for i, j in zip(*np.nonzero(want)))
    # pairs that share a lesser pivot are left to its region
    region = jaccard.Region(sets, [np.array([i % 5]) for i in range(350)], np.ones(350, np.int64), 0.7)
    region.join(np.arange(350), np.zeros(0, int))
    assert (region.links == (near & (np.arange(350)[:, None] % 5 != np.arange(350) % 5)).sum(axis=1)).all()


def test_dropping_near_copies(spark, docs, rows):
    gone = {i for i, c, _ in brute_classes(single(rows), 0.7) if i != c}
    left = jaccard.drop_near_copies(extra(docs))
    assert left.columns == extra(docs).columns
    kept = [r for r in rows if r[0] not in gone]
    kept.remove((903, "one"))  # of equal rows one stays
    assert sorted(map(str, [(r.doc_id, r.text) for r in left.collect()])) == sorted(map(str, kept))
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "doc_a long, doc_b long")
    assert {tuple(r) for r in jaccard.groups(chain).collect()} == {(k, 0) for k in range(1, 41)}


def test_the_pipeline_drops_copies_with_many_edits(spark, docs, rows):
    import corpus_pipeline as pipeline

    rng = random.Random(21)
    more = []
    for k in range(2000, 2040, 2):  # three words changed in 36 to 48
        w = prose(rng, rng.randint(36, 48)).split(" ")
        copy = list(w)
        for at in (5, 13, 21):
            copy[at] = "changed"
        more += [(k, " ".join(w)), (k + 1, " ".join(copy))]
    assert len(brute_pairs(more, 0.3)) == len(brute_pairs(more, pipeline.NEAR)) == 20 and not brute_pairs(more, 0.7)
    _, stage = pipeline.STAGES[1]
    assert {r.doc_id for r in stage(spark, table(spark, more), "").collect()} == set(range(2000, 2040, 2))
    want = brute_classes(single(rows) + more, pipeline.NEAR)
    got = jaccard.near_classes(docs.unionByName(table(spark, more)), threshold=pipeline.NEAR, slack=0.05).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_no_rows(spark):
    none = table(spark, [])
    nulls = table(spark, [(None, None), (1, None), (2, "")])
    for d in (none, nulls):
        assert substring.repeated_passages(d).count() == suffix.suffix_repeats(d).count() == exact.exact_copies(d).count() == jaccard.near_classes(d).count() == 0
        assert jaccard.drop_near_copies(d).count() == d.count()


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    texts = [t for _, t in rows] + ["ÀÉ×ß÷ Ünder", "a\x00b", "K"]
    w = Words(pa.array(texts))
    ids = {}
    for r, t in enumerate(texts):
        plain = "".join(c.lower() if c < "Ā" else c for c in (t or ""))
        assert w.count[r] == len(WORDS := __import__("fixtures").WORD.findall(plain))
        for k, x in zip(range(w.first[r], w.first[r + 1]), WORDS):
            assert ids.setdefault(x, w.hash[k]) == w.hash[k]
    assert len(set(map(int, ids.values()))) == len(ids)


def test_a_link_takes_few_bytes_however_many_buckets():
    rng = np.random.default_rng(3)
    size, fp = np.full(400, 50), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    link, row = rng.integers(0, 1 << 48, 20_000).astype(np.uint64), np.repeat(np.arange(400), 50)
    for nb in (1, 8, 60, 1000):
        sent = jaccard._cells(link, row, fp, size, nb)
        assert sum(len(x) for _, x in sent) <= 13 * len(link) + 24 * len(sent)
