"""Similarity join and passages against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tarnwell.llm import components as K
from tarnwell.llm import jaccard_join as J
from tarnwell.llm import substring_dedup as P

WORDS = [f"w{i}" for i in range(4000)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, words, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in words.split())


def corpus(seed=5):
    """Near copies of several grades, one dense group, a passage that many documents share, and odd texts."""
    rng = random.Random(seed)
    bases = [text(rng, rng.randint(60, 200)) for _ in range(12)]
    out = [t for b in bases for t in [b, b, edited(rng, b, 0.01), edited(rng, b, 0.02), edited(rng, b, 0.05)]]
    dense, passage = text(rng, 150), text(rng, 60)
    out += [edited(rng, dense, 0.015) for _ in range(60)]
    out += [f"{text(rng, 40)} {passage} {text(rng, 50)}" for _ in range(60)]
    out += [text(rng, 80) for _ in range(40)] + [None, "", " \n", "one", "one", "one two three four five", "one two three four five", "two words", "q " * 30, "q " * 31]
    return list(enumerate(out))


def brute_links(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        words = (t or "").split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    links = {i: set() for i, _ in rows}
    for (i, _), (j, _) in combinations(rows, 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
            links[i].add(j)
            links[j].add(i)
    return links


def classes(links):
    out = {}
    for i in sorted(links):
        if i in out:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in out:
                out[j] = i
                stack += links[j]
    return out


@pytest.mark.parametrize("block", [512, 16])
def test_join_equals_brute_force(texts, block):
    rows = corpus()
    links = brute_links(rows)
    wanted = classes(links)
    found = {r.doc_id: r for r in J.jaccard_join(texts(rows), block=block).collect()}
    assert {i: r.n_links for i, r in found.items()} == {i: len(v) for i, v in links.items()}
    assert {i: r.class_id for i, r in found.items()} == wanted
    assert max(map(len, links.values())) > 20


def test_join_edge_cases(texts):
    t = "a b c d e f g h"
    found = J.jaccard_join(texts([(4, t), (4, t), (None, t), (None, None), (7, "other words stand here now")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links) for r in found if r.class_id is not None) == [(False, 4, 4, 2), (False, 4, 4, 2), (False, 7, 7, 0), (True, 0, 4, 2)]
    assert J.jaccard_join(texts([])).count() == 0
    rng = random.Random(7)
    long_ = text(rng, 60_000)
    found = J.jaccard_join(texts([(1, long_), (2, edited(rng, long_, 0.01)), (3, edited(rng, long_, 0.2)), (4, "x " * 90_000)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_near_copies_meet_once(texts, monkeypatch):
    """A group of near copies fills many buckets of more than a block, which are compared as one."""
    rng = random.Random(17)
    base = text(rng, 120)
    rows = [(i, edited(rng, base, 0.008)) for i in range(80)] + [(100 + i, text(rng, 60)) for i in range(20)]
    counts, stored = {}, J.written
    monkeypatch.setattr(J, "written", lambda df, name: counts.__setitem__(name, (out := stored(df, name)).count()) or out)
    found = {r.doc_id: r for r in J.jaccard_join(texts(rows), block=16).collect()}
    links = brute_links(rows)
    of = classes(links)
    assert {k: r.n_links for k, r in found.items()} == {k: len(links[k]) for k, _ in rows}
    assert {k: r.class_id for k, r in found.items()} == {k: of[k] for k, _ in rows}
    # Each meets every block once, not once a bucket.
    assert counts["members"] < 80 * (1 + 80 / 16) * 2


def test_runs_follow_recall():
    assert J.runs_for(0.9, 0.8) < J.runs_for(0.99, 0.8) < J.runs_for(0.9999, 0.8)
    rng = np.random.default_rng(2)
    a = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    runs, met = 200, 0
    b = np.unique(np.concatenate((a[: int(len(a) * 8 / 9)], rng.integers(0, 2**63, len(a) // 9, dtype=np.uint64))))
    x, y = ([J.choose(s, runs, 0.8, k) for k in range(J.LEVELS)] for s in (a, b))
    for run in range(runs):
        own = [[{int(v) for v in p[k] if int(v) >> 32 == run} for k in range(J.LEVELS)] for p in (x, y)]
        met += all(own[0][k] & own[1][k] for k in range(J.LEVELS))
    assert met / runs > 0.4  # the bound for a nested pair is 0.47


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500), (300, 301)]
    parent = {}
    links = {n: set() for e in edges for n in e}
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    parent = classes(links)
    found = {r.node: r.root for r in K.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {n: r for n, r in parent.items() if n != r}
    assert K.components(spark.createDataFrame([], "u long, v long")).count() == 0


def best_chain(runs, gap_cost, most_gap):
    """Best chain score by trying all predecessors."""
    order = sorted(range(len(runs)), key=lambda i: runs[i][0])
    score = {}
    for i in order:
        a, b, n = runs[i]
        score[i] = n
        for j in score:
            x, y, m = runs[j]
            if j != i and x + m <= a and y + m <= b and a - x - m <= most_gap and b - y - m <= most_gap:
                score[i] = max(score[i], score[j] + n - gap_cost * (a - x - m + b - y - m))
    return max(score.values())


def test_chaining_finds_the_best_chain():
    rng = random.Random(4)
    for _ in range(60):
        runs = np.array([(rng.randrange(200), rng.randrange(200), rng.randrange(3, 12)) for _ in range(rng.randrange(1, 25))])
        first = P.chains(runs, 0.1, 10**6)[0]
        score = sum(runs[i][2] for i in first) - 0.1 * sum((runs[j][0] - runs[i][0] - runs[i][2]) + (runs[j][1] - runs[i][1] - runs[i][2]) for i, j in zip(first, first[1:]))
        assert all(runs[i][0] + runs[i][2] <= runs[j][0] and runs[i][1] + runs[i][2] <= runs[j][1] for i, j in zip(first, first[1:]))
        assert abs(score - best_chain(runs.tolist(), 0.1, 10**6)) < 1e-9


def test_passages(texts):
    rng = random.Random(8)
    exact, fuzzy, long_, short = text(rng, 70), text(rng, 90), text(rng, 3000), text(rng, 30)
    put = lambda p: f"{text(rng, 60)} {p} {text(rng, 60)}"
    rows = [put(exact) for _ in range(40)] + [put(edited(rng, fuzzy, 0.04)) for _ in range(6)] + [put(short), put(short)] + [text(rng, 150) for _ in range(10)] + [put(long_), put(long_)] + [text(rng, 100)] * 2 + [None, "", "x", "x"]
    rows[-6] = rows[-5]
    found, links = P.repeated_passages(texts(list(enumerate(rows))))
    found = {r.doc_id: r for r in found.collect()}
    assert set(found) == {*range(46), 58, 59, len(rows) - 6, len(rows) - 5}  # all but the short passage and clean texts
    assert all(found[i].n_dup_words in range(70, 74) and found[i].copies == 0 for i in range(40))
    assert all(50 <= found[i].n_dup_words <= 94 for i in range(40, 46))
    assert all(3000 <= found[i].n_dup_words <= 3005 for i in (58, 59))
    assert found[len(rows) - 5].copies == 1 and found[len(rows) - 5].partners == [len(rows) - 6]
    assert sum(len(r.partners) for r in found.values()) >= 39 + 5 + 1
    by_id = dict(enumerate(rows))
    for r in links.collect():
        for p in r.passages:
            x, y = by_id[r.left_id].split()[p.s : p.u], by_id[r.right_id].split()[p.t : p.v]
            assert min(len(x), len(y)) >= 50 and p.same >= 0.8 * max(len(x), len(y)) and len(set(x) & set(y)) >= 0.7 * len(set(x))
    none, _ = P.repeated_passages(texts([]))
    assert none.count() == 0


def words_of(rng, n):
    return np.array([rng.randrange(2**60) for _ in range(n)], dtype=np.uint64)


def test_passages_beside_other_matches():
    rng = random.Random(3)
    new, join = (lambda n: words_of(rng, n)), (lambda *parts: np.concatenate(parts))
    one, two, line, long_, tail = new(55), new(55), new(12), new(500), new(110)
    find = lambda x, y: P.passages(x, y, *map(np.array, zip(*[(i, j) for i in range(len(x) - 5) for j in range(len(y) - 5) if (x[i : i + 6] == y[j : j + 6]).all()])), k=6, least=50, identity=0.8)
    # Two exact passages with other words between them.
    x, y = join(one, new(40), two), join(one, new(40), two)
    assert find(x, y) == [(0, 55, 0, 55, 55), (95, 150, 95, 150, 55)]
    # A passage with a short common line behind it.
    x, y = join(new(20), one, new(30), line), join(new(9), one, new(30), line)
    assert find(x, y) == [(20, 75, 9, 64, 55)]
    # After a long passage, one with insertions 100 words later.
    x, y = join(long_, new(100), tail[:20], tail[20:40], tail[40:]), join(long_, new(100), tail[:20], new(2), tail[20:40], new(2), tail[40:])
    assert find(x, y) == [(0, 500, 0, 500, 500), (600, 710, 600, 714, 110)]


def test_chaining_within_the_gap():
    rng = random.Random(6)
    for _ in range(60):
        runs = np.array([(rng.randrange(300), rng.randrange(300), rng.randrange(3, 12)) for _ in range(rng.randrange(1, 40))])
        first = P.chains(runs, 0.1, 60)[0]
        score = sum(runs[i][2] for i in first) - 0.1 * sum((runs[j][0] - runs[i][0] - runs[i][2]) + (runs[j][1] - runs[i][1] - runs[i][2]) for i, j in zip(first, first[1:]))
        assert abs(score - best_chain(runs.tolist(), 0.1, 60)) < 1e-9


def test_passages_of_several_holders(texts):
    rng = random.Random(12)
    put = lambda p: f"{text(rng, 60)} {p} {text(rng, 60)}"
    rows = []
    for _ in range(12):  # B and C share 60 words, of which others hold one half each
        one, two = text(rng, 30), text(rng, 30)
        rows += [put(one), put(two), put(f"{one} {two}"), put(f"{one} {two}")]
    lines = [text(rng, 20) for _ in range(3)]
    rows += [put(line) for line in lines for _ in range(20)]  # common lines of many holders, and a passage of all three
    rows += [put(" ".join(lines)) for _ in range(2)]
    twice = text(rng, 55)
    rows += [put(f"{twice} {text(rng, 80)} {twice}"), put(twice)]  # a passage with two places in one text
    rows = list(enumerate(rows))
    found, links = P.repeated_passages(texts(rows))
    found = {r.doc_id: r for r in found.collect()}
    assert set(found) == {i for i in range(48) if i % 4 > 1} | {108, 109, 110, 111}
    assert all(60 <= found[i].n_dup_words <= 64 for i in [*range(2, 48, 4), 108, 109]) and found[111].n_dup_words >= 55 and found[110].n_dup_words >= 110
    assert links.count() == 14


def test_recall_by_edit_rate():
    rng = random.Random(21)
    new = lambda n: words_of(rng, n)
    vary = lambda w, rate: np.array([rng.randrange(2**60) if rng.random() < rate else v for v in w.tolist()], dtype=np.uint64)

    def meets(x, y):
        """Two seeds in common, and a passage by all k-mers."""
        return len(np.intersect1d(P.seeds(x, 4, 24)[0], P.seeds(y, 4, 24)[0])) > 1 and bool(P.passages(x, y, *P.shared(x, y, 4), k=4, least=50, identity=0.8))

    for n, rate, wanted in [(55, 0.05, 0.99), (60, 0.05, 0.99), (60, 0.1, 0.99), (80, 0.15, 0.95), (100, 0.15, 0.98), (100, 0.19, 0.95)]:
        met = total = 0
        for _ in range(100):
            base = new(n)
            other = vary(base, rate)
            same = np.flatnonzero(base == other)
            # What brute force over all pairs of agreeing places finds.
            if len(same) and P.best_parts(same, same, 50, 0.8):
                total += 1
                met += meets(np.concatenate((new(40), base, new(40))), np.concatenate((new(70), other, new(30))))
        assert total > 30 and met >= wanted * total, (n, rate, met, total)
    base = new(90)
    sixth = base.copy()
    sixth[5::6] = new(15)
    assert meets(np.concatenate((new(40), base, new(40))), np.concatenate((new(70), sixth, new(30))))


def test_common_words_bound_what_can_agree():
    rng = random.Random(9)
    for _ in range(200):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
        assert P.common_words(x, y) == [row[-1] for row in best]


def test_repeated_words_have_bounded_matches():
    x, y = np.zeros(3000, dtype=np.uint64), np.zeros(2000, dtype=np.uint64)
    a, b = P.shared(x, y, 4)
    assert 2000 - 3 <= len(a) < 60_000
    assert sum(u - s for s, u, *_ in P.passages(x, y, a, b, k=4, least=50, identity=0.8)) >= 2000


def test_reach_equals_trying_all_lengths():
    rng = random.Random(11)
    seen = set()
    for _ in range(400):
        size = rng.choice([2, 4, 8, 30])
        lists = [[rng.randrange(size) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        inner, least = rng.randrange(1, 12), rng.randrange(5, 30)
        before, after = P.common_words(*lists[:2]), P.common_words(*lists[2:])
        wanted = any(u + v + inner >= least and a + b + inner >= 0.8 * (u + v + inner) - 1e-9 for u, a in enumerate(before) for v, b in enumerate(after))
        assert P.may_reach(tuple(lists[:2]), inner, tuple(lists[2:]), least, 0.8) == wanted
        seen.add(wanted)
    assert seen == {True, False}


# Repeated passages: recall on planted pairs, with an aligner that shares nothing with the operator


def local_alignment(x, y, least=50, identity=0.8):
    """Whether two lists of words hold a passage, by the plain table of common subsequences of every stretch of ``least`` words of x against y."""
    for i in range(len(x) - least + 1):
        part = x[i : i + least]
        for j in range(len(y) - least + 1):
            other = y[j : j + least]
            if sum(a == b for a, b in zip(part, other)) >= identity * least:
                return True
    return False


def planted(kind, change, others, n, seed=5):
    """Pairs of documents that share a passage of 60 words, some of them changed, among documents of the same words or stock phrases."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(5000)]
    stock = [[rng.choice(vocab) for _ in range(6)] for _ in range(150)]

    def words(k):
        out = []
        while len(out) < k:
            out += rng.choice(stock) if kind == "stock" else [rng.choice(vocab)]
        return out[:k]

    rows, pairs = [], []
    for _ in range(n):
        passage = words(60)
        copy = [rng.choice(vocab) if rng.random() < change else w for w in passage]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), words(40) + passage + words(40)), (len(rows) + 1, words(30) + copy + words(55))]
    rows += [(len(rows) + i, words(rng.randrange(80, 160))) for i in range(others)]
    return rows, pairs


@pytest.mark.parametrize(("kind", "change", "others"), [("own", 0.1, 0), ("stock", 0.05, 0), ("stock", 0.1, 1500)])
def test_planted_passages_are_found(spark, kind, change, others):
    rows, pairs = planted(kind, change, others, 60)
    true = [p for p in pairs if local_alignment(rows[p[0]][1], rows[p[1]][1])]
    found, links = P.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    met = {tuple(sorted((r.left_id, r.right_id))) for r in links.collect()}
    assert len(true) > 50 and sum(p in met for p in true) >= 0.95 * len(true)
    assert {d for p in true if p in met for d in p} <= {r.doc_id for r in found.collect()}


def test_third_places_of_a_seed_count(spark):
    """A passage behind two stretches that hold its seeds already, on one side only."""
    rng = random.Random(3)
    passage = [f"p{rng.randrange(9000)}" for _ in range(55)]
    pieces = lambda: [w for i in rng.sample(range(0, 50, 5), 10) for w in [*passage[i : i + 5], f"x{rng.randrange(9000)}"]]
    rows = [(1, pieces() + pieces() + passage), (2, passage + ["end"] * 3)]
    found, _ = P.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == {1, 2}


@pytest.mark.parametrize("seed", range(4))
def test_chains_are_the_best_of_all(seed):
    """Scores of chains against trying all predecessors."""
    rng = random.Random(seed)
    runs = np.array(sorted({(rng.randrange(400), rng.randrange(400), rng.randrange(4, 20)) for _ in range(60)}))
    cost, gap = 0.1, 60
    best = {}
    for i in sorted(range(len(runs)), key=lambda i: runs[i][0]):
        a, b, n = map(int, runs[i])
        before = [best[j] - cost * (a - x - k + b - y - k) for j, (x, y, k) in enumerate(runs.tolist()) if j in best and x + k <= a and y + k <= b and a - x - k <= gap and b - y - k <= gap]
        best[i] = n + max([0, *before])
    top = P.chains(runs, cost, gap)[0]
    score = sum(int(runs[i][2]) for i in top) - cost * sum(int(runs[j][0] - runs[i][0] - runs[i][2] + runs[j][1] - runs[i][1] - runs[i][2]) for i, j in zip(top, top[1:]))
    assert abs(score - max(best.values())) < 1e-9
    assert all(runs[i][0] + runs[i][2] <= runs[j][0] and runs[i][1] + runs[i][2] <= runs[j][1] for i, j in zip(top, top[1:]))


def test_seeds_in_common_are_counted_with_repeats():
    rng = random.Random(1)
    rows = [np.array([rng.randrange(4) for _ in range(rng.randrange(0, 40))], dtype=np.uint64) for _ in range(60)]
    grams = [Counter(tuple(r[i : i + 3].tolist()) for i in range(len(r) - 2)) for r in rows]
    for dense in (3, 32):
        found = P.shared_grams(np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows])), dense=dense)
        assert all(found[i, j] == (grams[i] & grams[j]).total() for i in range(60) for j in range(60) if i != j)


@pytest.mark.parametrize("tile", [1024, 16])
def test_holders_of_a_frequent_seed_are_all_tried(texts, monkeypatch, tile):
    """Pairs whose only seeds are those of a line that many hold, and that go on alike behind it but for each fourth word."""
    rng = random.Random(31)
    line, pairs, rows = text(rng, 24), [], []
    for _ in range(12):
        behind = text(rng, 40).split()
        for _ in range(2):
            other = [w if i % 4 != 3 else f"x{rng.randrange(10**6)}" for i, w in enumerate(behind)]
            rows.append(f"{text(rng, 60)} {line} {' '.join(other)} {text(rng, 60)}")
        pairs.append((len(rows) - 2, len(rows) - 1))
    rows += [f"{text(rng, 60)} {line} {text(rng, 60)}" for _ in range(40)]
    monkeypatch.setattr(P.rest, "__kwdefaults__", {**P.rest.__kwdefaults__, "tile": tile})
    found, links = P.repeated_passages(texts(list(enumerate(rows))))
    assert {(r.left_id, r.right_id) if r.left_id < r.right_id else (r.right_id, r.left_id) for r in links.collect()} == set(pairs)
    assert {r.doc_id: r.class_id for r in found.collect()} == {i: p[0] for p in pairs for i in p}


def test_holders_of_a_line_alone_make_no_pairs(spark):
    """Many texts hold one line of 24 words, too few for a passage: of all their pairs only the one that goes on alike is handed on to be compared."""
    rng = random.Random(8)
    line, behind = words_of(rng, 24), words_of(rng, 40)
    rows = [np.concatenate((words_of(rng, 60), line, words_of(rng, 60))) for _ in range(60)]
    for i in (3, 41):
        rows[i] = np.concatenate((rows[i][:84], behind, words_of(rng, 20)))
    frequent = spark.createDataFrame([(i, key, 60 + key) for i in range(60) for key in (0, 6, 12, 18)], "node long, key long, at int")
    words = spark.createDataFrame([(i, bytearray(r.astype("<u4").tobytes())) for i, r in enumerate(rows)], "node long, words binary")
    classes = spark.createDataFrame([], "node long, root long")
    for tile in (1024, 16):
        found = P.rest(frequent, classes, words, least=50, identity=0.8, all_=True, tile=tile).collect()
        assert sorted((r.left, r.right, r.key, r.l, r.r) for r in found) == [(3, 41, key, 60 + key, 60 + key) for key in (0, 6, 12, 18)]


def test_words_and_grams_in_common_of_parts():
    rng = random.Random(2)
    rows = [np.array([rng.randrange(6) for _ in range(rng.randrange(0, 40))], dtype=np.uint64) for _ in range(50)]
    words, bounds = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    full = P.shared_grams(words, bounds)
    for dense in (3, 96):
        assert (P.shared_grams(words, bounds, dense=dense, split=20) == full[:20, 20:]).all()
    i, j = np.triu_indices(50, 1)
    common = [(Counter(rows[a].tolist()) & Counter(rows[b].tolist())).total() for a, b in zip(i, j)]
    assert all((P.words_met(words, bounds, i, j, at_once) == common).all() for at_once in (64, 1 << 13))
    assert all(P.words_in_both(rows[a].tolist(), rows[b].tolist()) >= n for a, b, n in zip(i, j, common))


def test_best_parts_equal_trying_all_ranges():
    """The best part, by agreeing words less two for each that differs, of all ranges of agreeing words; ties go to the first."""
    rng = random.Random(6)
    for _ in range(300):
        p, q, at, to = [], [], 0, 0
        for _ in range(rng.randrange(1, 12)):
            n = rng.randrange(1, 9)
            p += range(at, at + n)
            q += range(to, to + n)
            at, to = at + n + rng.choice([1, 1, 2, 5]), to + n + rng.choice([0, 1, 1, 2])
        ranges = [(i, j) for i in range(len(p)) for j in range(i, len(p)) if min(p[j] - p[i], q[j] - q[i]) + 1 >= 10 and j - i + 1 >= 0.8 * (max(p[j] - p[i], q[j] - q[i]) + 1)]
        score = lambda r: 3 * (r[1] - r[0] + 1) - 2 * (max(p[r[1]] - p[r[0]], q[r[1]] - q[r[0]]) + 1)
        found = P.best_parts(np.array(p), np.array(q), 10, 0.8)
        assert bool(found) == bool(ranges) and (not ranges or score(found[0]) == max(map(score, ranges)))


def test_shared_places_equal_all_places():
    """Places of equal k-mers, in texts long enough for most k-mers to have no equal."""
    rng = np.random.default_rng(9)
    for size, n in ((4, 12), (40, 300), (10**6, 3000)):
        x, y = (rng.integers(0, size, n).astype(np.uint64) for _ in range(2))
        y[: n // 4] = x[n // 2 : n // 2 + n // 4]
        places = {}
        for i in range(n - 3):
            places.setdefault(tuple(x[i : i + 4]), []).append(i)
        wanted = {(i, j) for j in range(n - 3) for i in places.get(tuple(y[j : j + 4]), ())}
        assert set(zip(*(v.tolist() for v in P.shared(x, y, 4, most=10**6)))) == wanted
        assert len(P.shared(x, y, 4, at_least=n)[0]) == 0


def test_one_seed_in_common_is_tried(texts):
    """Passages of 52 words of which a fifth are changed, so that two texts share one seed and no other text has it."""
    rng = random.Random(41)
    hashed = lambda t: P.text_words(pa.array([t]))[0]
    rows = []
    while len(rows) < 12:
        base = text(rng, 52).split()
        other = [w if i % 5 != 4 else f"y{rng.randrange(10**6)}" for i, w in enumerate(base)]
        a, b = f"{text(rng, 50)} {' '.join(base)} {text(rng, 50)}", f"{text(rng, 70)} {' '.join(other)} {text(rng, 30)}"
        x, y = hashed(a), hashed(b)
        if len(np.intersect1d(P.seeds(x, 4, 24)[0], P.seeds(y, 4, 24)[0])) == 1 and P.passages(x, y, *P.shared(x, y, 4), k=4, least=50, identity=0.8):
            rows += [a, b]
    found, links = P.repeated_passages(texts(list(enumerate(rows))))
    assert {tuple(sorted((r.left_id, r.right_id))) for r in links.collect()} == {(i, i + 1) for i in range(0, 12, 2)}
    assert {r.doc_id: r.class_id for r in found.collect()} == {i: i - i % 2 for i in range(12)}


def test_words_that_only_a_class_repeats_count(texts):
    """Two texts that a third one joins, and that share a passage whose seeds many texts hold: its words count although both are of one class already."""
    rng = random.Random(43)
    line, rows = text(rng, 24), []
    for _ in range(6):
        one, two, behind = text(rng, 60), text(rng, 60), text(rng, 40).split()
        alike = lambda: " ".join(w if i % 4 != 3 else f"x{rng.randrange(10**6)}" for i, w in enumerate(behind))  # noqa: B023, E731
        rows += [f"{one} {text(rng, 70)} {two}", f"{one} {text(rng, 110)} {line} {alike()} {text(rng, 60)}", f"{two} {text(rng, 110)} {line} {alike()} {text(rng, 60)}"]
    rows += [f"{text(rng, 60)} {line} {text(rng, 60)}" for _ in range(40)]
    found, links = P.repeated_passages(texts(list(enumerate(rows))))
    found = {r.doc_id: r for r in found.collect()}
    assert set(found) == set(range(18)) and all(found[i].class_id == i - i % 3 for i in found)
    assert all(found[i].n_passages == 2 and found[i].n_dup_words >= 60 + 55 for i in found)
    assert links.count() == 18


def test_rounds_hold_few_windows_and_change_nothing(spark, monkeypatch):
    """Seeds of many holders go to many tiles, and candidates shuffle all seeds: both in rounds, whose results are those of one."""
    rng = random.Random(47)
    line, rows = words_of(rng, 24), [words_of(rng, 150) for _ in range(80)]
    for i, r in enumerate(rows):
        r[60:84] = line
        if i % 4 == 1:
            r[84:124] = rows[i - 1][84:124]
    seeds = spark.createDataFrame([(i, key, 60 + key) for i in range(80) for key in (0, 6, 12, 18)], "node long, key long, at int")
    words = spark.createDataFrame([(i, bytearray(r.astype("<u4").tobytes())) for i, r in enumerate(rows)], "node long, words binary")
    names, plain = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: names.append(name) or plain(df, name))
    found = []
    for at_once in (1 << 20, 1):
        names.clear()
        out = P.rest(seeds, spark.createDataFrame([], "node long, root long"), words, least=50, identity=0.8, all_=True, tile=16, at_once=at_once)
        found.append((names.count("rest"), sorted(map(tuple, out.collect()))))
    # Each of 320 rows goes to five tiles, with up to 204 words; there are 12,000 words in all.
    assert found[0][0] == 1 and found[1][0] > 20 and found[0][1] == found[1][1] and len(found[0][1]) == 80
    held = spark.createDataFrame([(i, int(key), n, 3 * n) for i, r in enumerate(rows) for n, key in enumerate(P.seeds(r, 4, 24)[0])], "node long, key long, place int, at int")
    pairs = [sorted(map(tuple, P.candidates(held, rounds=rounds)[0].collect())) for rounds in (1, 3)]
    assert pairs[0] == pairs[1] and pairs[0]


def test_grams_in_common_of_many_small_groups():
    rng = random.Random(4)
    rows = [np.array([rng.randrange(4) for _ in range(rng.randrange(0, 40))], dtype=np.uint64) for _ in range(50)]
    group = np.sort(np.array([rng.randrange(12) for _ in rows]))
    grams = [Counter(tuple(r[i : i + 3].tolist()) for i in range(len(r) - 2)) for r in rows]
    i, j, counts = P.grams_met(np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows])), group)
    wanted = {(a, b): n for a in range(50) for b in range(a + 1, 50) if group[a] == group[b] and (n := (grams[a] & grams[b]).total())}
    assert dict(zip(zip(i.tolist(), j.tolist()), counts.tolist())) == wanted and wanted
