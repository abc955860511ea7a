"""The Jaccard join against brute force over all pairs."""

import random
import re

import pytest
from tidemark.llm import jaccard

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(texts, k=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, up = sets_of([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d is None, d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows))


def got(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes_of(frame).collect())


def edited(rng, words, share):
    out = []
    for w in words:
        out += [] if rng.random() < share / 3 else [f"x{rng.randrange(10**6)}"] if rng.random() < share / 2 else [w]
    return out


def test_near_groups_of_every_closeness_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 12, 14, 18, 25, 40, 70, 150, 400]))]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))) for _ in range(rng.randrange(6))]
    passage = [f"p{i}" for i in range(60)]
    rows += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(20)] + passage) for _ in range(40)]
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    assert got(spark, rows) == brute(rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 32)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.04])))) for i in range(250)]
    assert got(spark, rows) == brute(rows)


def test_small_sets_meet_by_subsets(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[a : a + rng.randrange(1, 20)])) for i, a in enumerate([rng.randrange(12) for _ in range(150)])]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(50_000))
    rows = [(None, None), (1, ""), (2, None), (3, "  \t "), (4, "A b"), (5, "a B"), (5, "a B"), (5, "c d e f g"), (None, "a b"), (7, long), (8, long + " end"), (8, "\x00   x")]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, id string, a int")
    assert jaccard.classes_of(empty).collect() == []
    rows = spark.createDataFrame([(1, "a b c d e", "k", "i", 1), (2, "a b c d e", "k", "i", 2)], empty.schema)
    assert sorted(r.component_id for r in jaccard.classes_of(rows).collect()) == [1, 1]


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(4, text, "x"), (2, text, "y"), (2, text, "y"), (9, text + " more", "z"), (5, "alone here", "u"), (6, None, "n"), (7, "", "e"), (None, text, "m")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string"))
    assert kept.columns == ["doc_id", "text", "root"]
    assert sorted((r.doc_id, r.root) for r in kept.collect()) == [(2, "y"), (5, "u"), (6, "n"), (7, "e")]


@pytest.mark.parametrize("a", range(1, 40))
def test_sizes_that_can_link_are_enumerated(a):
    lo, hi = jaccard.partners(a)
    assert 100 * lo >= 85 * a > 100 * (lo - 1) and 85 * hi <= 100 * a < 85 * (hi + 1)
    for b in range(lo, hi + 1):
        need = jaccard.least_overlap(a, b)
        assert 100 * need >= 85 * (a + b - need) and 100 * (need - 1) < 85 * (a + b - need + 1)
        if need <= min(a, b):
            assert need in jaccard.subset_sizes(a) and need in jaccard.subset_sizes(b)


def test_the_stage_links_five_word_shingles_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 14, 22, 40, 70, 150]))]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, rng.choice([0, 0.02, 0.04]))) for _ in range(6)]
    base = [f"v{i}" for i in range(104)]
    rows += [" ".join(base), " ".join([*base[:-11], *(f"y{i}" for i in range(11))])]  # 89 of 111 shingles: links here, not at 0.85
    rows = list(enumerate(rows))
    sets, up = sets_of([t for _, t in rows], 5), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    kept = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(rows))})
