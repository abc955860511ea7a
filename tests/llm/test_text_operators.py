"""Decontamination, tokens, lines and the classifiers against plain Python."""

import hashlib
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import bpe, decontaminate, jaccard, line_dedup, quality, toxicity, words
from tidemark.llm._shared import Scratch

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# words and contamination


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é日 .\n\x00|~", max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    joined, starts, ends, hashes, first = words.words([t.encode() for t in texts], words.ALNUM)
    flat = [joined[a:b].lower().decode() for a, b in zip(starts, ends, strict=True)]
    assert [flat[a:b] for a, b in zip(first, first[1:], strict=False)] == [plain_words(t) for t in texts]
    assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_long_texts_are_cut_at_separators(monkeypatch):
    text = ("ab " * 400 + "x" * 300 + " c").encode()
    whole = words.words([text], words.ALNUM)
    monkeypatch.setattr(words, "PART", 64)
    for a, b in zip(whole[1:], words.words([text], words.ALNUM)[1:], strict=True):
        assert np.array_equal(a, b)


def judged(docs, items):
    grams = {}
    for name, t in items:
        w = plain_words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(name)
    out = []
    for d, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for n, some in grams.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in some:
                    hit |= set(range(k, k + n))
                    found |= some[tuple(w[k : k + n])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((str(d), len(w), len(hit), names, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def cases():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(12)] + [(3, "again the same id with words"), (None, "nameless item words here"), (50, None), (51, "--"), (52, "ÉTÉ straße")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100 + i, " ".join(["pad"] * rng.randrange(300)) + " ; " + (t or "").upper() + " ! " + " ".join(["end"] * 5)) for i, (_, t) in enumerate(items)]
    return [*docs, (1, None), (1, ""), (None, items[5][1]), (None, items[5][1]), (7, " ".join(vocab) * 2000 + items[6][1])], items


@pytest.mark.parametrize("bound", [1 << 30, 0])
def test_contamination_matches_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", bound)
    docs, items = cases()
    got = decontaminate.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()) == judged(docs, items)


def test_contaminated_documents_and_spans_go(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(20))
    docs = [(1, f"début {item}. fin"), (2, "clean"), (3, None), (4, "x " * 500 + item)]
    frame, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS)
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(frame, items).collect()) == [2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(frame, items).collect()}
    assert cut == {1: "début . fin", 2: "clean", 3: None, 4: "x " * 500}
    assert decontaminate.report(frame, items.limit(0)).where("n_hit > 0").isEmpty()
    clash = frame.withColumns({"n_hit": F.lit("x"), "items": F.lit(1), "spans": F.lit(2), "_items": F.lit(3)})
    assert sorted((r.doc_id, r["items"], r._items) for r in decontaminate.drop_contaminated(clash, items).collect()) == [(2, 1, 3), (3, 1, 3), (4, 1, 3)]
    told = decontaminate.report(clash, items)
    assert told.columns == ["doc_id", "text", "_items", *decontaminate.ADDED] and {r.doc_id: r.n_hit for r in told.collect()} == {1: 20, 2: 0, 3: 0, 4: 20}
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    assert {r.doc_id: r.n_hit for r in decontaminate.report(clash, items).collect()} == {1: 20, 2: 0, 3: 0, 4: 20}


# tokens


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(*bpe.ranks_and_pattern())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'sltv 0９é　\n\t\x85\x1c日!?", max_size=120), st.integers(2, 40), st.integers(1, 5))
def test_halving_changes_no_token(text, leaf, reach):
    c = bpe.codec(*bpe.ranks_and_pattern())
    ids = c.encode(text, leaf, reach)
    assert ids == c.raw.encode_ordinary(text) and c.decode(ids, 3) == text.encode()


def test_tokens_are_those_of_the_library(spark, codec):
    path, pattern = bpe.ranks_and_pattern()
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = [None, "", "<|endoftext|>", "a" * 20_000, " " * 9_000, "".join(rng.choice("the quick  brown\n'sé日") for _ in range(30_000)), "x"]
    rows = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, ids int, n_tokens string")
    for r in bpe.encode_digests(rows, path, pattern).collect():
        ids = lib.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    clash = rows.withColumns({"_text": F.lit("q"), "ids_sha256": F.lit("r"), "decoded": F.lit(1)})
    assert bpe.encode_digests(clash, path, pattern, keep=["doc_id", "_text", "ids_sha256"]).where("doc_id = 6 and n_tokens = 1 and _text = 'q' and length(ids_sha256) = 64").count() == 1
    assert bpe.encode_ids(clash, path, pattern).columns == ["doc_id", "text", "n_tokens", "_text", "ids_sha256", "decoded", "ids"]
    back = bpe.decode_ids(bpe.encode_ids(rows, path, pattern, into="coded"), path, pattern, "coded").collect()
    assert all(bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in back)


# lines


def norm(line):
    """A line's words, with a space between; independent of the operator's tables."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in line.lower()).split())


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def close(a, b, edit=edit):
    most = int(max(len(a), len(b)) * 0.2 + 1e-9)
    return abs(len(a) - len(b)) <= most and edit(a, b) <= most


def described(form):
    """A line's SimHashes, each with its blocks."""
    return [(int(sims[0]), set(keys.tolist())) for _, sims, _, keys in line_dedup.describe(form)[4:] if len(sims)]


def meets(one, other):
    return any(bin(a ^ b).count("1") <= line_dedup.HAMMING and (x & y or a == b) for a, x in one for b, y in other)


def brute_lines(spark, docs):
    """Places that go: SimHashes and blocks from the operator, all pairs, edits and groups in plain Python."""
    by = {}
    for d, t in docs:
        for i, line in enumerate([] if t is None else t.split("\n")):
            if norm(line):
                by.setdefault(norm(line), []).append((d is not None, d, spark_hash(spark, t), i))
    told = {k: described(k) for k in by}
    up = {k: k for k in by}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = list(by)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if meets(told[a], told[b]) and close(a, b, line_dedup.edits):
                up[find(a)] = find(b)
    stay = {}
    for k in keys:
        stay[find(k)] = min([*([stay[find(k)]] if find(k) in stay else []), *by[k]])
    return {p[1:] for k in keys for p in by[k] if p != stay[find(k)]}


_HASHES = {}


def spark_hash(spark, text):
    if text not in _HASHES:
        _HASHES[text] = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]
    return _HASHES[text]


def removed(spark, docs):
    return {(r._doc, r._text, i) for r in line_dedup.removals(spark.createDataFrame(docs, DOCS)).collect() for i in r._gone}


def test_lines_match_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"word{i}" for i in range(300)]
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 60]))) for _ in range(25)]

    def vary(line):
        w = line.split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        return " ".join(w).title() if rng.random() < 0.3 else " ".join(w)

    docs = [(i, "\n".join(vary(rng.choice(lines)) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    docs += [(None, lines[0]), (50, None), (51, ""), (52, "---\n***\n---"), (53, lines[1] + "\n" + lines[1]), (53, lines[1] + "\n" + lines[1]), (53, "other"), (54, "Subscribe to our newsletter"), (55, "subcribe to our newsletter!")]
    want = brute_lines(spark, docs)
    assert removed(spark, docs) == want and 55 in {d for d, _, _ in want}


@pytest.mark.parametrize("tile", [4, 512])
def test_a_large_group_of_near_lines(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(12)
    base = [f"base{i}" for i in range(50)]
    docs = [(i, " ".join(w if rng.random() > 0.08 else f"new{rng.randrange(10**6)}" for w in base)) for i in range(70)] + [(500 + i, " ".join(base)) for i in range(3)]
    assert removed(spark, docs) == brute_lines(spark, docs)


def test_pairs_are_verified_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SLICE", 1)
    rng = random.Random(13)
    base = [f"base{i}" for i in range(50)]
    docs = [(i, " ".join(w if rng.random() > 0.2 else f"new{rng.randrange(10**6)}" for w in base)) for i in range(60)]
    assert removed(spark, docs) == brute_lines(spark, docs)


def test_letter_counts_reject_no_pair_that_links(spark):
    rng = random.Random(14)
    texts = ["", "a", "ab", "z" * 3000, "z" * 2400, "日本 é1" * 50]
    for _ in range(300):
        x = [rng.choice("abcdefgh xyz日é1") for _ in range(rng.randrange(1, 60))]
        texts.append("".join(x))
        for _ in range(rng.randrange(len(x) // 3 + 1)):
            x[(at := rng.randrange(len(x))) : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
            x = x or ["b"]
        texts.append("".join(x))
    forms = spark.createDataFrame(list(enumerate(texts)), "i int, _norm string").select("i", "_norm", *line_dedup.counted("_norm"))
    other = forms.toDF(*[f"{c}_a" for c in forms.columns])
    met = forms.join(other, F.col("i_a") < F.col("i")).select("_norm", "_norm_a", line_dedup.may_be_alike().alias("ok")).collect()
    assert all(r.ok for r in met if close(r._norm, r._norm_a, line_dedup.edits)) and sum(r.ok for r in met) < len(met) / 2


def test_dissimilar_lines_of_one_list_are_not_all_verified(spark, monkeypatch):
    """Lines that share a passage and have other letters else: none is compared in characters, and the same lines go."""
    rng, asked = random.Random(15), []
    shared = [f"base{i}" for i in range(30)]
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    docs = [(i, " ".join(shared + [word("abcdefghijklmnopqrstuvwxyz"[i % 13 * 2 :][:2]) for _ in range(24)])) for i in range(60)]
    similar = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda pairs: asked.append(pairs.count()) or similar(pairs))
    assert removed(spark, docs) == brute_lines(spark, docs)
    assert sum(asked) < 60 * 59 / 2 / 3, asked


def test_nothing_of_a_run_stays_but_what_is_returned(spark, monkeypatch):
    rows = [(i, f"a line of many plain words that stands in all {'documents' if i % 2 else 'of them'}\nown words of number {i * 7919}") for i in range(20)]
    docs, made = spark.createDataFrame(rows, DOCS), []
    tables = lambda s: [x for x in os.listdir(s.path.removeprefix("file:")) if not x.startswith(".")]
    for module in (line_dedup, jaccard):
        monkeypatch.setattr(module, "Scratch", lambda *a: made.append(Scratch(*a)) or made[-1])
    gone = line_dedup.removals(docs)
    assert [len(tables(s)) for s in made] == [1] and gone.count() == 19
    made.clear()
    kept = jaccard.keep_one(docs)
    assert sorted(len(tables(s)) for s in made)[0] == 0 and kept.count() == 2


def test_keys_are_dealt_in_parts(spark, monkeypatch):
    rng = random.Random(16)
    base = [f"base{i}" for i in range(40)]
    docs = [(i, " ".join(w if rng.random() > 0.1 else f"new{rng.randrange(10**6)}" for w in base)) for i in range(40)]
    want = brute_lines(spark, docs)
    monkeypatch.setattr(line_dedup, "LINES", 4)
    assert removed(spark, docs) == want and len(want) > 10


def test_lines_that_differ_in_one_passage_link():
    """At any length, wherever the passage lies: a key that both have does not depend on luck."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    for n in [*range(10, 40), 60, 100, 300]:
        for _ in range(20):
            w = [word() for _ in range(n)]
            k, a = rng.randrange(1, n // 5 + 1), rng.randrange(n)
            other = w[:a] + [word() for _ in range(k)] + w[min(n, a + k) :]
            one, two = ({*line_dedup.describe(" ".join(x))[4][3].tolist()} for x in (w, other))
            assert one & two, (n, k, a)


def test_tiny_lines_are_compared_exactly(spark):
    rng = random.Random(6)
    lines = {"la ra", "la ja", "eding in", "eding enin", "Click here", "Clik here!"}
    for _ in range(80):
        x = [rng.choice("abcdeé 1") for _ in range(rng.randrange(3, 13))]
        for _ in range(4):
            lines.add("".join(x).strip())
            x[(at := rng.randrange(len(x))) : at + rng.randrange(2)] = rng.choice(["", "a", "é"])
    lines = sorted(x for x in lines if len(norm(x)) <= 14)
    docs = [(i, x) for i, x in enumerate(lines)]
    forms = {x: norm(x) for x in lines}
    up = {f: f for f in forms.values()}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in up:
        for b in up:
            if a and b and close(a, b):
                up[find(a)] = find(b)
    first = {}
    for i, x in docs:
        first.setdefault(find(forms[x]), i)
    assert {d for d, _, _ in removed(spark, docs)} == {i for i, x in docs if forms[x] and first[find(forms[x])] != i}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_links_against_edit_similarity_alone(spark):
    """Recall of line pairs by edit similarity over all pairs, without any SimHash; and nothing goes that is not like a line that stays."""
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in frame.collect()]
    places = {}
    for d, t in docs:
        for i, line in enumerate([] if t is None else t.split("\n")):
            if norm(line):
                places.setdefault(norm(line), set()).add((d, spark_hash(spark, t), i))
    forms = sorted(places, key=len)
    letters = {c: i for i, c in enumerate(sorted({c for f in forms for c in f}))}
    assert len(letters) < 200
    size = np.array([len(f) for f in forms])
    bags = np.zeros((len(forms), len(letters)), np.int32)
    for i, f in enumerate(forms):
        np.add.at(bags[i], [letters[c] for c in f], 1)
    pairs = []
    for i in range(len(forms)):
        js = np.arange(i + 1, np.searchsorted(size, int(size[i] / 0.8 + 1e-9), side="right"))
        js = js[np.abs(bags[js] - bags[i]).sum(1) <= 2 * np.floor(size[js] * 0.2 + 1e-9)]
        pairs += [(i, int(j)) for j in js]
    true = [(forms[a], forms[b]) for a, b in pairs if line_dedup.edits(forms[a], forms[b]) <= int(len(forms[b]) * 0.2 + 1e-9)]
    gone = {(r._doc, r._text, i) for r in line_dedup.removals(frame).collect() for i in r._gone}
    stays = {f for f in forms if places[f] - gone}
    found = sum(not (a in stays and b in stays) for a, b in true)
    assert len(true) >= 20 and found / len(true) >= 0.9, (found, len(true))
    up = {f: f for f in forms}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in true:
        up[find(a)] = find(b)
    kept = {find(f) for f in stays}
    assert all(find(f) in kept for f in forms)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcé日 ", max_size=40), st.text(alphabet="abcé日 ", max_size=40))
def test_edits_and_likeness(x, y):
    assert line_dedup.edits(x, y) == edit(x, y) and line_dedup.alike(x, y) == close(x, y)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBçÉ9 -.\u0301日本", max_size=12), min_size=2, max_size=6))
def test_ids_are_those_of_the_normal_forms(lines):
    count, some, one, two, *_ = line_dedup.describe("\n".join(lines))
    loose = [norm(x).replace(" ", "") if any(c in "日本" for c in x) else norm(x) for x in lines]
    assert count == len(lines) and some.tolist() == [i for i, x in enumerate(lines) if norm(x)]
    for i, a in enumerate(some.tolist()):
        for j, b in enumerate(some.tolist()):
            if norm(lines[a]) == norm(lines[b]):
                assert one[i] == one[j] and two[i] == two[j]
            elif loose[a].replace(" ", "") != loose[b].replace(" ", ""):
                assert one[i] != one[j]


def test_long_lines_are_cut_between_words(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(3000)) + "\n" + "字" * 900 + "\n" + "x" * 2000
    whole = line_dedup.describe(text)
    monkeypatch.setattr(line_dedup, "PART", 64)
    again = line_dedup.describe(text)
    for a, b in zip([*whole[1:4], *whole[4], *whole[5]], [*again[1:4], *again[4], *again[5]], strict=True):
        assert np.array_equal(a, b)


def test_votes_are_the_majority_whatever_the_counters():
    rng = np.random.default_rng(1)
    n = np.array([1, 2, 3, 509, 510, 511, 512, 4000])
    h = rng.integers(0, 2**64, n.sum(), np.uint64)
    at = np.cumsum(n) - n
    got = line_dedup.votes(h, at, n).tolist()
    for g, a, k in zip(got, at.tolist(), n.tolist(), strict=True):
        some = h[a : a + k].tolist()
        assert g == sum((sum((x >> b) & 1 for x in some) > k // 2) << b for b in range(63))


def test_documents_keep_one_copy_and_their_columns(spark):
    rows = [(2, "Shared line here, of words\nown two", "b"), (1, "own one\nshared LINE here of words!", "a"), (3, "shared line here of words", "c"), (4, None, "d"), (5, "", "e")]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, key string"))
    assert out.columns == ["doc_id", "text", "key"]
    assert sorted((r.doc_id, r.text, r.key) for r in out.collect()) == [(1, "own one\nshared LINE here of words!", "a"), (2, "own two", "b"), (4, None, "d"), (5, "", "e")]
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).collect() == []


def test_copies_with_blank_lines_go(spark):
    text = "First paragraph of the text\n\nand the second one\n---"
    rows = [(1, text), (2, text), (3, text + "\nÄ"), (4, "\n---\n"), (5, "")]
    out = line_dedup.dedup(spark.createDataFrame(rows, DOCS))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, text), (3, "\n---\nÄ"), (4, "\n---\n"), (5, "")]


def test_lines_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "one line of many words here\nown text of the first", 7, "a", None), (2, "one line of many words here", 7, "b", None), (2, "one line of many words here", 7, "b", None), (None, None, None, None, None), (3, "", 1, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _lines string, n_lines int")
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text), r._gone, r._lines, r.n_lines) for r in out.collect()) == [("1", rows[0][1], 7, "a", None), ("3", "", 1, None, 2), ("None", "None", None, None, None)]
    told = line_dedup.drop_lines(docs)
    assert told.columns == ["doc_id", "text", "_gone", "_lines", "n_lines", "n_removed"] and sorted((r.n_lines, r.n_removed) for r in told.collect()) == [(0, 0), (1, 0), (1, 1), (1, 1), (2, 0)]
    assert line_dedup.dedup(docs.limit(0)).collect() == []


# classifiers


def learnt(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def good_and_bad(n, seed):
    rng = random.Random(seed)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120)))
    bad = lambda: rng.choice([good().upper().replace(" ", "!! "), good().replace(" ", " | "), ("spam " * 60).strip()])
    return [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(n)]


def test_quality_is_learnt_and_held_out_rows_are_right(spark):
    rows = good_and_bad(600, 1)
    docs, labels = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (None, "x")], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (9001, None)], "doc_id long, quality int")
    out = quality.scored(docs, quality.fit(docs, labels)).collect()
    score = {r.doc_id: r.score for r in out}
    right = [(score[i] >= 0.3) == bool(y) for i, _, y in rows if not learnt(i)]
    assert len(out) == 603 and sum(right) / len(right) >= 0.97 and all(0 <= s <= 1 for s in score.values())
    assert quality.scored(docs, quality.fit(docs, labels.limit(0))).where("score <> 0.5").isEmpty()
    one = quality.scored(docs, quality.fit(docs, labels.where("quality = 1"))).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.9
    kept = quality.keep_good(docs, docs, labels)
    assert kept.columns == docs.columns and kept.count() < 603


def test_statistics_and_clashing_names(spark):
    texts = ["Ab c1! é\nx  y x", "", None, "日本 Ω9,.;:", "a" * 30000 + " B" * 9]
    rows = [(i, t, 0.1, "k", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digit double, score string, _upper int")
    got = docs.select("doc_id", *[c.alias(k) for k, c in quality.statistics("text").items()]).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        t = t or ""
        n, words, lines = len(t), re.split(r"\s+", t), t.split("\n")
        share = lambda ok: sum(map(ok, t)) / max(n, 1)  # noqa: B023,E731
        want = {"log_chars": np.log1p(n), "upper": share(str.isupper), "digit": share(lambda c: c in "0123456789"), "space": share(str.isspace), "points": share(lambda c: c in ".,;:"), "marks": share(lambda c: c in quality.MARKS.replace("\\\\", "\\").replace("\\[\\]", "[]")), "other": share(lambda c: not (c.isalnum() or c.isspace())), "word_chars": n / len(words), "new_words": len(set(words)) / len(words), "new_lines": len(set(lines)) / len(lines), "line_chars": np.log1p(n / len(lines))}
        assert {k: r[k] for k in want} == pytest.approx(want), t[:20]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    out = quality.scored(docs, quality.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "digit", "_upper", "score"] and out.count() == 5
    kept = quality.keep_good(docs, docs, labels, 0.0)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(docs.collect())
    assert quality.keep_good(docs.limit(0), docs, labels).collect() == []


def test_rules_mean_the_same_compiled(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.3)).astype(float)
    rules = quality.extract_rules(x, y)
    base, w = quality.lasso(np.stack([quality.holds(r, x) for r in rules], 1), y)
    assert 0 < (w != 0).sum() < len(w)
    z = base + sum(wi * quality.holds(r, x) for r, wi in zip(rules, w, strict=True))
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    column = quality.compile_rules(base, [(r, float(wi)) for r, wi in zip(rules, w, strict=True) if wi], ["a", "b", "c"])
    got = [r.s for r in frame.select("i", column.alias("s")).orderBy("i").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-z))).tolist()) and (((np.array(got) > 0.5) == y).mean()) > 0.97


def plain_toxicity(text, model):
    """The score from the model's dictionaries and weights, by itself."""
    data, x = text.lower().encode(), []
    for size in (64, 32):
        words, windows = data.split(b" "), []
        while words:
            w = words.pop(0)
            while words and len(w) < size:
                w += b" " + words.pop(0)
            windows.append(w)
        if windows and not windows[-1]:
            windows.pop()  # nothing stands behind the last space
        how = zstandard.ZstdCompressionParameters.from_level(6, source_size=size, dict_size=len(model["toxic"] + model["ordinary"]), write_content_size=False, write_checksum=False, write_dict_id=False)
        one, two = (zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in (model["ordinary"], model["toxic"] + model["ordinary"]))
        d = sorted([len(one.compress(w)) - len(two.compress(w)) for w in windows] or [0], reverse=True)
        large = [sum(v >= t for v in d) for t in (2, 4, 6)]
        x += [sum(d) / len(d), d[0], sum(d[:3]) / min(3, len(d)), np.log(len(d)), *(n / len(d) for n in large), np.log1p(large[1]), np.log1p(large[2])]
    z = model["weights"][0] + sum(w * v / s for w, v, s in zip(model["weights"][1:], x, model["scale"], strict=True))
    return 1 / (1 + np.exp(-z))


def test_toxicity_is_learnt_and_held_out_rows_are_right(spark):
    rng = random.Random(3)
    syllables = ["an", "the", "er", "on", "ti", "re", "ing", "ed", "st", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    insults = ["grobnik", "vexlump", "zorkface", "mudwad"]
    rows = []
    for i in range(700):
        w = [word() for _ in range(rng.randrange(40, 200))]
        if i % 5 == 0:
            for _ in range(1 + len(w) // 25):
                w[rng.randrange(len(w))] = rng.choice(insults)
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    docs, labels = spark.createDataFrame([r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, "the er " * 90_000)], DOCS), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert b"grobnik" in model["toxic"] and b"grobnik" not in model["ordinary"]
    clash = docs.withColumns({"score": F.lit("s"), "t": F.lit(1), "y": F.lit(2)})
    score = {r.doc_id: r.score for r in toxicity.scored(clash, model).collect()}
    for i in (0, 1, 2, 4, 5, 10, 9001):
        assert score[i] == pytest.approx(plain_toxicity(dict(r[:2] for r in rows).get(i, ""), model))
    assert toxicity.scored(clash, model).columns == ["doc_id", "text", "t", "y", "score"]
    right = [(score[i] >= 0.5) == bool(y) for i, _, y in rows if not learnt(i)]
    assert len(score) == 703 and sum(right) / len(right) >= 0.95 and all(0 <= s <= 1 for s in score.values())
    flat = toxicity.scored(docs, toxicity.fit(docs, labels.where("toxic = 0"))).select("score").distinct().collect()
    assert len(flat) == 1 and flat[0].score < 0.1
    assert toxicity.scored(docs.limit(0), toxicity.fit(docs, labels.limit(0))).collect() == []
