"""Sharding, fixity, components, nearest neighbours and pseudonyms against plain Python."""

import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import ann, pii, sharding, warc
from tidemark.llm._shared import Scratch
from tidemark.llm.components import components

DOCS = "doc_id long, text string"


# sharding


def rows_of(frame):
    return [(r.a, r.row_number, r.position, r.shard, r.slot) for r in frame.collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 39, 40, 41, 1000])
def test_positions_are_a_permutation_and_shards_are_even(spark, n):
    rows = rows_of(sharding.shard(spark.range(n).withColumnRenamed("id", "a"), 7))
    assert sorted(r[1] for r in rows) == sorted(r[2] for r in rows) == list(range(n))
    assert all(p % 7 == s and p // 7 == k for _, _, p, s, k in rows)
    if n >= 1000:
        assert [r[2] for r in sorted(rows, key=lambda r: r[1])] != list(range(n))


def test_shards_do_not_depend_on_how_rows_lie(spark):
    one = spark.range(500).withColumnRenamed("id", "a")
    other = spark.createDataFrame([(i,) for i in random.Random(1).sample(range(500), 500)], "a long").repartition(7)
    assert sorted(rows_of(sharding.shard(one, 5))) == sorted(rows_of(sharding.shard(other, 5)))
    assert sorted(rows_of(sharding.shard(one, 5, seed=2))) != sorted(rows_of(sharding.shard(one, 5)))


def test_a_hot_row_is_numbered_copy_by_copy(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 10)
    rows = [(1,)] * 95 + [(None,)] * 23 + [(i,) for i in range(2, 50)]
    got = rows_of(sharding.shard(spark.createDataFrame(rows, "a long"), 4))
    assert sorted(r[2] for r in got) == list(range(len(rows))) and sum(r[0] == 1 for r in got) == 95
    with pytest.raises(ValueError):
        sharding.shard(spark.createDataFrame([(1, 2)], "a long, shard long"), 4)


def test_sharding_query(spark, tmp_path):
    docs = [(1, "héllo"), (1, "héllo"), (None, None), (3, ""), (4, "x" * 5000)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op2(spark, str(tmp_path)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in docs)
    assert {r.law for r in got} == {"rows"} and sorted(r.position for r in got) == list(range(5))


# fixity


def audited(spark, one, other):
    make = lambda rows: warc.layout(spark.createDataFrame([(hashlib.sha256(b.encode()).hexdigest(), len(b), i) for i, b in rows], "digest string, length long, page_id long"))
    left = make(one).persist()
    worn = {i: hashlib.sha256(b.encode()).hexdigest() for i, b in other}
    right = left.withColumn("digest", F.coalesce(*[F.when(F.col("page_id") == i, F.lit(d)) for i, d in worn.items()], F.col("digest"))) if worn else left
    return sorted((r.page_id, r.status) for r in warc.audit(left, right).collect())


def test_an_audit_finds_exactly_the_damaged_records(spark):
    records = [(i, f"record {i}") for i in range(300)]
    assert audited(spark, records, []) == []
    assert audited(spark, records, [(7, "x"), (250, "y")]) == [(7, "changed"), (250, "changed")]


def test_an_audit_finds_missing_and_extra_records(spark):
    whole = warc.layout(spark.createDataFrame([(hashlib.sha256(f"{i}".encode()).hexdigest(), 5, i) for i in range(40)], "digest string, length long, page_id long")).persist()
    part = whole.where("record_no < 39")
    assert [r.status for r in warc.audit(whole, part).collect()] == ["missing"]
    assert [r.status for r in warc.audit(part, whole).collect()] == ["extra"]
    assert warc.audit(whole.limit(0), whole.limit(0)).collect() == []


def test_a_worn_replica_has_its_own_offsets(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 16)
    rows = [(i, f"u{i}", "<p>é" + "x" * (i % 9)) for i in range(300)] + [(None, None, None), (300, "", ""), (262, "again", "<q>")]
    sound, worn = warc.replicas(spark.createDataFrame(rows, "page_id long, url string, html string"))
    found = {(r.page_id, r.url): r for r in warc.audit(sound, worn).collect()}
    hit = {(p, u): p % 251 for p, u, _ in rows if p is not None and p % 251 in (7, 11, 13, 17)}
    assert {k: (r.status, r.found_length >= 0 and r.length - r.found_length) for k, r in found.items()} == {k: {7: ("changed", 0), 11: ("changed", 1), 13: ("missing", False), 17: ("extra", 0)}[m] for k, m in hit.items()}
    at = {}
    for r in sorted(worn.collect(), key=lambda r: r.record_no):
        assert r.archive == r.record_no // 16 and r.offset == at.get(r.archive, 0)
        at[r.archive] = r.offset + r.length
        if (r.page_id, r.url) in found and found[r.page_id, r.url].status == "changed":
            assert found[r.page_id, r.url].found_offset == r.offset
    assert min(r.record_no for r in found.values() if r.status == "extra") == len(rows)


def test_archives_and_offsets(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 16)
    rows = warc.layout(spark.createDataFrame([(f"{i:03x}" + "0" * 61, 10 + i % 3, i) for i in range(50)], "digest string, length long, page_id long")).collect()
    at = {}
    for r in sorted(rows, key=lambda r: r.record_no):
        assert r.archive == r.record_no // 16 and r.offset == at.get(r.archive, 0)
        at[r.archive] = r.offset + r.length


# components


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    for n, m in ((30, 10), (60, 60), (200, 150)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(1000, 1040)]
        up = {x: x for e in edges for x in e}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
        got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"))
        assert {(r.node, r.root) for r in got.collect()} == {(x, find(x)) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect() == []


# nearest neighbours


def nearest(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.neighbours(frame, F.col("id") % 10 == 0, **more).collect()
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}


def exact(rows, k=10):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, q in ok:
        if i % 10 == 0:
            for rank, (d, j) in enumerate(sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k], 1):
                out[i, rank] = (j, d)
    return out


def vectors(n, d, seed=0):
    return [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, d)))]


def test_small_tables_are_searched_wholly(spark):
    rows = vectors(60, 8)
    rows += [(100, rows[3][1], 0), (110, rows[3][1], 0), (120, [0.0] * 8, 0), (130, None, 0), (140, [float("nan")] + [1.0] * 7, 0), (150, [None] + [1.0] * 7, 0), (160, [float("inf")] + [1.0] * 7, 0), (None, [1.0] * 8, 0)]
    assert nearest(spark, rows) == exact(rows)
    assert nearest(spark, rows[:4]) == exact(rows[:4])
    assert nearest(spark, []) == {}


def test_hot_copies_and_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(200)] + [(1000 + i, [0.0, 1.0 + i], 0) for i in range(5)]
    assert nearest(spark, rows) == exact(rows)


@pytest.mark.parametrize("kind", ["plain", "clustered"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    if kind == "clustered":
        x = x * 0.3 + rng.normal(size=(20, 64))[rng.integers(0, 20, 6000)]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = ann.neighbours(frame, F.col("id") % 100 == 0).collect()
    y = x.astype(float)
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 600 and hits / 600 >= 0.9
    assert all(r.score == np.sqrt(((y[r.vec_id] - y[r.query_id]) ** 2).sum()) for r in got)


def test_leaves_visited_follow_the_data():
    rng = np.random.default_rng(5)
    n = 20_000
    x = rng.normal(size=(n // 100, 64))[rng.integers(0, n // 100, n)] + 0.25 * rng.normal(size=(n, 64))
    forest = ann.Forest(x[:8000], n, 64)
    forest.calibrate(10)
    leaves, hits, seen = forest.leaves(x), 0, 0
    for q, most in zip(x[:40], forest.bounds(x[:40], 10), strict=True):
        some = np.zeros(n, bool)
        for t, leaf in forest.search(q, most):
            some |= leaves[t] == leaf
        hits += some[np.argsort(((x - q) ** 2).sum(1))[:10]].sum()
        seen += some.sum()
    assert hits >= 0.9 * 400 and seen <= 0.05 * 40 * n
    far = forest.beyond(x[0], leaves[:, :50])
    assert (far.min(0)[0], bool((far >= 0).all())) == (0.0, True)  # a point lies in its own leaves


# pseudonyms


def luhn(d):
    t = 0
    for k, c in enumerate(reversed([int(x) for x in d])):
        c = c * 2 - (9 if c > 4 else 0) if k % 2 else c
        t += c
    return t % 10 == 0


def card(rng):
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return next(head + c for c in "0123456789" if luhn(head + c))


def said(spark, texts, key="k"):
    rows = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {r.doc_id: (r.text, [(x.kind, x.said) for x in r._found]) for r in pii.pseudonymise(rows, key).collect()}


def plain_network(codes, sizes, key, kind):
    n = len(codes) // 2
    a, b, p, q = codes[:n], codes[n:], sizes[:n], sizes[n:]
    for r in range(8):
        said = ",".join(map(str, b))
        f = "".join(hashlib.sha256(f"{key}|{kind}|{r}{mark}|{said}".encode()).hexdigest() for mark in ("", "+"))
        a, b, p, q = b, [(x + int(f[4 * (i % 32) : 4 * (i % 32) + 4], 16)) % p[i] for i, x in enumerate(a)], q, p
    return a + b


def plain_permuted(value, key, kind, lo=0, hi=None):
    at = [i for i, c in enumerate(value) if lo <= i < (len(value) if hi is None else hi) and c.isascii() and c.isalnum()]
    if not at:
        return value
    zero = lambda c: 48 if c.isdigit() else 65 if c.isupper() else 97
    new = plain_network([ord(value[i]) - zero(value[i]) for i in at], [10 if value[i].isdigit() else 26 for i in at], key, kind)
    out = list(value)
    for i, c in zip(at, new, strict=True):
        out[i] = chr(c + zero(value[i]))
    return "".join(out)


def plain_walk(value, valid, key, kind, lo=0):
    value = plain_permuted(value, key, kind, lo)
    while not valid(value):
        value = plain_permuted(value, key, kind, lo)
    return value


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def plain_pseudonym(kind, v, key):
    """The pseudonym of a found value, or None if it fails its check."""
    digits = "".join(c for c in v if c.isdigit())
    first = dt.date(1900, 1, 1)
    if kind == "email":
        return plain_permuted(v, key, kind, hi=v.index("@"))
    if kind == "iban":
        new = plain_permuted(v, key, kind, lo=4)
        return f"{new[:2]}{98 - mod97(new[:2] + '00' + new[4:]):02}{new[4:]}" if mod97(v) == 1 else None
    if kind == "ipv4":
        parts = [int(x) for x in v.split(".")]
        return ".".join(map(str, plain_network(parts, [256] * 4, key, kind))) if max(parts) <= 255 else None
    if kind == "phone":
        ok = lambda x: re.search(r"[2-9]\d\d[2-9]\d{6}$", re.sub(r"\D", "", x)) is not None
        return plain_walk(v, ok, key, kind, lo=re.search(r"[(]?\d{3}[)]?[ .-]\d{3}[ .-]\d{4}$", v).start()) if ok(v) else None
    if kind == "day":
        form = "%Y-%m-%d" if "-" in v else "%m/%d/%Y" if "/" in v else "%d.%m.%Y"
        try:
            n = (dt.datetime.strptime(v, form).date() - first).days
        except ValueError:
            return None
        new = plain_walk(f"{n:05}", lambda x: int(x) < 73049, key, kind)
        return (first + dt.timedelta(days=int(new))).strftime(form)
    if kind == "ssn":
        ok = lambda x: re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) is not None
        return plain_walk(v, ok, key, kind) if ok(v) else None
    new = plain_permuted(v, key, kind, hi=len(v) - 1)
    return next(new[:-1] + c for c in "0123456789" if luhn([*(x for x in new[:-1] if x.isdigit()), c])) if luhn(digits) else None


def test_all_values_against_plain_python(spark):
    rng = random.Random(21)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    c = card(rng)
    makers = [lambda: f"{rng.choice('abXY')}{d(2)}.q-{rng.choice('klm')}@mail{d(1)}.example.org", lambda: "DE89370400440532013000", lambda: "GB82WEST12345698765432", lambda: f"DE{d(20)}", lambda: f"{rng.randrange(300)}.{rng.randrange(256)}.0.{rng.randrange(256)}", lambda: f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(100, 1000)}-{d(4)}", lambda: f"{rng.randrange(200, 1000)}.{rng.randrange(200, 1000)}.{d(4)}", lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 32):02}", lambda: f"{rng.randrange(1, 32):02}.{rng.randrange(1, 13):02}.19{d(2)}", lambda: f"{rng.randrange(1, 13):02}/{rng.randrange(1, 32):02}/20{d(2)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: card(rng), lambda: f"{c[:4]} {c[4:8]}-{c[8:12]} {c[12:]}", lambda: d(16)]
    texts = [" ; ".join([rng.choice(makers)() for _ in range(rng.randrange(1, 5))] + [rng.choice(["", "é word", "no 5"])]) for _ in range(150)] + [None, "", "x" * 50_000 + " a@b.cd " + "9" * 3000]
    whole = re.compile("|".join(pii.FORMATS.values()))
    every = list(pii.FORMATS.items())
    want = {}
    for i, t in enumerate(texts):
        found = []

        def new(m):
            kind = next(k for k, p in every if (n := re.compile(p).match(m.string, m.start())) and n.end() == m.end())  # noqa: B023
            value = plain_pseudonym(kind, m.group(), "secret")
            found.extend([(kind, value)] if value is not None else [])  # noqa: B023
            return m.group() if value is None else value

        want[i] = (None if t is None else whole.sub(new, t), found)
    got = said(spark, texts, "secret")
    assert got == want and {k for _, f in want.values() for k, _ in f} == set(pii.FORMATS)


def test_a_key_is_needed_and_names_may_clash(spark):
    rows = spark.createDataFrame([(1, "on 2024-02-29", 3, "q", "r")], "doc_id long, text string, _values int, _parts string, _found string")
    with pytest.raises(ValueError):
        pii.pseudonymise(rows, "")
    out = pii.pseudonymise(rows, "k")
    assert out.columns == ["doc_id", "text", "_values", "_parts", "_found"] and [(r._values, r._parts, len(r._found)) for r in out.collect()] == [(3, "q", 1)]
    assert pii.pseudonymise(rows.limit(0), "k").collect() == []


def test_values_keep_their_format_and_their_checks(spark):
    rng = random.Random(9)
    cards = [card(rng) for _ in range(40)]
    got = said(spark, cards)
    new = [got[i][0] for i in range(40)]
    assert all(luhn(x) and len(x) == 16 for x in new) and len(set(new)) == 40 and not set(new) & set(cards)
    days = [f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}" for _ in range(40)]
    assert all(dt.date.fromisoformat(x[0]) for x in said(spark, days).values())
    phones = [f"+1 ({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{rng.randrange(10000):04}" for _ in range(40)]
    assert all(re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x[0]) for x in said(spark, phones).values())


def test_equal_values_stay_linked_and_keys_differ(spark):
    texts = ["a me.x@example.org b", "c me.x@example.org", "10.0.0.7 and 10.0.0.7, 10.0.0.8."]
    got = said(spark, texts)
    assert got[0][1] == got[1][1] and got[0][0].startswith("a ") and got[0][0].endswith("@example.org b") and "me.x@" not in got[0][0]
    one, two, three = (x for _, x in got[2][1])
    assert one == two != three and got[2][0] == f"{one} and {two}, {three}."
    assert said(spark, texts, key="other") != got


def test_what_fails_its_check_and_odd_texts_stay(spark):
    texts = [None, "", "4111111111111112 300.1.1.1 2023-02-29 000-12-3456 DE89370400440532013001", "no digits at all", "version 4.0. and 3.14"]
    assert {i: x for i, (x, _) in said(spark, texts).items()} == dict(enumerate(texts)) and not any(f for _, f in said(spark, texts).values())
    iban = said(spark, ["DE89370400440532013000"])[0][0]
    moved = iban[4:] + iban[:4]
    assert iban.startswith("DE") and iban[4:] != "370400440532013000" and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def test_the_network_is_a_permutation_of_small_formats(spark):
    every = [f"{i:03}" for i in range(1000)]
    rows = spark.createDataFrame([(x,) for x in every], "v string").select(F.expr(pii.permuted("v", "k", "t")).alias("p"))
    assert sorted(r.p for r in rows.collect()) == every
