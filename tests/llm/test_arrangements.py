"""Fill-in-the-middle, SimHash and whitening against brute force on awkward rows and on the small tables."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orbweave.llm import fim, queries, simhash, whitening
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle -----------------------------------------------------------------------------------------------


def plainly(doc_id, text):
    """Slices instead of ropes."""
    said = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(said[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs, awkward, none):
    found = fim.restored(fim.fill_in_middle(docs)).collect()
    expected = [(i, *plainly(i, t or ""), t or "") for i, t, *_ in awkward]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.restored(fim.fill_in_middle(none)).count() == 0


def test_all_documents_come_back(spark):
    docs = queries.table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op11_fim(spark, SF).collect():
        n, form, a, b, out = plainly(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, a, b, sha(out), sha(texts[r.doc_id]))


def test_texts_with_sentinels_stay(spark):
    rows = [(i, t) for i in range(40) for t in ("a<P>b", "<M>", "x <S", "S>", "<<P", "퟿<S>\U0001f600")]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), plain_percent=0)
    back = fim.restored(made).collect()
    assert all((r.form == "plain") == any(s in r.restored for s in fim.SENTINELS) for r in back)
    assert sorted((r.doc_id, r.restored) for r in back) == sorted(rows)
    assert fim.inverted("no sentinel", "psm") is None and fim.inverted(None, "plain") is None and fim.inverted("x", None) is None
    assert fim.inverted("x<P>a<S>b<M>c", "psm") is None


def test_restored_keeps_columns(spark):
    rows = spark.createDataFrame([(1, "<P>a<S>c<M>b", "psm", "old"), (2, None, "spm", "old")], "restored long, output string, form string, n string")
    assert [tuple(r) for r in fim.restored(rows).collect()] == [("<P>a<S>c<M>b", "psm", "old", "abc"), (None, "spm", "old", None)]


def test_sentinels_are_checked():
    for wrong in (("a", "a", "b"), ("", "a", "b"), ("ab", "b", "c"), ("ab", "bc", "d"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            fim.checked(wrong)
    assert fim.checked(("<|pre|>", "<|suf|>", "<|mid|>"))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n\U0001f600é", max_size=60), st.integers(0, 70), st.integers(1, 9), st.sampled_from([None, r"\S+\s*", r"\n"]))
def test_ropes(text, rank, size, unit):
    rope = fim.rope_of(text, unit, size)
    assert fim.text_of(rope) == text and rope.chars == len(text)
    ends = list(range(1, len(text) + 1)) if unit is None else fim.unit_ends(text, unit)
    assert rope.units == len(ends)
    left, right = fim.split(rope, rank)
    at = 0 if rank == 0 else ends[min(rank, len(ends)) - 1] if ends else 0
    assert (fim.text_of(left), fim.text_of(right)) == (text[:at], text[at:])
    assert left.units + right.units == rope.units and left.chars + right.chars == rope.chars
    left, right = fim.split(rope, rank, "chars")
    assert (fim.text_of(left), fim.text_of(right)) == (text[:rank], text[rank:])
    assert left.units >= sum(e <= rank for e in ends) and fim.split(fim.concat(left, right), rank, "chars")[1].chars == right.chars


def test_ropes_are_shallow():
    depth = lambda r: 0 if isinstance(r, fim.Leaf) else 1 + max(depth(r.left), depth(r.right))
    rope = fim.rope_of("x" * 1_000_000, size=100)
    assert depth(rope) <= 15
    left, right = fim.split(rope, 333_333)
    assert depth(fim.concat(right, left)) <= 17


def test_units_are_words(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(30)], "doc_id long, text string")
    made = fim.restored(fim.fill_in_middle(docs, unit=r"\S+\s*", plain_percent=0)).collect()
    assert all(r.n == 50 for r in made)
    texts = dict(docs.collect())
    for r in made:
        assert r.restored == texts[r.doc_id]
        at = r.prefix_chars
        assert at in (0, len(texts[r.doc_id])) or texts[r.doc_id][at - 1].isspace()


# ---- simhash ----------------------------------------------------------------------------------------------------------


def fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    """(id, fingerprint) to the smallest id reachable."""
    ids = sorted({i for i, _ in prints})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, f in prints:
        for j, g in prints:
            if i < j and (f ^ g).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def test_fingerprints(docs, awkward, none):
    found = simhash.linked_documents(docs).collect()
    expected = [(i, fingerprint(t)) for i, t, *_ in awkward]
    whole = classes([x for x in expected if x[0] is not None])
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in found) == sorted((str(i), f, whole.get(i)) for i, f in expected)
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[2] == 1 and by_id[7] == by_id[8] == 6 and by_id[None] is None
    assert simhash.linked_documents(none).count() == 0


def test_simhash_of_documents(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    prints = [(i, fingerprint(t)) for i, t in texts.items()]
    whole = classes(prints)
    assert sorted(map(tuple, queries.op12_simhash(spark, SF).collect())) == sorted((i, f"{f:016x}", whole[i]) for i, f in prints)
    assert any(i != c for i, c in whole.items())


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    import pyarrow as pa

    texts = [prose(1, 500), "", "a b", None, "AÉ  b\tc\nd e", prose(2, 300)]
    monkeypatch.setattr(simhash, "SHINGLES", 37)
    column = pa.array([t or "" for t in texts])
    assert simhash.simhashes(column, 4, 42).tolist() == [fingerprint(t) for t in texts]


def drawn_prints(seed, n, centres, flips):
    """Fingerprints around a few centres, and others anywhere."""
    r = random.Random(seed)
    middle = [r.getrandbits(64) for _ in range(centres)]
    out = set()
    while len(out) < n:
        f = r.choice(middle) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, flips)):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize(("seed", "centres", "flips", "bucket", "blocks"), [(1, 3, 3, 4096, 6), (2, 1, 4, 8, 6), (3, 2, 12, 16, 6), (4, 4, 8, 5, 5), (5, 1, 16, 30, 7)])
def test_links_of_hot_buckets(spark, seed, centres, flips, bucket, blocks):
    """Buckets over the bound: heads, components and chunks of outsiders give the classes of all pairs."""
    prints = drawn_prints(seed, 300, centres, flips)
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    rows = spark.createDataFrame([(f, 1 + i % 3) for i, f in enumerate(signed)], "fp long, docs long")
    links = [(signed.index(a), signed.index(b)) for a, b in simhash.print_links(rows, blocks, 4, bucket).collect()]
    assert all(a != b for a, b in links)
    up = list(range(len(prints)))
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    for i in range(len(up)):
        while up[i] != up[up[i]]:
            up[i] = up[up[i]]
    assert up == [v for _, v in sorted(classes(list(enumerate(prints))).items())]


def test_rows_link_by_fingerprints_alone(spark):
    """A row without an id joins others and takes their smallest id; rows of one id with far texts stay apart."""
    far, other = prose(31, 40), prose(32, 40)
    rows = [(None, far), (7, far), (3, other), (7, other), (None, ""), (9, None), (None, prose(33, 40)), (7, prose(34, 40))]
    found = simhash.linked_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = [(None, far, 7), (7, far, 7), (3, other, 3), (7, other, 3), (None, "", 9), (9, None, 9), (None, prose(33, 40), None), (7, prose(34, 40), 7)]
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found) == sorted((str(i), fingerprint(t), str(c)) for i, t, c in expected)


def test_skewed_joins_leave_buckets_whole(spark):
    """A bucket whose rows a skewed join splits over tasks is verified as one."""
    r = random.Random(3)
    fixed, prints = r.getrandbits(22), set()
    while len(prints) < 2500:  # walks in the bits that one bucket leaves open
        f = fixed | r.getrandbits(42) << 22
        for _ in range(10):
            prints.add(f)
            for b in r.sample(range(22, 64), 4):
                f ^= 1 << b
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    split = {"autoBroadcastJoinThreshold": "-1", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "4k"}
    split |= {"adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "adaptive.skewJoin.skewedPartitionFactor": "1.2", "shuffle.partitions": "8"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(f"spark.sql.{k}", v)
        rows = spark.createDataFrame([(f, 1) for f in signed], "fp long, docs long").repartition(24)
        links = {(row.a, row.b) for row in simhash.print_links(rows).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)
    f = np.array(signed).view(np.uint64)
    at = {v: i for i, v in enumerate(signed)}
    pairs = [(i, j) for i in range(len(f)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4)).tolist()]
    got, want = np.arange(len(f)), np.arange(len(f))
    for root, found in ((got, [(at[a], at[b]) for a, b in links]), (want, pairs)):
        simhash.merge(root, *np.array(found).T)
    assert len(pairs) > 2000 and np.array_equal(got, want)


def test_masks():
    every = simhash.masks(6, 4)
    assert len(every) == 15 and all(m.bit_count() >= 20 for m in every)
    r = random.Random(0)
    for _ in range(300):
        f = r.getrandbits(64)
        g = f
        for b in r.sample(range(64), 4):
            g ^= 1 << b
        hit = [m for m in every if f & m == g & m]
        assert hit and any(f & n == g & n for n in simhash.finer_masks(hit[0], 6, 4))
    with pytest.raises(ValueError):
        simhash.masks(4, 4)


# ---- whitening ---------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, k=4):
    """(id, x) of the rows kept, and n, S, eigenvalues, components, trace by numpy alone."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    centred = fit - fit.mean(0)
    cov = centred.T @ centred / len(fit)
    w, v = np.linalg.eigh(cov)
    return kept, len(fit), [int(s) for s in fit.sum(0)], w[::-1][:k], v.T[::-1][:k], cov.trace()


def vectors_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(0))


def compare(found, vectors):
    kept, n, sums, values, parts, trace = plain_whitening(vectors)
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert len(found) == len(kept) * len(values)
    signs = None
    for i, x in kept:
        d = n * np.array(x, object) - np.array(sums, object)
        y = (np.array(x) - np.array(sums) / n) @ parts.T / np.sqrt(values)
        rows = [by[i][c + 1][0] for c in range(len(values))]
        assert all(r.n == n and r.deviation == sum(int(v) ** 2 for v in d) for r in rows)
        got = np.array([r.whitened for r in rows])
        if signs is None:
            signs = np.where(got * y < 0, -1, 1)
        assert np.allclose(got, y * signs, atol=1e-9)
        assert np.allclose([r.explained for r in rows], values / trace, rtol=1e-9) and all(r.identity_error < 1e-9 for r in rows)


def test_whitening(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(6) * [3, 1, 2, 0.5, 1, 0.1]).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies count once
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [-0.0] * 6)]
    found = whitening.whitened(vectors_table(spark, rows).repartition(5)).collect()
    compare(found, rows)
    assert not {2000, 2001, 2002, 2003} & {r.vec_id for r in found}


def test_whitening_of_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, SF, "embeddings").collect()]
    compare(queries.op13_whitening(spark, SF).collect(), rows)


def test_whitening_of_little(spark):
    table = lambda rows: whitening.whitened(vectors_table(spark, rows))
    assert table([]).count() == 0 and table([(1, None), (2, [None])]).count() == 0 and table([(1, []), (2, [])]).count() == 0
    one = table([(None, [1.0, 2.0]), (3, [1.0, 2.0])]).collect()
    assert sorted((str(r.vec_id), r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [(v, c, 1, 0, None, None, None) for v in ("3", "None") for c in (1, 2)]
    line = table([(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (3, [3.0, 0.0, 1.0])]).collect()
    assert [r.whitened is None for r in sorted(line)] == [False, True, True] * 3 and all(r.identity_error < 1e-9 for r in line)
    with pytest.raises(ValueError):
        table([(1, [1.0]), (2, [1.0, 2.0])]).count()


def test_whitening_of_great_numbers(spark):
    found = whitening.whitened(vectors_table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.5]), (3, [0.25, 2.0])])).collect()
    assert len(found) == 6 and any(r.deviation is None for r in found)
    x = np.array([[1 << 40, -5], [3, 1 << 41]], np.int64)
    sums = whitening.exact_sums(x)
    assert sums == [(1 << 40) + 3, (1 << 41) - 5]
    assert whitening.deviations(x, 2, sums) == [None, None]
    assert whitening.deviations(x >> 20, 2, whitening.exact_sums(x >> 20))[0] == (1 << 20) ** 2 + (-1 * 2 - ((1 << 21) - 1)) ** 2
