import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from airloom.llm import cross_polytope as X, periodic_runs as R, piece_table as P
from airloom.llm.common import read


# Nearest neighbours

def brute_nearest(queries, rows, k):
    out = {}
    for q, x in queries.items():
        met = sorted((-float((np.array(x) * np.array(v)).sum()), i) for i, v in rows if i != q and len(v) == len(x))
        out[q] = [(i, -s) for s, i in met[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_hadamard_is_a_rotation():
    x = np.random.default_rng(1).normal(size=(5, 64))
    h = X.hadamard(x)
    assert np.allclose(X.hadamard(h), x) and np.allclose(np.linalg.norm(h, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(X.rotated(x, 0, 0) @ X.rotated(x, 0, 0).T, x @ x.T)


def test_probes_come_in_the_order_of_their_distance():
    rng = np.random.default_rng(2)
    for bits in (0, 1, 3, 8, 11):
        x = X.widened(rng.normal(size=(4, 60)), 0, None)
        parts = X.penalties(x, 1, bits, 60)
        for i in range(4):
            every = X.probes([p[i] for p in parts], 1 << bits)
            assert sorted(every.tolist()) == list(range(1 << bits))
            assert every[0] == X.codes(x, 1, bits, 60)[i]
            cost = np.zeros(1)
            for p in parts:
                cost = (cost[:, None] + (p[i] ** 2)[None, :]).ravel()
            assert np.allclose(cost[every], np.sort(cost))
            for n in (1, 5, 100):
                if n < len(every):
                    assert np.allclose(cost[X.probes([p[i] for p in parts], n)], np.sort(cost)[:n])


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(40)]                      # ties
    rows += [(200, [0.0] * 8), (201, [1e-200] * 8), (202, [1e150] + [0.0] * 7), (203, [-3.0] * 8), (204, [1.0, 2.0])]
    bad = [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[1][1]), (304, [])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows + bad], "vec_id long, embedding array<double>, node string")
    got = found(X.nearest_neighbours(df.where("vec_id % 20 = 0 or vec_id in (204, 202, 105)"), df, k=7))
    part = [(i, v) for i, v in rows if any(v)]
    want = brute_nearest({i: v for i, v in part if i % 20 == 0 or i in (204, 202, 105)}, part, 7)
    want.pop(204)  # nothing else has its length
    assert got == want
    assert X.nearest_neighbours(df.limit(0), df).count() == 0 and X.nearest_neighbours(df, df.limit(0)).count() == 0
    twice = found(X.nearest_neighbours(df.unionByName(df).where("vec_id = 20"), df.unionByName(df), k=7))
    assert twice == {20: want[20]}


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = found(X.nearest_neighbours(df, df, k=20))
    assert got == {0: [(2, 1.0), (1, 0.0)], 1: [(2, 1.0), (0, 0.0)], 2: [(0, 1.0), (1, 1.0)]}


@pytest.mark.parametrize("lengths", ["one", "many"])
def test_recall_and_heavy_buckets(spark, lengths, monkeypatch):
    """Clusters, one vector with many copies, near copies in one bucket; vectors of one length, and of many."""
    monkeypatch.setattr(X, "BUCKET_ROWS", 16)
    monkeypatch.setattr(X, "CELL_ROWS", 64)  # so that many buckets are split
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    v = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    v[:600] = v[0]
    v[600:1200] = v[0] + 1e-3 * rng.normal(size=(600, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if lengths == "many":
        v *= np.exp(rng.normal(size=(3000, 1)))
    rows = [(int(i), x.tolist()) for i, x in zip(rng.permutation(3000), v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(X.nearest_neighbours(df.where("vec_id % 20 = 0"), df, k=20))
    want = brute_nearest({i: x for i, x in rows if i % 20 == 0}, rows, 20)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    at = {i: np.array(x) for i, x in rows}
    assert all(s == float((at[q] * at[i]).sum()) for q, g in got.items() for i, s in g)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    hot = [q for q in want if want[q][0][1] == want[q][-1][1]]
    assert lengths == "many" or any(got[q] == want[q] for q in hot)


def test_recall_of_the_registered_query(spark):
    from airloom.llm.queries import op11_nearest

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in read(spark, folder, "embeddings").collect()]
    v, ids = np.array([x for _, x in rows]), np.array([i for i, _ in rows])
    got, hit = found(op11_nearest(spark, folder)), []
    for q in np.flatnonzero(ids % 20 == 0):
        score = (v * v[q]).sum(1)
        score[q] = -np.inf
        hit.append(len({i for i, _ in got[ids[q]]} & set(ids[np.lexsort((ids, -score))[:20]].tolist())) / 20)
    assert len(got) == len(hit) and np.mean(hit) >= 0.9


# Fill-in-middle

TEXTS = ["", None, "a", "A b", "héllo wörld, 1234", "日本語 text\n\nmore", "x<P>y", "<S", "P>", "<", "<M>", "a<b>c <P <S <M P> S> M>", "😀é" * 50,
         " \t\n", "word " * 3000, "été" * 4000 + "Abc"]


def brute_fim(key, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_and_back(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "clash") for i in range(400)] + [(None, "null key", ""), (3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    made = P.fill_in_middle(df, keep=("text",))
    got = made.collect()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        raw = (r.text or "").encode()
        assert P.render([tuple(p) for p in r.pieces], raw) == r.output.encode()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    back = P.restore(made, keep=("doc_id", "text")).collect()
    assert len(back) == len(rows) and all(r.restored == (r.text or "") and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest() for r in back)
    assert P.fill_in_middle(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.fill_in_middle(df, keep=("n",))
    with pytest.raises(ValueError):
        P.fill_in_middle(df, keep=("doc_id",))


def test_cutting_splits_descriptors():
    pieces = [(P.TEXT, 0, 5), (P.MARKS, 0, 3), (P.TEXT, 5, 4)]
    whole = P.render(pieces, b"abcdefghi")
    for at in range(len(whole) + 1):
        a, b = P.cut(pieces, at)
        assert P.render(a, b"abcdefghi") == whole[:at] and P.render(b, b"abcdefghi") == whole[at:] and all(n for _, _, n in a + b)


def test_sentinels_cannot_arise_between_pieces():
    parts = ["", "<", "<P", "<S", "P>", "S>", ">", "M>", "<M", "a"]
    for form in P.ARRANGEMENTS:
        for p in parts:
            for m in parts:
                for s in parts:
                    text = (p + m + s).encode()
                    if any(x in text for x in (P.PREFIX, P.SUFFIX, P.MIDDLE)):
                        continue
                    own = [[(P.TEXT, 0, len(p))], [(P.TEXT, len(p), len(m))], [(P.TEXT, len(p) + len(m), len(s))]]
                    out = P.render(P.arrange(own, form), text)
                    assert P.render(P.separate(out, form), out) == text


# Runs

def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        j = 0
        while j + q < n:
            if w[j] == w[j + q]:
                s = j
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                e = j + q
                if e - s >= max(6, 4 * q) and all(any(w[x] != w[x + r] for x in range(s, e - r)) for r in range(1, q)):
                    out.append((s, e - s, q))
            else:
                j += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found))


def periodic_texts(rng, count):
    for _ in range(count):
        k, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.randint(0, 90)
        w = [f"w{rng.randrange(k)}" for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if rng.random() < 0.5 and n:
            w[rng.randrange(n)] = "z"
        yield w


def test_runs_against_brute_force(spark):
    rng = random.Random(5)
    fib = ["a", "b"]
    while len(fib) < 400:
        fib = fib + (["a", "b"] if len(fib) == 2 else fib[:len(fib) // 2 + 1])
    texts = list(periodic_texts(rng, 800)) + [fib, ["x"] * 3000, ["x", "y"] * 1500 + ["z"] + ["y", "x", "y", "z"] * 9,
                                             (["p"] * 5 + ["q"]) * 12, [f"u{i}" for i in range(300)] * 5]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(texts)] + [(-1, None), (None, "a a a a a a a"), (7, "b " * 9)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int")
    got = R.periodic_runs(df, keep=("text",)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (r.text or "").split()
        want = brute_runs(w)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, brute_collapsed(w, want))
    assert R.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        R.periodic_runs(df, keep=("runs",))


def test_runs_of_a_very_long_text():
    """Fibonacci words have factors that repeat at every level and no run of four periods but in their planted end."""
    a, b = [1], [1, 2]
    while len(b) < 200_000:
        a, b = b, b + a
    assert len(R.runs(np.array(b))) == 0
    planted = R.runs(np.array(b + [7, 8, 9] * 50_000))
    assert planted.tolist() == [[len(b), len(b) + 150_000, 3]]
    assert R.runs(np.ones(500_000, np.int64)).tolist() == [[0, 500_000, 1]]


def test_planted_repetition_and_digests(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 37))) for i in range(300)] + [(None, "a b"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r.doc_id: r.text for r in R.with_repetition(df).collect()}
    for i, t in rows:
        w = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            t = " ".join(w[j] if j < a else w[a + (j - a) % p] for j in range(len(w)))
        assert texts[i] == t
    made = R.digests(R.periodic_runs(spark.createDataFrame([(1, "a a a a a a a b c b c b c b c b c"), (2, "x")], "doc_id long, text string")))
    one, two = sorted(made.collect())
    assert one[1:6] == (2, 7, 10, 2, 5000) and two[1:6] == (0, None, None, None, None)
    assert one.runs_sha256 == hashlib.sha256(b"0,7,1\n7,10,2\n").hexdigest()
    assert one.collapsed_sha256 == hashlib.sha256(b"a b c").hexdigest()
    assert two.runs_sha256 == hashlib.sha256(b"").hexdigest()
