import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airloom.llm import decontaminate as D, lm_score as L, near_dedup as N, quality as Q, substring_dedup as S
from airloom.llm.common import read

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sentence(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# Repeated spans

def brute_spans(rows):
    """rows of (doc_id, text) -> per row (words, removed words, kept text)."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for i, w in enumerate(words):
        own = -2 ** 63 if rows[i][0] is None else rows[i][0]
        for p in range(len(w) - 19):
            key = tuple(w[p:p + 20])
            first[key] = min(first.get(key, (own, p)), (own, p))
    out = []
    for i, w in enumerate(words):
        own, gone = -2 ** 63 if rows[i][0] is None else rows[i][0], set()
        met = set()
        for p in range(len(w) - 19):
            key = tuple(w[p:p + 20])
            if first[key][0] < own or key in met:
                gone.update(range(p, p + 20))
            met.add(key)
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_spans_against_brute_force(spark):
    rng = random.Random(2)
    passages = [sentence(rng, n, 2000) for n in (19, 20, 21, 27, 45, 90)]
    rows = []
    for i in range(120):
        parts = [sentence(rng, rng.randrange(0, 40), 2000) for _ in range(3)]
        for p in rng.sample(passages, 2):
            parts.insert(rng.randrange(len(parts)), p)
        rows.append((rng.randrange(10 ** 9), " ".join(parts)))
    rows += [(rows[3][0] + 1, rows[3][1]), (rows[4][0], rows[4][1]), (rows[5][0], rows[6][1]), (None, rows[7][1]), (7, None), (8, ""),
             (9, "a " * 100), (10, "a b " * 60), (11, "a\x0bb\x0c c d " * 20), (12, sentence(rng, 30_000, 40)),
             (13, sentence(rng, 400, 2)), (14, "\n".join([passages[5]] * 3))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, kept string")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept, r.kept_sha256) for r in S.dedup_spans(df).collect())
    assert got == Counter((i, n, g, k, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in zip(rows, brute_spans(rows)))
    assert S.dedup_spans(df.limit(0)).count() == 0
    for r in S.dedup_spans(df).where("n_removed > 0").collect():
        at = r.removed
        assert sum(b - a for a, b in zip(at[::2], at[1::2])) == r.n_removed


# Near copies

def brute_classes(rows, threshold=0.8):
    labelled = [N.shingles(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or N.aligned(labelled[i], labelled[j]) >= threshold:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {i: min(rows[x][0] for x in g) for g in groups.values() for i in g}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i:i + 1] = rng.choice([[], ["new"], [words[i], "more"]])
    return " ".join(words)


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    rows, hot = [], sentence(rng, 300, 5000)
    shared = sentence(rng, 60, 5000)
    for i in range(25):
        base = sentence(rng, rng.randrange(1, 300), 5000)
        rows += [base, base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, max(1, len(base.split()) // 15))]
        rows.append(shared + " " + sentence(rng, 100, 5000))
    rows += [edited(rng, hot, rng.randrange(1, 9)) for _ in range(120)]
    rows += ["", None, "a", "a", "a b", "x " * 3000, "x " * 2990, "y z " * 500]
    chain = [hot]
    for _ in range(12):
        chain.append(edited(rng, chain[-1], 3))
    rows += chain
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(i, rows[x]) for i, x in enumerate(order)]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in rows], "doc_id long, text string, node binary")
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == want
    assert sorted(r.doc_id for r in N.keep_first(df).collect()) == sorted(set(want.values()))


def test_classes_edges(spark):
    schema = "doc_id long, text string"
    assert N.classes(spark.createDataFrame([], schema)).count() == 0
    got = N.classes(spark.createDataFrame([(1, "only"), (None, None), (3, ""), (3, "")], schema)).collect()
    assert len(got) == 4
    kept = N.keep_first(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (2, "a b c")], schema)).collect()
    assert [r.doc_id for r in kept] == [None]


def test_links_inside_a_crowd_without_its_original(spark):
    """Hundreds of texts share their buckets with each other, and only a few pairs of them are similar."""
    rng = random.Random(5)
    parts = [sentence(rng, 8, 10 ** 6) for _ in range(40)]
    rows = [" ".join(parts[i] for i in sorted(rng.sample(range(40), 32))) for _ in range(500)]
    labelled = [N.shingles(t) for t in rows]
    number = {h: i for i, h in enumerate(sorted({h for x in labelled for h in x.tolist()}))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for i, x in enumerate(labelled):
        held[i, [number[h] for h in x.tolist()]] = 1
    both, n = held @ held.T, held.sum(1)
    near = np.argwhere(np.triu(both / (n[:, None] + n - both), 1) >= 0.8 - 1e-6)  # an alignment has no more than both hold
    least = list(range(len(rows)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    links = 0
    for i, j in near.tolist():
        if N.aligned(labelled[i], labelled[j]) >= 0.8:
            links += 1
            least[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(rows))}
    assert links > 3 and len(set(want.values())) > 400, (links, len(set(want.values())))
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.classes(df).collect()} == want


def crowd(rng, n):
    """Texts made from one that is not among them, by one to six edits."""
    base = sentence(rng, 150, 10 ** 6)
    return [edited(rng, base, rng.randrange(1, 7)) for _ in range(n)]


def overlaps(rows):
    labelled = [N.shingles(t) for t in rows]
    number = {}
    held = np.zeros((len(rows), len({h for x in labelled for h in x.tolist()})), np.float32)
    for i, x in enumerate(labelled):
        held[i, [number.setdefault(h, len(number)) for h in x.tolist()]] = 1
    both, n = held @ held.T, held.sum(1)
    return labelled, both / (n[:, None] + n - both)


def test_crowds_are_split_again(spark, monkeypatch):
    """Large buckets of loosely similar texts: links are found, nothing else is linked, and only pairs near the threshold
    are aligned."""
    monkeypatch.setattr(N, "LARGE", 48)
    compared, plain = [], N._compared

    def counted(pairs, texts, threshold):
        compared.append(pairs.count())
        return plain(pairs, texts, threshold)

    monkeypatch.setattr(N, "_compared", counted)
    rows = crowd(random.Random(12), 500)
    labelled, share = overlaps(rows)
    links = [(i, j) for i, j in np.argwhere(np.triu(share, 1) >= 0.8 - 1e-6).tolist() if N.aligned(labelled[i], labelled[j]) >= 0.8]
    least = list(range(len(rows)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, j in links:
        least[max(find(i), find(j))] = min(find(i), find(j))
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert len(links) > 30 and all(find(i) == find(c) for i, c in got.items())
    assert np.mean([got[i] == got[j] for i, j in links]) >= 0.98
    assert sum(compared) < 25 * len(rows), compared  # of 124,750 pairs, of which 51,738 share 0.7 and more


def test_bits_estimate_the_overlap():
    rng = random.Random(13)
    rows = crowd(rng, 60)
    labelled, share = overlaps(rows)
    signs = [N.bits(x) for x in labelled]
    agree = np.array([[N.BITS - sum(int(w).bit_count() for w in (a ^ b).view(np.uint64).tolist()) for b in signs] for a in signs])
    off = agree / N.BITS - (1 + share) / 2
    assert abs(off[np.triu_indices(60, 1)].mean()) < 0.01 and np.abs(off).max() < 0.07
    assert (agree[share >= 0.8] >= N.least_agreement(0.8)).all() and N.least_agreement(0.8) < 0.9 * N.BITS


def test_kept_rows_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, "a b", 8, "y")], "doc_id long, text string, _node int, key string")
    assert [tuple(r) for r in N.keep_first(df).collect()] == [(1, "a b", 7, "x")]


def test_alignment():
    rng = random.Random(9)
    a = sentence(rng, 400, 9000)
    s = N.shingles
    assert N.aligned(s(a), s(a)) == 1
    assert N.aligned(s(a), s(sentence(rng, 400, 9000))) == 0
    half = a.split()
    assert N.aligned(s(a), s(" ".join(half[200:] + half[:200]))) < 0.8  # same shingles, another order
    assert len(set(s("x " * 500).tolist())) == 496
    assert N.rising([3, 1, 2, 2, 5, 4]) == 3


# Benchmark passages

def brute_contamination(docs, items):
    def words(t):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        return [w for w in "".join(c if c.isalnum() and c.isascii() or c > "\x7f" else " " for c in low).split(" ") if w]

    wins = set()
    for i, t in items:
        w = words(t)
        if w and i is not None:
            n = min(13, len(w))
            wins |= {(i, tuple(w[p:p + n])) for p in range(len(w) - n + 1)}
    by = defaultdict(set)
    for i, w in wins:
        by[w].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in by}:
            for p in range(len(w) - n + 1):
                met = by.get(tuple(w[p:p + n]))
                if met:
                    found |= met
                    hit.update(range(p, p + n))
        out.append((d, len(w), len(hit), sorted(map(str, found)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter((a, b, c, tuple(e), f) for a, b, c, e, f in out)


@pytest.mark.parametrize("block", [20_000, 7])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(D, "TERM_BLOCK", block)
    rng = random.Random(6)
    items = [(i, sentence(rng, rng.randrange(1, 40), 500)) for i in range(12)] + [
        (12, "the the the"), (13, ""), (14, None), (None, "lost item words"), (15, "It's O'Neil\\ \"x\""), (3, "second row of three"), (16, "ÄÖ ßx é")]
    docs = [(i, sentence(rng, 60, 500)) for i in range(20)]
    for i, t in items:
        if t:
            docs += [(100 + len(docs), "before, " + t.upper().replace(" ", " - ") + " after " + t), (100 + len(docs), sentence(rng, 900, 500) + " " + t)]
    docs += [(1, None), (2, ""), (None, items[0][1]), (None, items[0][1]), (5, "the " * 50), (6, "the the"), (7, items[1][1] + " x " * 100_000)]
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, row int, id string")
    b = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, term string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in D.contamination(d, b).collect())
    assert got == brute_contamination(docs, items)
    assert D.contamination(d.limit(0), b).count() == 0
    assert {r.n_hit for r in D.contamination(d, b.limit(0)).collect()} == {0}


def test_proximity(spark):
    d = spark.createDataFrame([(1, "red green blue"), (2, "red x green y blue"), (3, "blue green red"), (4, "red green"), (5, "red x y z green blue")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "red green blue")], "item_id long, text string")
    hit = lambda slack: {r.doc_id for r in D.contamination(d, b, slack=slack).collect() if r.n_items}
    assert hit(0) == {1} and hit(2) == {1, 2, 3}


def test_proximity_against_brute_force(spark):
    """Small vocabularies, so that words repeat: stretches hold each word as often as the item, not the surroundings."""
    rng = random.Random(21)
    docs = [(i, " ".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 25)))) for i in range(150)]
    docs += [(1000, "aa bb x x aa"), (1001, "aa x bb x x aa"), (1002, "aa bb x aa")]
    items = [(f"i{i}", " ".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6)))) for i in range(8)] + [("rep", "aa bb aa")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    for slack in (0, 1, 3):
        want = {}
        for i, t in docs:
            w, hit, which = t.split(), set(), set()
            for name, item in items:
                need = Counter(item.split())
                for p in range(len(w)):
                    part = w[p:p + len(item.split()) + slack]
                    if (part == item.split()) if not slack else (part[0] in need and all(part.count(x) >= n for x, n in need.items())):
                        while part[-1] not in need:
                            part.pop()
                        which.add(name)
                        hit.update(range(p, p + len(part)))
            want[i] = len(hit), sorted(which)
        got = {r.doc_id: (r.n_hit, r["items"]) for r in D.contamination(d, b, slack=slack).collect()}
        assert got == want, slack


# Language model

def test_base_scores_and_counts(spark, small):
    docs = read(spark, small, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (None, "unknownword"), (None, "unknownword")], "doc_id long, text string"))
    out = Q.held_out(parts=7)
    got = L.score(docs.withColumn("row", F.lit(1)), ~out, PATH).collect()
    rows = docs.collect()
    tokens = [(r.doc_id, L.text_words(r.text) + [L.END]) for r in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, x in tokens if not held(i) for w in x)
    n, v = sum(c.values()), len(c)
    want = Counter((i, not held(i), len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for i, x in tokens)
    assert Counter((r.doc_id, r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(L, "DICTIONARY", 2)
    docs = spark.createDataFrame([(i, "a a a b b " + " ".join(f"r{i % 3}" for _ in range(i))) for i in range(1, 12)], "doc_id long, text string")
    tokens = {r.doc_id: L.text_words(r.text) + [L.END] for r in docs.collect()}
    c = Counter(w for x in tokens.values() for w in x)
    n, v = sum(c.values()), len(c)
    for r in L.score(docs, F.lit(True), PATH).collect():
        assert r.n_known == r.n_tokens == len(tokens[r.doc_id])
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[r.doc_id])) < 1e-9


def test_scores_do_not_depend_on_the_dictionary(spark, small, monkeypatch):
    docs = read(spark, small, "documents").select("doc_id", "text")
    got = []
    for size in (200_000, 50, 0):
        monkeypatch.setattr(L, "DICTIONARY", size)
        got.append({r.doc_id: r.score for r in L.score(docs, ~Q.held_out(parts=7), PATH).collect()})
    assert all(abs(got[0][i] - other[i]) < 1e-6 * abs(got[0][i]) for other in got[1:] for i in got[0])


def test_long_texts_give_windows_of_all_their_parts():
    lexicon = tiny_lexicon()
    texts = ["the of word " * n for n in (0, 3, 341, 342, 5000)]
    rows, classes, weight = L._training_windows(lexicon, texts, list(range(5)))
    assert len(rows) == sum(-(-(3 * n + 1) // L.TRAIN_EVERY) for n in (0, 3, 341, 342, 5000)) == 1 + 1 + 1 + 2 + 15
    assert (weight.sum(1) > 0).all() and weight[-1].sum() >= L.WIDTH // 2


def test_every_word_is_trained_on_once(spark, monkeypatch):
    lexicon = tiny_lexicon()
    texts = ["the of word " * n for n in (0, 3, 11, 341, 5000)] + [None, "of"]
    rows, classes, weight = L.every_window(lexicon, texts)
    sizes = [len(L.text_words(t)) + 1 for t in texts]
    assert weight.sum() == sum(sizes) and len(rows) == sum(-(-n // L.WIDTH) for n in sizes) and rows.shape[1] == L.WIDTH
    numbers = np.concatenate([lexicon.numbers([*L.text_words(t), L.END]) for t in texts])
    assert np.array_equal(np.bincount(classes[weight > 0], minlength=L.CLASSES), np.bincount(lexicon.cls[numbers], minlength=L.CLASSES))
    assert (rows == L.OWN_ROWS + L.CLASSES).sum() == len(texts)  # each text begins once
    inner = weight[:, 1:] > 0  # what stands before a word is the word before it
    assert {(int(r), int(c)) for r, c in zip(rows[:, 1:][inner], classes[:, 1:][inner])} <= {
        (int(lexicon.row[x]), int(lexicon.cls[y])) for x, y in itertools.pairwise(numbers)}

    seen = []
    monkeypatch.setattr(L.Trainer, "step", lambda self, rows, classes, weight: seen.append(weight.sum()))
    monkeypatch.setattr(L, "_made", lambda sent: (lexicon, L.initial(np.ones(L.CLASSES))))
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    assert sum(r.column("windows")[0].as_py() for r in L._train_task(None)([batch])) == len(rows) and sum(seen) == sum(sizes)


def two_kinds(rng, n):
    """Texts of words of one of two kinds, some of more than one piece."""
    kinds = [[rng.choice("abcdefghijklm") + "".join(rng.choices(half, k=rng.randrange(1, 7))) for _ in range(400)] for half in ("nopqrs", "tuvwxyz")]
    return ["  ".join(rng.choices(kinds[i % 2], k=rng.choice([0, 3, 40, 255, 256, 257, 1100]))) for i in range(n)]


def test_classes_come_from_every_word(spark, monkeypatch):
    texts = [*two_kinds(random.Random(5), 60), None, " \n", "One"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    ids = lambda t: [int.from_bytes(x[:4], "little") for x in L._vocabulary(PATH)[0].split(L.text_words(t))]
    split = [ids(t) for t in texts]
    size = len(L._vocabulary(PATH)[1])
    first = np.bincount([i for x in split for i in x], minlength=size).astype(float)
    anchors = np.argsort(-first, kind="stable")[:L.ANCHORS].tolist()
    want = np.zeros((size, L.ANCHORS))
    for x in split:
        for a in range(0, len(x), 256):
            present = [i in x[a:a + 256] for i in anchors]
            for i in x[a:a + 256]:
                want[i] += present
    plain = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    words, at, sizes = L.distinct_words(texts)
    known = {w: ids(w.decode())[0] for w in words[::2]}
    for field in (L.FIELD, 4):  # the second takes places in parts
        monkeypatch.setattr(L, "FIELD", field)
        number, got = np.full(size, -1), np.zeros((size, L.ANCHORS), np.int64)
        number[anchors] = range(L.ANCHORS)
        for sent in ({}, known):
            L.add_beside(L.first_subwords(PATH, words, sent), at, sizes, number, got)
        assert np.array_equal(got, 2 * want)
    assert np.array_equal(L.beside_anchors(plain, PATH, first, words[:9]), want)

    row, classes = L.class_tables(first, want)
    for documents, words in ((2000, 256), (3, 2)):  # what the attention starts on does not matter
        monkeypatch.setattr(L, "WARM_DOCS", documents)
        monkeypatch.setattr(L, "WARM_WORDS", words)
        stats = L.train(docs, PATH, "doc_id", "text")[0]["stats"]
        assert np.array_equal(stats["class"], classes) and np.array_equal(stats["row"], row)


def test_scores_of_many_texts_at_once():
    """Each text as if it stood alone, window by window."""
    lexicon, weights = tiny_lexicon(), L.initial(np.ones(L.CLASSES))
    texts = ["the of zq " * n for n in (0, 1, 3, 9, 10, 11, 80)] + [None, "\u00e9x\u00e9x zq zq", "of"]
    numbers, sizes = L.text_numbers(lexicon, texts)
    for x, got in zip(np.split(numbers, np.cumsum(sizes)[:-1]), L.score_numbers(weights, numbers, sizes, lexicon)):
        rows, want = np.append(L.OWN_ROWS + L.CLASSES, lexicon.row[x[:-1]]), lexicon.log_word[x].sum()
        for start, first in zip(*L.windows_of(len(x))):
            part = slice(start, start + L.WIDTH)
            logits = L.forward(weights, rows[None, part])[0][0].astype(float)
            own = logits[np.arange(len(logits)), lexicon.cls[x[part]]] - np.log(np.exp(logits).sum(1))
            want += own[first:].sum() / np.log(10)
        assert abs(got - want) < 1e-5 * abs(want)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "_made", lambda sent: (lexicon, weights))
        rows = [r for made in L._score_task(None)([batch]) for r in made.to_pylist()]
    for r, t in zip(rows, texts, strict=True):
        words = [*L.text_words(t), L.END]
        rare = Counter(w for w in words if w not in (b"the", b"of", b"word", L.END))
        assert (r["n_tokens"], r["held"], dict(zip(r["rare"], r["rare_n"]))) == (len(words), len(words) - rare.total(), rare)
        assert np.allclose(r["spelled"], [lexicon.log_spelled[lexicon.known[w]] for w in r["rare"]])


def test_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.score(docs, F.lit(False), PATH).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (3, 0, 0, 0)
    assert L.score(docs.limit(0), F.lit(True), PATH).count() == 0


def tiny_lexicon():
    size = 50_256
    first = np.ones(size)
    classes = np.arange(size) % (L.CLASSES - 1)
    stats = {"row": np.arange(size) % L.OWN_ROWS, "class": classes, "all": first * 10, "rare": first, "first": first, "later": np.ones(size + 1),
             "pairs": np.zeros(0, np.int64), "pair_counts": np.zeros(0)}
    return L.Lexicon(PATH, [b"the", b"of", b"word"], np.array([5.0, 3, 2]), 4, stats)


def test_windows_score_each_word_once_and_causally():
    lexicon = tiny_lexicon()
    weights = L.initial(np.ones(L.CLASSES))
    for n in (1, 2, 31, 32, 33, 56, 57, 200):
        starts, first = L.windows_of(n)
        scored = [p for s, f in zip(starts, first) for p in range(s + f, min(s + L.WIDTH, n))]
        assert scored == list(range(n))
    words = [b"the", b"of", b"word"] * 30
    a = lexicon.numbers([*words, L.END])
    one, two, both = (L.score_texts(weights, x, lexicon) for x in ([a], [a[:40]], [a, a[:40]]))
    assert np.allclose(both, [one[0], two[0]])
    rows = np.array([lexicon.row[a[:32]]])
    logits, _ = L.forward(weights, rows)
    changed = rows.copy()
    changed[0, 20:] = 5
    assert np.allclose(logits[0, :20], L.forward(weights, changed)[0][0, :20], atol=1e-5)


def test_words_are_looked_up_once_a_chunk_and_numbered_as_one_by_one(monkeypatch):
    lexicon = tiny_lexicon()
    texts = ["the of\u00a0the word " * 500, None, "", " \t\n", " The\x0bOF\x0cword\rz\u00c9\u0085\x1c a\x00b\n", "\u0130stanbul STRASSE\u1e9e", "the"]
    asked, look = [], lexicon.numbers
    monkeypatch.setattr(lexicon, "numbers", lambda words: asked.append(len(words)) or look(words))
    rows, classes, weight = L.every_window(lexicon, texts)
    own = [[*L.text_words(t), L.END] for t in texts]
    assert asked == [len({w for words in own for w in words})]
    numbers, sizes = L.text_numbers(lexicon, texts)
    assert sizes.tolist() == [len(words) for words in own] and weight.sum() == sizes.sum()
    assert numbers.tolist() == look([w for words in own for w in words]).tolist()
    got = Counter()
    for made in L._count([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]):
        got.update(dict(zip(made.column("word").to_pylist(), made.column("n").to_pylist())))
    assert got == Counter(w for words in own for w in words)


def test_chosen_places_and_a_kept_room_give_the_same():
    rng = np.random.default_rng(2)
    room = L.Room()
    for size in (1, 40):  # the second has numbers whose exponentials do not fit without a shift
        w = {n: x * size if n in "qku" else x for n, x in L.initial(np.ones(L.CLASSES)).items()}
        for count in (5, 2, 7):
            rows, classes = rng.integers(0, L.OWN_ROWS, (count, L.WIDTH)), rng.integers(0, L.CLASSES, (count, L.WIDTH))
            logits = L.forward(w, rows)[0].astype(np.float64)
            top = logits.max(2, keepdims=True)
            want = np.take_along_axis(logits - top - np.log(np.exp(logits - top).sum(2, keepdims=True)), classes[..., None], 2)[..., 0]
            counted = rng.random(rows.shape) < 0.7
            assert np.allclose(L.class_log_probabilities(w, rows, classes), want, rtol=1e-4, atol=1e-3)
            assert np.allclose(L.class_log_probabilities(w, rows, classes, counted, room), want[counted], rtol=1e-4, atol=1e-3)
            one, other = (L.gradients(w, rows, classes, counted.astype(np.float32), r) for r in (None, room))
            assert all(np.array_equal(one[n], other[n]) for n in one)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {n: x.astype(np.float64) for n, x in L.initial(np.ones(L.CLASSES)).items()}
    rows, classes = rng.integers(0, 50, (2, 6)), rng.integers(0, L.CLASSES, (2, 6))
    weight = np.ones((2, 6), np.float32)
    g = L.gradients(w, rows, classes, weight)
    loss = lambda: -L.class_log_probabilities(w, rows, classes).mean()
    for name in w:
        at = (int(rows[0, 0]), 3) if name == "embed" else tuple(rng.integers(0, s) for s in (w[name].shape if name != "place" else (6, L.DIM)))
        before = w[name][at]
        w[name][at] = before + 1e-5
        up = loss()
        w[name][at] = before - 1e-5
        down = loss()
        w[name][at] = before
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_words_of_a_class_sum_to_one_at_most():
    lexicon = tiny_lexicon()
    ids, _, _ = L.subwords_of(lexicon.merger, [b"the"], 50_256)
    for first in range(0, 50_256, 9973):  # a word starts, goes on or ends; each choice is a distribution
        assert abs(lexicon.left[first] * lexicon.next.sum() - 1) < 1e-9
    mass = np.bincount(lexicon.first_class, 10 ** lexicon.log_first, L.CLASSES)
    assert np.allclose(mass[:-1], 1)


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents")
    scored = L.score(docs, ~Q.held_out(parts=7), PATH).where("not training").agg(F.sum("score"), F.sum("base_score")).first()
    assert scored[0] > scored[1]


# Pipeline

def test_pipeline_against_brute_force(spark, small):
    import tiktoken
    from .test_bpe_quality_shards import LIBRARY

    import corpus_pipeline as P

    docs = {r.doc_id: r.text for r in read(spark, small, "documents").collect()}
    model = Q.train(read(spark, small, "documents"), read(spark, small, "labels").where(~Q.held_out()))
    rows = [(i, t) for i, t in sorted(docs.items()) if Q.score_of(t, model) >= 0.7]
    classes = brute_classes(rows)
    rows = [r for r, c in zip(rows, (classes[i] for i in range(len(rows)))) if r[0] == c]
    rows = [(i, k if gone else t) for (i, t), (_, gone, k) in zip(rows, brute_spans(rows))]
    items = [(r.item_id, r.text) for r in read(spark, small, "benchmark").collect()]
    dirty = {x[0] for x in brute_contamination(rows, items) if x[4]}
    want = {i: LIBRARY.encode_ordinary(t) for i, t in rows if i not in dirty}
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in P.run(spark, small).collect()}
    assert got == want and tiktoken and len(want) < len(docs)
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontaminate", "byte_bpe"]
