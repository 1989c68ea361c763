"""N-gram join, phrase collocations and hard negatives against plain versions."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm import corpus, frame, grams, reach, words

PIECE = re.compile("[.,;:!?\n\x0b\x0c\r]")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def family(seed, n, base_words=120, changes=(0, 6), vocabulary=4000):
    """Variants of one text with a few replaced words each, the text itself in the middle, and variants of two variants."""
    r = random.Random(seed)
    base = [f"w{r.randrange(vocabulary)}" for _ in range(base_words)]

    def varied(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        return w

    out = [varied(base, r.randint(*changes)) for _ in range(n)]
    out[n // 2] = base
    for start in (out[1], out[2]):
        deep = varied(start, 5)
        out += [varied(deep, r.randint(1, 3)) for _ in range(n // 2)]
    return [" ".join(w) for w in out]


def plain_components(rows, shingle, num, den):
    sets = [(i, set(grams(words(t), shingle))) for i, t in rows]
    ids = [i for i, _ in rows if i is not None]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if None not in (a, b) and x and y and den * len(x & y) >= num * len(x | y)]
    return [(i, len(s)) for i, s in sets], reach(ids, links), len(links)


def check_components(spark, rows, **how):
    from resight.llm.ngram_join import ngram_components

    sizes, want, n = plain_components(rows, how["shingle"], how["num"], how["den"])
    got = ngram_components(frame(spark, rows), **how).collect()
    assert sorted(((r.id, r.n_shingles) for r in got), key=str) == sorted(sizes, key=str)
    assert all(r.component_id == (None if r.id is None else want[r.id]) for r in got)
    return n


@pytest.mark.parametrize("shingle,num", [(3, 90), (1, 60), (3, 80)])
def test_ngram_join(spark, shingle, num):
    rows = corpus() + [(119, "x " * 200_000), (5, "one two"), (6, corpus()[7][1]), (115, "one two")]
    assert check_components(spark, rows, shingle=shingle, num=num, den=100) > 10


@pytest.mark.parametrize("seed,num", [(1, 90), (2, 80), (3, 70)])
def test_ngram_join_of_a_large_family(spark, seed, num):
    texts = family(seed, 90)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(family(seed + 9, 40, 14, (0, 2)))]
    assert check_components(spark, rows, shingle=3, num=num, den=100) > 50


def test_ngram_join_of_unlike_texts_with_a_common_passage(spark):
    r = random.Random(4)
    shared = " ".join(f"s{i}" for i in range(15))
    rows = [(i, f"{shared} " + " ".join(f"o{r.randrange(60)}" for _ in range(r.randint(0, 4)))) for i in range(150)]
    assert check_components(spark, rows, shingle=1, num=80, den=100) > 50


def test_family_without_a_middle_grows_no_faster_than_its_members(spark):
    """A chain of texts: tokens of a few neighbours are its most frequent ones, and no core of all of them."""
    from resight.llm import families as L

    r = random.Random(0)
    made = {m: [(7, i, 100, r.sample(range(20 * i, 20 * i + 100), 100)) for i in range(m)] for m in (50, 200)}
    for m, rows in made.items():
        df = spark.createDataFrame(rows, "fam long, rep long, n long, d array<long>")
        assert L._recentred(df, 60, 100).selectExpr("sum(size(d))").first()[0] <= 2 * 100 * m
    links = {tuple(sorted(x)) for x in L.large_links(df, 60, 100).collect()}
    assert links <= {(a, b) for b in range(m) for a in range(b) if 20 * (b - a) <= 25}
    assert set(reach(range(m), links).values()) == {0}


def test_only_prefixes_of_a_family_become_rows(spark):
    """Near copies that differ in many words: a row for each token that a link could need, none for those that one member has alone."""
    from resight.llm import families as L

    r = random.Random(5)
    base = list(range(100))
    rows = [(7, i, 100, sorted(r.sample(base, 90)) + list(range(1000 + 100 * i, 1010 + 100 * i))) for i in range(60)]
    df = L._recentred(spark.createDataFrame(rows, "fam long, rep long, n long, d array<long>"), 80, 100)
    each = L._shared_tokens(df, 80, 100).collect()
    assert 0 < len(each) < 0.6 * df.selectExpr("sum(size(d))").first()[0]


def test_every_similar_pair_shares_a_key():
    """The pigeonhole step alone, with and without deletions."""
    from resight.llm import ngram_join as J

    r = np.random.default_rng(2)
    edges = J.band_edges(400, 90, 100)
    for few in (True, False):
        plan = J.allocate(edges, np.full(len(edges), 10 if few else 10**8), 90, 100)
        assert few or plan.loose.any()
        for _ in range(300):
            n = int(r.integers(10, 400))
            base = r.integers(0, 1 << 62, n + 60).astype(np.uint64)
            x, y = base[:n], np.concatenate([base[: n - int(r.integers(0, max(1, n // 15)))], base[n : n + int(r.integers(0, max(1, n // 15)))]])
            i = len(np.intersect1d(x, y))
            if 100 * i < 90 * (len(x) + len(y) - i) or i == len(x) == len(y):
                continue
            keys = [{(int(k), int(o)) for key, who, role in J.keys_of([np.sort(s)], plan, 90, 100) for k, o in zip(key, role)} for s in (x, y)]
            met = [(o, p) for (k, o), (q, p) in itertools.product(*keys) if k == q]
            assert any((o % 2 == 0 or p % 2 == 0) and (o < 2 or p < 2) for o, p in met)


def plain_collocations(rows, max_words, least, first, covered):
    counts, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    counts[lang or "und", tuple(w[i : i + m])] += 1
    out = collections.defaultdict(list)
    for (lang, p), a in counts.items():
        if len(p) < 2 or a < least:
            continue
        inside = any(len(q) > len(p) and b >= least and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (x, q), b in counts.items() if x == lang)
        if not inside:
            score, _, l, r = min((10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])}


def spoken(seed=3, n=120):
    r = random.Random(seed)
    vocabulary = [f"{c}{i}" for c in "aBé" for i in range(25)]
    texts = []
    for _ in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        for i in range(len(w)):
            if r.random() < 0.15:
                w[i] = "new york city" if r.random() < 0.7 else "New  York"
            if r.random() < 0.1:
                w[i] += r.choice(".,;:!?\n")
        texts.append((r.choice(["en", "de", None]), " ".join(w)))
    return texts + [("en", None), ("fr", ""), (None, " \t "), ("en", ".,;"), ("en", "a0 aé " * 40_000)] + texts[:7]


@pytest.mark.parametrize("max_words,lookup,least", [(3, 1 << 21, 10), (3, 0, 10), (4, 20, 5), (2, 1 << 21, 3)])
def test_collocations(spark, max_words, lookup, least):
    """A small lookup bound takes the joined way."""
    from resight.llm.collocations import collocations

    rows = spoken()
    df = spark.createDataFrame(rows, "lang string, text string")
    for c in ("row", "item", "key", "n", "word", "id"):
        df = df.withColumn(c, F.lit("odd"))
    got = collocations(df.repartition(4), max_words=max_words, least=least, first=40, lookup=lookup)
    want = plain_collocations(rows, max_words, least, 40, 50)
    assert len(want) > 10 and {tuple(r) for r in got.collect()} == want


def test_relations_are_worked_on_in_runs_of_texts(monkeypatch):
    """A run is bounded by its occurrences, not by the batch, and runs give what the whole batch gives."""
    import pyarrow as pa

    from resight.llm import collocations as C

    r = random.Random(1)
    n = [r.randrange(9) for _ in range(200)] + [50, 0]
    step, item = ([[r.randint(1, 2) for _ in range(k)] for k in n], [[r.randrange(5) for _ in range(k)] for k in n])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(n))), pa.array(step, pa.list_(pa.int32())), pa.array(item, pa.list_(pa.int64()))], ["row", "step", "item"])
    whole = pa.Table.from_batches(C._joined([batch])).to_pylist()
    monkeypatch.setattr(C, "PORTION", 20)
    parts = list(C._joined([batch.slice(0, 100), batch.slice(100), batch.slice(0, 0)]))
    assert len(parts) > 30 and pa.Table.from_batches(parts).to_pylist() == whole


def test_collocations_of_nothing(spark):
    from resight.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def plain_negatives(rows, every, positives, k, low, high):
    rows = [(i, label, np.floor(256 * np.array(x, dtype=float)).astype(int)) for i, x, label in rows if None not in (i, label) and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = set()
    for i, label, x in rows:
        if i % every:
            continue
        scores = sorted((-int(x @ y), j, m) for j, m, y in rows if j != i)
        for s, j, _ in [t for t in scores if t[2] == label][:positives]:
            found = [(t, n) for t, n, m in scores if m != label and low * -s <= 100 * -t <= high * -s][:k]
            out |= {(i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(found)}
    return out


def vectors(seed, n, width=12):
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0.3, 0.5), 2) for _ in range(width)], r.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
    rows += [(n + i, rows[3 * i][1], rows[5 * i][2]) for i in range(n // 6)]
    return rows + [(100_000, None, 1), (100_010, [float("nan")] * width, 1), (100_020, [None] * width, 0), (None, rows[0][1], 0), (100_030, rows[0][1], None), (100_040, [float("inf")] * width, 2), (100_050, [0.0] * width, 7)]


@pytest.mark.parametrize("every,shard,step", [(10, 4096, 8), (7, 40, 3), (10, 16, 1)])
def test_hard_negatives(spark, monkeypatch, every, shard, step):
    """Small shards and blocks make the scans meet in many pairs."""
    from resight.llm import hard_negatives as H

    monkeypatch.setattr(H, "SHARD", shard)
    monkeypatch.setattr(H, "BLOCK", 8)
    rows = vectors(every, 300)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    for c in ("id", "x", "low", "shard", "block", "score"):
        df = df.withColumn(c, F.lit("odd"))
    got = H.hard_negatives(df.repartition(3), every=every, positives=3, k=4)
    want = plain_negatives(rows, every, 3, 4, 30, 90)
    assert len(want) > 100 and {tuple(r) for r in got.collect()} == want


def test_scan_is_exact_in_any_step(monkeypatch):
    from resight.llm import hard_negatives as H

    r = np.random.default_rng(1)
    for step in (1, 5, 64):
        monkeypatch.setattr(H, "STEP", step)
        for _ in range(30):
            x, q = r.integers(-300, 300, (20, 200)), r.integers(-300, 300, 20)
            s = q @ x
            low, high = sorted(r.integers(s.min(), s.max() + 1, 2))
            rows, score = H.scan(q, x, x.min(1), x.max(1), np.arange(200), [low], [high], 5)
            assert (score == s[rows]).all()
            inside = np.sort(s[(s >= low) & (s <= high)])[::-1][:5]
            got = np.sort(score[(score >= low) & (score <= high)])[::-1][:5]
            assert (inside == got).all()


def test_hard_negatives_of_odd_tables(spark):
    from resight.llm.hard_negatives import hard_negatives

    kind = "vec_id long, embedding array<double>, label long"
    assert hard_negatives(spark.createDataFrame([], kind)).count() == 0
    rows = [(0, [1.0, 0.0], 1), (1, [1.0], 1), (2, [0.5, 0.1], 2), (3, [0.25], 2), (0, [1.0, 0.0], 1), (4, [-1.0, 0.0], 1)]
    got = {tuple(r) for r in hard_negatives(spark.createDataFrame(rows, kind), every=100, positives=2).collect()}
    assert got == {(0, 1, 1, 2, 65536, 32768)}
