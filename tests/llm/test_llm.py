"""Each training-data operator against a plain version, on texts with copies, nulls, ties and odd columns."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOWER))


def grams(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else [])


def corpus(seed=3, n=60):
    """(id, text) rows: prose, exact and near copies, shared lines, junk, nulls."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(400)]

    def line(k):
        return " ".join(r.choice(vocabulary).capitalize() if r.random() < 0.1 else r.choice(vocabulary) for _ in range(k))

    rows = [(i, "\n".join(line(r.randint(1, 40)) for _ in range(r.randint(1, 6)))) for i in range(n)]
    base = line(120)
    for i in range(n, n + 12):
        w = base.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w)))
    shared = line(30)
    rows += [(100 + i, f"{line(10)}\n{shared}\n{line(5)}") for i in range(4)]
    rows += [(110, rows[0][1]), (111, rows[0][1].upper()), (112, None), (113, ""), (114, " \n\t "), (115, "one two"), (116, "One  Two"), (117, "!?"), (None, rows[1][1]), (118, "x " * 3000)]
    return rows


def frame(spark, rows):
    """The rows with columns whose names the operators use themselves, dealt over partitions."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for extra in ("id", "key", "rep", "token", "node", "part", "line", "gone", "n_lines"):
        df = df.withColumn(extra, F.lit("odd"))
    return df.withColumn("lang", F.lit(None).cast("string")).repartition(5)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def reach(ids, linked):
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("shingle,num,leaf,depth", [(3, 85, 32, 12), (5, 80, 32, 12), (3, 60, 3, 2)])
def test_near_duplicates(docs, rows, shingle, num, leaf, depth):
    """The last case has small leaves and depth, so dense nodes are met block by block."""
    from resight.llm.near_dedup import near_duplicates

    sets = [(i, set(grams(words(t), shingle))) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if None not in (a, b) and x and y and 100 * len(x & y) >= num * len(x | y)]
    want = reach([i for i, _ in rows if i is not None], links)
    got = near_duplicates(docs, shingle=shingle, num=num, den=100, leaf=leaf, depth=depth).collect()
    assert len(got) == len(rows) and len(links) > 10
    size = dict(sets)
    for r in got:
        assert r.n_shingles == len(size[r.id])
        assert r.component_id == (None if r.id is None else want[r.id])
        assert r.kept == (r.id is None or r.id == want[r.id])


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_of_trees(similarity):
    """Pairs at the threshold whose nodes all stay large: how many share no path down to the last depth."""
    import pyarrow as pa

    from resight.llm import near_dedup as N

    n, r = 20000, np.random.default_rng(8)
    a = r.integers(0, 1 << 32, (n, N.SKETCH), dtype=np.uint32)
    b = np.where(r.random(a.shape) < similarity, a, r.integers(0, 1 << 32, a.shape, dtype=np.uint32))
    sketch = np.concatenate([np.stack([a, b], axis=1).reshape(2 * n, -1).view(np.uint8), np.zeros((2 * n, N.MORE), np.uint8)], axis=1)
    level = {"rep": np.arange(2 * n)}
    for depth in range(N.DEPTH):
        batch = pa.RecordBatch.from_arrays([pa.array(v) for v in level.values()] + [pa.array([sketch[i].tobytes() for i in level["rep"]], pa.binary())], [*level, "sketch"])
        (out,) = N._branch(depth, N.TREES, similarity)([batch])
        rep, node = out.column("rep").to_numpy(), out.column("node").to_numpy()
        # only nodes that hold both sets of a pair go on
        both = np.unique(np.stack([node, rep], axis=1), axis=0)
        meets = np.unique(both[1:][(both[1:, 0] == both[:-1, 0]) & (both[1:, 1] // 2 == both[:-1, 1] // 2)], axis=0)
        keep = np.isin(node, meets[:, 0])
        level = {k: out.column(k).to_numpy()[keep] for k in ("tree", "node", "rep")}
    missed = n - len(np.unique(level["rep"] // 2))
    print("missed", missed, "of", n)
    assert missed <= n * 3e-4


def test_near_duplicates_of_a_large_family_at_the_defaults(spark):
    """Hundreds of texts of one template, at the default depth and leaf, against all pairs."""
    from test_joins import family, plain_components

    from resight.llm.near_dedup import near_duplicates

    rows = list(enumerate(family(3, 220, 120, (0, 8)) + family(8, 60, 40, (0, 2)))) + [(900, None), (901, " ")]
    sizes, want, n = plain_components(rows, 3, 85, 100)
    got = {r.id: r for r in near_duplicates(frame(spark, rows), shingle=3, num=85, den=100).collect()}
    wrong = [i for i in want if got[i].component_id != want[i]]
    print("links", n, "of", len(want), "wrong", len(wrong))
    assert n > 500 and len(wrong) <= 0.02 * len(want)


def test_near_duplicates_of_nothing(none):
    from resight.llm.near_dedup import near_duplicates

    assert near_duplicates(none).count() == 0


def test_components(spark):
    from resight.llm.graph import components

    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000 + i) for i in range(50)] + [(7, 7)]
    links += [(None, 3)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = [(a, b) for a, b in links if a is not None and a != b]
    assert got == reach({x for p in pairs for x in p}, pairs)


def plain_line_dedup(rows, num=80, den=100):
    lines = []
    for i, t in rows:
        if i is not None and t:
            lines += [((i, k), frozenset(grams(words(x, ALNUM), 5))) for k, x in enumerate(t.split("\n"))]
    lines = sorted((p, s) for p, s in set(lines) if s)
    gone = set()
    for k, (p, s) in enumerate(lines):
        for q, t in lines[:k]:
            both = len(s & t)
            if den * both >= num * (len(s) + len(t) - both):
                gone.add(p)
                break
    return [(i, t if not t or i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone), sum(1 for p in gone if p[0] == i)) for i, t in rows]


def test_line_dedup(docs, rows):
    from resight.llm.line_dedup import dedup_lines

    got = dedup_lines(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_removed"}
    want = plain_line_dedup(rows)
    assert sum(n for _, _, n in want) > 10
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("bound", [None, 30])
def test_line_dedup_of_chained_lines_and_of_a_group(spark, monkeypatch, bound):
    """Lines that hang together in a chain are no large family, and a family that a task can hold is compared there."""
    import random

    from resight.llm import line_dedup as L

    r = random.Random(4)
    long = [f"c{i}" for i in range(900)]
    rows, at = [], 0
    for i in range(120):
        rows.append((i, " ".join(long[at : at + 40])))
        at += r.choice((1, 3, 6, 8))
    base = [f"b{i}" for i in range(80)]
    for i in range(200, 270):
        w = list(base)
        for k in r.sample(range(80), r.choice((1, 2, 3))):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w) + "\n" + rows[i % 7][1]))
    large = []
    real = L.later_in_large
    monkeypatch.setattr(L, "later_in_large", lambda *a: large.append(1) or real(*a))
    if bound:
        monkeypatch.setattr(L, "MEMBERS", bound)
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = sorted((x.doc_id, x.text, x.n_removed) for x in got.collect())
    want = sorted(plain_line_dedup(rows))
    assert 100 < sum(n for _, _, n in want) < 200
    assert got == want
    assert bool(large) == bool(bound)


def test_line_dedup_of_nothing(none):
    from resight.llm.line_dedup import dedup_lines

    assert dedup_lines(none).count() == 0


ITEMS = [(1, "one two"), (2, None), (3, ""), (4, "zzz zzz zzz"), (5, "one two"), (None, "x x")]


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_contaminated(spark, docs, rows, block_words):
    from resight.llm.decontaminate import contaminated

    w = rows[5][1].split()
    items = [*ITEMS, (6, " ".join(w[3:16])), (7, ", ".join(w[4:17]).upper()), (8, rows[61][1]), (8, rows[61][1]), (9, rows[100 - 28][1])]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit("odd"))
    got = contaminated(docs, table, window=10, block_words=block_words).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for i, t in rows:
        d = words(t, ALNUM)
        hit, names = set(), set()
        for item, x in items:
            x = words(x, ALNUM)
            for g in set(grams(x, min(10, len(x)))) if x else ():
                at = [p for p in range(len(d) - len(g) + 1) if tuple(d[p : p + len(g)]) == g]
                hit |= {q for p in at for q in range(p, p + len(g))}
                if at and item is not None:
                    names.add(item)
        want[(i, len(d), len(hit), tuple(sorted(names)), bool(hit))] += 1
    assert collections.Counter((r.id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want
    assert sum(1 for k in want if k[4]) > 5


def test_contaminated_of_nothing(spark, docs, none):
    from resight.llm.decontaminate import contaminated

    items = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(docs, items).where("contaminated").count() == 0
    assert contaminated(none, items).count() == 0


def toxic_rows(n=1500):
    r = random.Random(9)
    common = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        w = r.choices(common, k=r.randint(20, 80))
        bad = r.random() < 0.15
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randrange(len(w)), r.choice(["vile", "foul", "nasty"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_toxicity(spark):
    from resight.llm.toxicity import toxicity

    data = toxic_rows()
    docs = frame(spark, [(i, t) for i, t, _ in data] + [(90_000, None), (90_001, ""), (None, "vile foul")])
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 5 < 3] + [(None, 1), (4, None), (77_777, 1)], "doc_id long, toxic int").withColumn("id", F.lit("odd"))
    got = {r.id: r for r in toxicity(docs, labels).collect()}
    assert len(got) == len(data) + 3
    held = [(y, got[i].predicted) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    assert sum(y == p for y, p in held) >= 0.98 * len(held)
    assert got[90_000].predicted == got[90_001].predicted == 0 and got[None].held_out
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_without_positives(spark, docs, none):
    from resight.llm.toxicity import toxicity

    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity(docs, labels).collect()} == {(0.0, 0)}
    assert toxicity(none, labels).count() == 0


def test_toxicity_of_few_rows(spark):
    """No feature above chance, one positive, one id in many rows."""
    from resight.llm.toxicity import toxicity

    r = random.Random(3)
    say = lambda k: " ".join(r.choice("abcdefghijklmnop") for _ in range(k))
    rows = [(i, say(12)) for i in range(40)]
    for toxic in (range(8), [1], []):
        labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(40)], "doc_id long, toxic int")
        got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
        assert len(got) == 40 and all(0 <= x.score <= 1 for x in got)
    rows = [(7, f"vile {say(9)}") for _ in range(300)] + [(100 + i, say(9)) for i in range(300)]
    labels = spark.createDataFrame([(7, 1)] + [(100 + i, 0) for i in range(300)], "doc_id long, toxic int")
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert len(got) == 600 and all(x.predicted == 0 for x in got if x.id != 7)


def test_toxicity_finds_a_rare_telling_word_among_many_common_ones(spark):
    """The word is far from the most frequent ones of toxic texts, but no clean text has it."""
    from resight.llm.toxicity import train
    from resight.llm.words import ALNUM, chunks, split

    import pyarrow as pa

    r = random.Random(5)
    common = [f"c{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choices(common, k=150)) + (" zzyx" if i % 10 == 0 else "")) for i in range(1500)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1500)], "doc_id long, toxic int")
    model = train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    (c,) = chunks(pa.array(["zzyx"]))
    at = np.flatnonzero(model.words == split(c, ALNUM).hash[0])
    assert len(at) == 1 and len(model.words) < 50 and model.weights[at[0]] > 1


TEXTS = [
    "", " ", "  a", "a  ", "\n", "日本語のテキストです。" * 30, "x" * 500, "aaaa aaa aaaaaaa", "Don't stop!!! http://www.example.com/a?b=c&d=e#frag 12345678901234567890",
    "мама мыла раму 😀😀👩‍👩‍👧 \u0000 \t\t x", "ab" * 400, "  " * 40, "def f(x):\n    return x**2  # note\n\n\n\nclass A:\n        pass", "<s> </s> <unk>",
]


def test_round_trip_is_one_pass(spark, docs):
    """The same ids and texts as encode and decode, with one worker for each task."""
    import public_tokenizers

    from resight.llm.sentencepiece import decode, encode, round_trip

    path = public_tokenizers.path("piece_bpe_32k.model")
    key = lambda x: (x.id is not None, x.id, x.text or "")
    got = round_trip(docs, path)
    want = decode(encode(docs, path), path, keep=("id", "text", "ids")).select("id", "text", "ids", "decoded")
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_sentencepiece_matches_its_library(spark, docs, rows):
    import sentencepiece

    from resight.llm.sentencepiece import decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = docs.select("doc_id", "text", "id").union(spark.createDataFrame([(1000 + i, t, "odd") for i, t in enumerate(TEXTS)]))
    coded = encode(docs, path)
    got = decode(coded, path, keep=("id", "text", "ids")).collect()
    assert len(got) == len(rows) + len(TEXTS)
    for r in got:
        assert list(r.ids) == lib.encode(r.text or "")
        assert r.decoded == (r.text or "")


def test_streaming_is_bounded_and_equal():
    import sentencepiece

    from resight.llm.sentencepiece import Vocabulary, stream_ids

    path = public_tokenizers.path("piece_bpe_32k.model")
    v, lib = Vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    text = " " + "".join(r.choice("abcdefgh 12éй") for _ in range(5000))
    made = stream_ids(v, text.encode(), {})
    assert list(made) == lib.encode(text[1:])


def test_html():
    from resight.llm.html_text import main_text

    long = "This is the text of the page and it is long enough to be taken as an article by the rules, as there are so many of the stop words in it that it is not to be missed at all by any of them."
    assert main_text(None) == main_text("") == main_text("<!-- <p>no</p>") == ""
    page = f"""<html><head><title>T</title><style>p{{}}</style><script>var a="<p>{long}</p>";</script></head><body>
      <nav><ul><li><a href=/>Home page</a></ul></nav><div class="cookie-notice"><p>{long}</div><!-- {long} -->
      <article><h1>Head &amp; line</h1><p>{long}&nbsp;&lt;b&gt;<br>More<p>Short.<div class=ad>{long}</div><aside>{long}</aside><form>{long}</form></article>
      <section id="comments"><p>{long}</p></section><footer>&copy; {long}</footer>"""
    assert main_text(page) == f"Head & line\n{long} <b> More\nShort."
    bare = f"<div class=menu><a href=x>Home</a></div><div><p>{long} {long}</p><p>Short one.</p></div><div class='comments'><p>{long}</p></div>"
    assert main_text(bare) == f"{long} {long}\nShort one."
    assert main_text("<p>" + "<b>" * 5000 + "x") in ("", "x")
    assert main_text("<" * 20000) == main_text("<a title='" * 2000) == ""


SPOKEN = {
    "en": "the of and to in is that for it was with as his on be at by had not are but from or have".split(),
    "fi": "talo metsä järvi kulkea pitkin rantaa aamulla linnut lauloivat kauniisti hiljaa tuuli puhalsi vuoren yli kohti merta".split(),
    "ja": "山道を 登りながら こう 考えた 智に 働けば 角が 立つ 情に 棹させば 流される 意地を 通せば 窮屈だ".split(),
}


def made_page(r, lang, marked):
    """A page put together from parts, and its article's text."""
    say = lambda k: " ".join(r.choice(SPOKEN[lang]) for _ in range(k)) + "."
    links = lambda k: "".join(f'<li><a href="/{i}">{say(3)}</a></li>' for i in range(k))
    noise = [
        f"<nav><ul>{links(6)}</ul></nav>", f'<div class="sidebar">{say(40)}</div>', f'<div id="cookie-notice"><p>{say(50)}</p></div>', f"<form><p>{say(30)}</p><input></form>",
        f'<div class="ad-box"><p>{say(45)}</p></div>', f"<script>var x = '<p>{say(40)}</p>';</script>", f"<style>p {{}} {say(40)}</style>", f"<!-- <p>{say(60)}</p> -->", f"<ul>{links(9)}</ul>",
    ]
    r.shuffle(noise)
    paragraphs = [say(r.randint(50, 90)) for _ in range(r.randint(3, 6))]
    body = "".join(f"<p>{p.replace('.', '&#46;') if r.random() < .2 else p}</p>" for p in paragraphs)
    k = r.randrange(1, len(paragraphs))
    # a tag that is never closed inside the article
    body = body.replace("</p>", f"</p><{r.choice(['svg', 'select', 'canvas', 'video', 'object', 'math', 'audio'])}>", k).replace("<p>", "<p>", 1) if r.random() < .3 else body
    tag = "article" if marked else "div"
    page = f"<html><head><title>{say(4)}</title></head><body>{''.join(noise[:4])}<{tag}>{body}</{tag}>{''.join(noise[4:])}<section class='comments'><p>{say(60)}</p></section><footer><p>© {say(30)}</p></footer></body></html>"
    return page, "\n".join(paragraphs)


@pytest.mark.parametrize("lang", sorted(SPOKEN))
def test_html_of_made_pages(lang):
    """What a page was put together from comes back, in languages with and without a list of stop words."""
    from resight.llm.html_text import main_text

    r = random.Random(7)
    for i in range(120):
        page, want = made_page(r, lang, i % 2 == 0)
        assert main_text(page) == want


def test_html_rows(spark):
    from resight.llm.html_text import extract

    p = "It is the case that a page of the site has to have a text that is long enough to be an article for all of the readers of it."
    df = spark.createDataFrame([(1, "u", f"<article><p>{p}"), (2, None, None), (1, "u", f"<article><p>{p}")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect())
    assert got == [(1, "u", p, len(p)), (1, "u", p, len(p)), (2, None, "", 0)]


def test_passages(spark, rows):
    from resight.llm.substring_dedup import repeated_passages

    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(5000)]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k))
    shared, near = prose(60), prose(90)
    edited = near.split()
    edited[40] = "changed"
    data = [(i, prose(200)) for i in range(20)]
    data += [(i, f"{prose(30 + i)} {shared} {prose(40)}") for i in range(20, 26)]
    data += [(30, f"{prose(10)} {near} {prose(99)}"), (31, f"{prose(77)} {' '.join(edited)} {prose(5)}"), (32, data[0][1]), (33, data[0][1]), (34, None), (35, ""), (None, shared), (36, prose(20)), (36, prose(20))]
    got = repeated_passages(frame(spark, data)).collect()
    assert {x.id for x in got} == {*range(20, 26), 30, 31, 0, 32, 33}
    text = dict(x for x in data if x[0] is not None)
    for x in got:
        a, b = words(text[x.id])[x.start : x.end], words(text[x.partner])[x.partner_start : x.partner_end]
        assert min(len(a), len(b)) >= 50
        if x.id in range(20, 26):
            assert " ".join(a) == " ".join(b) and shared in " ".join(a)
    assert {(x.end - x.start) for x in got if x.id == 30} == {90}
    assert repeated_passages(frame(spark, [])).count() == 0


def test_passages_against_all_pairs(spark):
    """Every pair of texts with a similar stretch of fifty words, found by comparing all slices, against what comes back."""
    from resight.llm.substring_dedup import repeated_passages

    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    prose = lambda k: r.choices(vocabulary, k=k)

    def edited(w, k):
        w = list(w)
        for _ in range(k):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        return w

    data = {i: prose(r.randint(60, 150)) for i in range(60)}
    for i in range(60, 110, 2):
        passage = prose(r.randint(52, 90))
        data[i] = prose(r.randint(0, 60)) + edited(passage, r.randint(0, 1)) + prose(30)
        data[i + 1] = prose(r.randint(0, 60)) + edited(passage, r.randint(0, 1)) + prose(10)
    hot = prose(70)
    for i in range(110, 150):
        data[i] = prose(r.randint(0, 40)) + edited(hot, r.randint(0, 3)) + prose(r.randint(0, 40))
    # a phrase too short to count in many of them
    phrase = prose(20)
    for i in range(150, 200):
        data[i] = prose(40) + phrase + prose(40)
    grams_of = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, w in data.items()}

    def alike(a, b):
        """Whether some stretch of 46 tokens of a has one of b, up to eight tokens longer or shorter, with similarity .8."""
        x, y = grams_of[a], grams_of[b]
        if len(set(x) & set(y)) < 36:
            return False
        for k in range(len(x) - 45):
            u = set(x[k : k + 46])
            for m in range(len(y) - 45):
                v = set(y[m : m + 46])
                both = len(u & v)
                if 100 * both >= 80 * (len(u) + len(v) - both):
                    return True
        return False

    wanted = {(a, b) for a in data for b in data if a < b and alike(a, b)}
    got = repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in data.items()])).collect()
    docs = {i for pair in wanted for i in pair}
    found = {x.id for x in got}
    print("documents", len(docs), "found", len(docs & found), "more", len(found - docs))
    assert len(wanted) > 300 and len(docs & found) >= 0.97 * len(docs)
    # what is reported is similar
    for x in got:
        u, v = (set(tuple(data[i][k : k + 5]) for k in range(s, e - 4)) for i, s, e in ((x.id, x.start, x.end), (x.partner, x.partner_start, x.partner_end)))
        assert min(x.end - x.start, x.partner_end - x.partner_start) >= 50 and 100 * len(u & v) >= 80 * len(u | v)
    assert not found & set(range(150, 200)) - docs


def test_passages_of_an_id_with_several_texts(spark):
    from resight.llm.substring_dedup import repeated_passages

    r = random.Random(2)
    p, q = (" ".join(r.choices([f"v{i}" for i in range(3000)], k=70)) for _ in range(2))
    data = [(1, f"{p} a b c"), (1, f"x y {q}"), (2, f"k {p}"), (3, q + " l"), (1, f"{p} a b c"), (4, f"{p} m"), (4, f"n {p}")]
    got = {(x.id, x.partner) for x in repeated_passages(frame(spark, data)).collect()}
    # both texts of id 1 are searched; of the four with p each gets some partner
    assert {(1, 3), (3, 1)} <= got and all(a != b for a, b in got) and {a for a, _ in got} == {1, 2, 3, 4} and {b for a, b in got if a == 2} <= {1, 4}


def test_passages_of_a_star(spark):
    """Variants around an original whose id lies in the middle: alike to it, not to each other."""
    from resight.llm.substring_dedup import repeated_passages

    base = [f"b{i}" for i in range(300)]

    def variant(i, offset):
        return i, " ".join(f"n{i}x{k}" if k % 50 == offset else x for k, x in enumerate(base))

    data = [variant(1, 2), variant(2, 12), variant(3, 22), (4, " ".join(base)), variant(5, 32), variant(6, 42)]
    got = {(x.id, x.partner) for x in repeated_passages(frame(spark, data)).collect()}
    assert got == {p for i in (1, 2, 3, 5, 6) for p in ((i, 4), (4, i))}


def test_similar_stretches():
    from resight.llm.substring_dedup import passages

    n = iter(range(10000, 20000))

    def tokens(w):
        return np.array([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)])

    base = list(range(90))
    longer = base[:45] + [next(n) for _ in range(8)] + base[45:]
    assert passages(tokens(base), tokens(longer), 46, 80, 100, 12) == [(0, 86, 0, 94)]
    base = list(range(200))
    other = [next(n) if k in (40, 80) or k >= 120 and k % 8 == 0 else k for k in base]
    (xs, xe, ys, ye), = passages(tokens(base), tokens(other), 46, 80, 100, 12)
    x, y = set(tokens(base)[xs:xe].tolist()), set(tokens(other)[ys:ye].tolist())
    assert xs == ys == 0 and xe >= 115 and 100 * len(x & y) >= 80 * len(x | y)


def test_compact_windows():
    from resight.llm.substring_dedup import windows

    r = np.random.default_rng(0)
    for n, least in ((200, 5), (50, 46), (300, 20), (64, 64), (30, 46)):
        v = r.integers(0, n, n).astype(np.uint64)
        cut = n // 3
        lo, hi = np.zeros(n, np.int64), np.full(n, cut, np.int64)
        lo[cut:], hi[cut:] = cut, n
        want = set()
        for c in range(n):
            a, b = c, c
            while a > lo[c] and v[a - 1] > v[c]:
                a -= 1
            while b + 1 < hi[c] and v[b + 1] >= v[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((a, c, b))
        assert set(zip(*(x.tolist() for x in windows(v, lo, hi, least)))) == want


def test_top_k(spark):
    from resight.llm.topk import exact_top_k

    r = np.random.default_rng(1)
    vectors = [(i, r.normal(size=16).astype(np.float32).tolist()) for i in range(700)]
    vectors += [(700 + i, vectors[3][1]) for i in range(250)]
    df = spark.createDataFrame([*vectors, (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 16), (2003, [float("inf")] * 16), (None, vectors[0][1]), (2050, [1.0])], "vec_id long, embedding array<float>").withColumn("id", F.lit(0))
    whole = {i: np.floor(256 * np.array(x, np.float32).astype(float)) for i, x in vectors} | {2050: np.array([256.0] + [0.0] * 15)}
    want = []
    for q in whole:
        if q % 50 == 0:
            best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(x) for x in exact_top_k(df).collect()) == sorted(want)
    assert exact_top_k(df.limit(0)).count() == 0
    assert exact_top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def plain_kneser_ney(tok, learn):
    count = collections.Counter(x for i in learn for x in tok[i])
    pairs = collections.Counter(p for i in learn for p in zip(["<s>", *tok[i]], tok[i]))

    def discounts(values):
        n = [max(1, sum(v == k for v in values)) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)]

    kept = collections.Counter(w for _, w in pairs)
    high, low = discounts(pairs.values()), discounts(kept.values())
    rest = sum(low[min(v, 3)] for v in kept.values()) / len(pairs)
    seen, mass = collections.Counter(), collections.Counter()
    for (u, _), k in pairs.items():
        seen[u] += k
        mass[u] += high[min(k, 3)]

    def below(w):
        return max(kept[w] - low[min(kept[w], 3)], 0) / len(pairs) + rest / (len(count) + 1)

    def p(u, w):
        k = pairs[u, w]
        return (max(k - high[min(k, 3)], 0) + mass[u] * below(w)) / seen[u] if seen[u] else below(w)

    return count, p


def test_kneser_ney(docs, rows, none):
    from resight.llm.kneser_ney import lm_scores

    tok = {n: [*words(t), "</s>"] for n, (_, t) in enumerate(rows)}
    held = {n: i is None or zlib.crc32(str(i).encode()) % 10 == 0 for n, (i, _) in enumerate(rows)}
    count, p = plain_kneser_ney(tok, [n for n in tok if not held[n]])
    total, v = sum(count.values()), len(count)
    assert abs(sum(p("</s>", w) for w in count) + p("</s>", "?") - 1) < 1e-9
    got = {r.id: r for r in lm_scores(docs).collect()}
    for n, (i, _) in enumerate(rows):
        r, x = got[i], tok[n]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[n], len(x), sum(count[w] > 0 for w in x), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in x), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["<s>", *x], x)), rel=1e-5)
    assert lm_scores(none).count() == 0


def test_token_store(spark, docs, rows, none, tmp_path):
    from tokenizers import Tokenizer

    from resight.llm.token_store import read_tokens, token_index, write_tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"{tmp_path}/ids"
    extra = [(5000 + i, t) for i, t in enumerate([*TEXTS, "It's <|endoftext|>x <|ENDOFTEXT|> ÉCOLE Ω \u00a0 e\u0301"])]
    df = docs.select("doc_id", "text", "id").union(spark.createDataFrame([(i, t, "odd") for i, t in extra]))
    write_tokens(df, folder, path)
    lib = Tokenizer.from_file(path)
    data = sorted([*rows, *extra], key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t in data:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_index(spark, folder).collect()), key=lambda r: r[1]) == want
    assert {r.doc_id for r in read_tokens(spark, folder, ids=[5, 110]).collect()} == {5, 110}
    few = read_tokens(spark, folder, low=100, high=103)
    assert few.count() == 4 and "PushedFilters: [" in few._jdf.queryExecution().toString()
    write_tokens(none, f"{tmp_path}/no", path)
    assert token_index(spark, f"{tmp_path}/no").count() == 0


@pytest.mark.parametrize("others", [0, 200])
def test_windows_meet_whatever_the_size_of_their_class(spark, others):
    """Two windows that agree on the token next to the minimum alone meet, among many of their kind too."""
    from resight.llm.substring_dedup import BESIDE, _in_classes

    # the tokens further off, where they are kept, and the one behind are each window's own
    layout = [5 if d == BESIDE[0] else None for d in BESIDE]
    rows = [(7, i, i << 3, 0, sum((i + 100 * k if t is None else t) << 16 * (len(layout) - 1 - k) for k, t in enumerate(layout))) for i in range(1, 3 + others)]
    found = spark.createDataFrame(rows, "value long, id long, cf long, win long, beside long")
    met = {(r.id, r.id2) for r in _in_classes(found.where("id = 1"), found).collect()}
    assert met == {(1, i) for i in range(2, 3 + others)}


def test_nodes_are_compared_in_runs(monkeypatch):
    """A run is bounded by its members, and runs give the pairs that the whole batch gives."""
    import pyarrow as pa

    from resight.llm import near_dedup as N

    r = random.Random(4)
    kinds = [bytes([k]) * N._WIDTH for k in range(3)]
    nodes = [[{"rep": r.randrange(10**6), "n": 5, "sketch": r.choice(kinds)} for _ in range(r.randint(2, 6))] for _ in range(60)]
    kind = pa.list_(pa.struct([("rep", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array(nodes, kind)], ["members"])
    pairs = lambda parts: sorted((x["a"], x["b"]) for p in parts for x in p.to_pylist())
    want = pairs(N._compare(0.8, 0.8)([batch]))
    monkeypatch.setattr(N, "PORTION", 10)
    parts = list(N._compare(0.8, 0.8)([batch.slice(0, 7), batch.slice(7)]))
    assert len(parts) > 20 and len(want) > 20 and pairs(parts) == want


def test_long_sets_share_no_token_by_chance():
    """Unlike sets of many shingles: the least values are small numbers, what is kept of them is not."""
    from resight.llm import near_dedup as N

    r = np.random.default_rng(6)
    sets = [np.sort(r.integers(0, 1 << 64, 20_000, dtype=np.uint64)) for _ in range(200)]
    tokens = np.ascontiguousarray(N._sketch(sets)[:, : 4 * N.SKETCH]).view("<u4")
    assert all(len(np.unique(tokens[:, k])) == len(sets) for k in range(N.SKETCH))


def test_walks_reach_what_branching_reaches():
    import pyarrow as pa

    from resight.llm import near_dedup as N

    class Shared:
        def __init__(self, value):
            self.value = value

    r = np.random.default_rng(7)
    sketch = r.integers(0, 256, (50, 4 * N.SKETCH + N.MORE), dtype=np.uint8)
    binary = lambda rep: pa.array([sketch[i].tobytes() for i in rep], pa.binary())
    sets = pa.RecordBatch.from_arrays([pa.array(np.arange(50)), pa.array(np.arange(50) * 3), binary(range(50))], ["rep", "n", "sketch"])
    level, tables = sets, []
    for depth in range(3):
        (level,) = N._branch(depth, N.TREES, 0.8)([level])
        (got,) = N._walk([Shared(t) for t in tables], N.TREES, 0.8)([sets])
        key = lambda b: sorted(zip(b.column("node").to_pylist(), b.column("rep").to_pylist()))
        assert key(got) == key(level) and got.column("n").to_pylist() == [3 * x for x in got.column("rep").to_pylist()]
        # every other set's nodes branch
        on = np.zeros(1 << 20, bool)
        keep = level.column("rep").to_numpy() % 2 == 0
        at = N._bucket(level.column("node").to_numpy().view(np.uint64), 20)
        on[at[keep]] = True
        tables.append(np.packbits(on, bitorder="little"))
        level = level.filter(pa.array(on[at]))
        level = level.append_column("sketch", binary(level.column("rep").to_pylist()))


def test_table_of_nodes(spark):
    from resight.llm import near_dedup as N

    nodes = np.random.default_rng(8).integers(-(1 << 63), 1 << 63, 3000)
    table = N._table(spark.createDataFrame([(int(x),) for x in nodes], "node long"))
    on = np.flatnonzero(np.unpackbits(table, bitorder="little"))
    assert on.tolist() == sorted(set(N._bucket(nodes.view(np.uint64), len(table).bit_length() + 2).tolist()))


def test_nodes_parted_by_size():
    """Runs hold every pair whose sizes are within reach, and no set that is alone."""
    import pyarrow as pa

    from resight.llm import near_dedup as N

    r = random.Random(9)
    nodes = [sorted((r.choice([3, 5, 10, 11, 12, 40, 41, 300]), 100 * i + k) for k in range(r.randint(1, 7))) for i in range(80)]
    kind = pa.list_(pa.struct([("n", pa.int64()), ("rep", pa.int64())]))
    held = pa.array([[{"n": n, "rep": x} for n, x in m] for m in [[(1, -1)], *nodes]], kind).slice(1)
    got = [x for p in N._by_size(0.8)([pa.RecordBatch.from_arrays([held], ["held"])]) for x in p.column("held").to_pylist()]
    near = {(x, y) for m in nodes for n, x in m for k, y in m if x < y and min(n, k) >= 0.8 * max(n, k)}
    assert near <= {(min(x, y), max(x, y)) for m in got for x in m for y in m} and all(len(m) > 1 for m in got)
    assert sum(map(len, got)) == len({x for m in got for x in m}) < sum(map(len, nodes))


def test_sketches_are_written_once(spark, monkeypatch):
    """Copies and texts of unlike size: the sketches are settled in one table, and rows that go by node have a size and no sketch."""
    from resight.llm import near_dedup as N

    written, settle = [], N.settle
    monkeypatch.setattr(N, "settle", lambda df: written.append(df.columns) or settle(df))
    rows = [(1, " ".join(f"a{k}" for k in range(60))), (2, " ".join(f"a{k}" for k in range(61))), (3, "b c d e f g"), (4, "b c d e f g"), (4, "b c d e f g")]
    got = sorted((r.id, r.component_id) for r in N.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    assert sum("sketch" in c for c in written) == 1


def test_runs_of_windows_meet_as_one(spark):
    """A word said again and again has a window at each place; two such texts meet in a few rows, which cover what all windows would."""
    from resight.llm.substring_dedup import NEED, _in_classes, _lined, stretches

    def run(i, f, first, n, end, before):
        token = 7 << 16 | 7
        return [(90 + f, i, c << 3 | f, (before if c == first else 0) << 32 | (end - c), token if c > first else i << 16 | i) for c in range(first, first + n)]

    texts = {1: (20, 60, 130, 12), 2: (5, 45, 95, 3), 3: (200, 50, 249, 0)}
    rows = [x for i, (first, n, end, before) in texts.items() for f in range(3) for x in run(i, f, first + f, n, end, before)]
    found = spark.createDataFrame(rows, "value long, id long, cf long, win long, beside long")
    met = _in_classes(found, found)
    lined = [tuple(r) for r in _lined(met).collect()]
    assert 0 < len(lined) <= 3 * 3 * 2 * 4
    alone = []
    for value, i, cf, win, beside in rows:
        for v, k, cg, wing, beside2 in rows:
            if value == v and i < k and (beside >> 16 == beside2 >> 16 or beside & 65535 == beside2 & 65535):
                a, b = cf >> 3, cg >> 3
                low, high = 1 << 32, (1 << 32) - 1
                alone.append((i, k, (a - min(win // low, wing // low)) << 3 | cf & 7, a + min(win & high, wing & high), b - a, b - a))

    def swept(x):
        p, q, fl, hi, o, most = np.array(sorted(x)).T
        group, *rest = stretches(p * 10 + q, fl & 7, fl >> 3, hi, o, most)
        return sorted(zip(group.tolist(), *(y.tolist() for y in rest)))

    assert NEED == 2 and swept(lined) == swept(alone) and len(alone) > 10_000


def test_passages_in_portions(spark, monkeypatch):
    """What meets, and what is verified, in many portions gives the rows that one gives."""
    from resight.llm import substring_dedup as S

    r = random.Random(5)
    prose = lambda k: [f"v{r.randrange(3000)}" for _ in range(k)]
    rows = [(i, " ".join(prose(9) + ["the"] * r.randint(20, 160) + prose(9) + [f"w{i % 3}"] * r.randint(20, 160))) for i in range(14)]
    rows += [(20 + i, " ".join(f"n{i}x{k}" if k % 50 == 9 * i else f"b{k}" for k in range(300))) for i in range(5)]
    parts = []
    meeting = S._meeting
    monkeypatch.setattr(S, "_meeting", lambda mine, dealt, k, n: parts.append(n) or meeting(mine, dealt, k, n))
    want = sorted(S.repeated_passages(frame(spark, rows)).collect())
    assert parts == [1] and len(want) > 20
    monkeypatch.setattr(S, "MEETS", 60)
    monkeypatch.setattr(S, "TOKENS", 9000)
    assert sorted(S.repeated_passages(frame(spark, rows)).collect()) == want and len(parts) > 2


def test_chains_through_repeated_words():
    """Of several places the nearest to where the chain goes on is taken, the first of two as near."""
    from resight.llm.substring_dedup import passages

    run = np.array([5] * 60)
    assert passages(run, run[:50], 46, 80, 100, 12) == [(0, 50, 0, 50)]
    assert passages(np.r_[np.arange(100, 130), run[:20]], run, 46, 80, 100, 12) == []
    block = np.tile(np.arange(6), 10)
    # the first token goes to the place nearest to its own
    assert passages(np.r_[[77] * 4, block], block, 46, 80, 100, 12) == [(4, 58, 6, 60)]
