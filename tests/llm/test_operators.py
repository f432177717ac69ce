"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables
with nulls, empty and long texts, ties, repeated rows, no rows, and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from lambdalake.llm import bpe, components, html, language, lines, media, packing, quality, scoring, simhash, suffix, trie
from lambdalake.llm import kernels as K

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, key int, __n int"
WORD, LOWER = re.compile(rb"[^\x20\x09-\x0D]+"), bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(n, seed, pool=200):
    rng = random.Random(seed)
    own = ["".join(random.Random(f"{seed % 3} {i}").choices("abcdefghijkl", k=3 + i % 7)) for i in range(pool)]
    return " ".join(rng.choice(own) for _ in range(n))


def sample_texts():
    base = words(120, 1)
    passage = words(60, 2)
    texts = [None, "", " ", "\n\n", "a", "Zwölf Boxkämpfer 漢字 😀 it's   we'll\n\n x", base, base, base + " tail", base.replace("a", "é"), "ab " * 400, "x" * 3000]
    texts += [words(90, 10 + i) + "\n" + passage + "\n" + words(70, 40 + i) for i in range(4)]
    texts += [words(200, 100 + i).capitalize() + ".\nSame line everywhere.\n" + words(60, 200 + i) for i in range(14)]
    texts += ["THE!! ONE!! " * 40, "a | b | c | " * 60, words(4000, 7)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 4 else ("en", "de")[i % 2], None if i == 7 else f"s{i % 12}", len(t or ""), "x", 1, 2) for i, t in enumerate(sample_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(sample_texts()))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i not in (26, 27)), 0) for i in range(12, 28)], "doc_id long, quality int, toxic int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark, docs, labels):
    none, no_labels = docs.limit(0), labels.limit(0)
    chain = quality.fit(none, no_labels)
    for out in (
        bpe.digests(none, RANKS), language.report(none), suffix.report(none), simhash.report(none), lines.report(none), media.columns(none), scoring.score(none),
        quality.judge(none, chain), packing.pack(none, RANKS), suffix.strip(none), lines.dedup(none), simhash.dedup(none), quality.keep(none, chain),
        html.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def test_stages_keep_columns(docs, labels):
    chain = quality.fit(docs, labels)
    for out in (quality.keep(docs, chain), lines.dedup(docs), simhash.dedup(docs), suffix.strip(docs)):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and out.count() > 0


def test_repeated_ids_and_clashing_columns(spark, labels):
    """Rows that share an id are told apart, equal rows give equal results, and columns of any name do not matter."""
    texts = [words(70, 1), words(70, 2), words(70, 1), None, "", words(3000, 3), words(70, 1)]
    ids = [1, 1, 1, 2, 2, 3, 4]
    names = ["ids", "fp", "node", "block", "row", "media", "n", "key", "bits", "spans", "word", "data"]
    docs = spark.createDataFrame([(i, t, "en", "s", *["x"] * len(names)) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} string" for x in names)).repartition(3)
    alone = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    chain = quality.fit(docs, labels)
    assert sorted(r.doc_id for r in simhash.report(docs).collect()) == sorted(ids) and sorted(r.doc_id for r in lines.report(docs).collect()) == sorted(ids)
    for make in (lambda d: bpe.digests(d, RANKS), media.columns, lambda d: quality.judge(d, chain), lambda d: simhash.fingerprints(d)):
        plain = lambda rows: sorted(str([r[c] for c in rows[0].asDict() if c != "doc_id"]) for r in rows)
        got, want = make(docs).collect(), make(alone).collect()
        assert sorted(r.doc_id for r in got) == sorted(ids) and plain(got) == plain(want)
    assert sorted(r.doc_id for r in language.report(docs).collect()) == sorted(ids)
    same_scores(scoring.score(docs).where("doc_id in (3, 4)").collect(), lm_scores_of(list(zip(ids, texts))))
    pieces = packing.pack(docs, RANKS).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in pieces} == {i: sum(len(bpe.vocabulary(RANKS).encode(*K.as_bytes(pa.array([t or ""])))[0]) + 1 for j, t in zip(ids, texts) if i == j) for i in ids}


# 1


def test_bpe_equals_library(docs, texts):
    vocab = bpe.vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    got = by_id(bpe.digests(docs, RANKS))
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, RANKS).collect()}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    for i, t in texts.items():
        want = library.encode_ordinary(t or "")
        assert ids[i] == want and got[i].n_tokens == len(want) and back[i] == (t or "").encode()
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_random_texts():
    vocab, rng = bpe.vocabulary(RANKS), random.Random(3)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    parts = ["a", "b", "'s", "'ll", "'", "'re", " ", "  ", "\n", "\t", "é", "1", "²", "!", "??", " ", "　", "😀", "Z", "'t", "\r\n", "\x1c", " ", "ß", "가", "٣", "'ve", "'d", "\x85", "the", "<|endoftext|>"]
    many = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    batch = pa.record_batch([pa.array(many)], ["text"])
    for part, data, offsets in K.slices(batch, most=5000):
        ids, ends = vocab.encode(data, offsets)
        for k, t in enumerate(part.column(0).to_pylist()):
            assert ids[ends[k] : ends[k + 1]].tolist() == library.encode_ordinary(t)
    for piece in (b"unbelievably", b"zzzzqqq", bytes(range(90)), b"ab" * 200):
        one = np.frombuffer(piece, np.uint8)
        assert vocab.merge(piece) == vocab.merged(one, np.array([0]), np.array([len(piece)]))[0].tolist()


def test_bpe_words_that_share_a_polynomial_hash():
    vocab = bpe.vocabulary(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    whole = thue_morse(2048)
    text = f"{whole[:1024]}\n{whole[1024:]}"
    for part, data, offsets in K.slices(pa.record_batch([pa.array([text, text[::-1], whole])], ["text"])):
        ids, ends = vocab.encode(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode_ordinary(t) for t in part.column(0).to_pylist()]


def test_bpe_heaps():
    vocab, rng = bpe.vocabulary(RANKS), random.Random(9)
    pieces = [bytes(rng.choices(b"etaoinshr lzq" if k % 2 else range(256), k=rng.randint(2, 64))) for k in range(800)]
    size = np.array([len(p) for p in pieces])
    ids, counts = vocab.merged(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size)
    ends = np.cumsum(counts)
    assert [ids[e - c : e].tolist() for e, c in zip(ends, counts)] == [vocab.merge(p) for p in pieces]


def test_perfect_hash():
    keys = K.mix(np.arange(1, 5001, dtype=np.uint64))
    table = bpe.PerfectHash(keys, np.arange(5000))
    assert (table.get(keys) == np.arange(5000)).all() and sorted(table.slot(keys).tolist()) == list(range(5000))
    assert (table.get(K.mix(np.arange(6000, 7000, dtype=np.uint64))) == -1).all()


# 2

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div id="cookie-notice">We use cookies on this site, accept them all.</div><main><article><header><h1>Title &amp; more</h1></header><p>First&nbsp;para <a href="y">link</a> goes
on<br>here &#228;.</p><ul><li>one<li>two</ul><aside>Related things to see, many of them.</aside><div class="ad">Buy now.</div><p><b>Short.</article>
<section id="comments"><article class="comment"><p>Great post, I liked it a lot, really very much.</p></article></section></main><form><label>Name</label></form>
<footer>&copy; all of it</footer><script>if(a<b){"<p>no</p>"}</script><!-- <p>gone</p> --></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "<p>Only this paragraph stands here, and it is long enough."), (4, "u", "no tags at all, but quite a few words of text.")], "page_id long, url string, html string")
    got = html.extract(pages).collect()
    assert got[0].text == "Title & more\nFirst para link goes on here ä.\none\ntwo\nShort." and got[0].n_chars == len(got[0].text)
    assert [r.text for r in got[1:3]] == ["", ""] and got[3].text.startswith("Only this") and got[4].text.startswith("no tags")


class Tree(HTMLParser):
    """Blocks of a well-formed page with the open elements around each: an own reading, by the library's parser."""

    def __init__(self, text):
        super().__init__(convert_charrefs=True)
        self.open, self.found, self.parts, self.count, self.linked = [("", {}, 0)], [], [], 0, 0
        self.feed(text)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, list(self.open), self.linked))
        self.parts, self.linked = [], 0

    def breaks(self, tag, attrs):
        return tag in html.BLOCKS or "class" in attrs

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.breaks(tag, attrs):
            self.flush()
        self.count += 1
        self.open.append((tag, attrs, self.count))

    def handle_endtag(self, tag):
        if self.breaks(*self.open[-1][:2]):
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        self.parts.append(data)
        self.linked += len(data) * any(x[0] == "a" for x in self.open)


def brute_text(page, weights):
    """The cheapest labelling of all, the one with the least content of equals."""
    kinds, costs, paths, tags, prose = [], [], [], [], []
    found = Tree(page).found
    for text, around, linked in found:
        classes = [x[1].get("class", "") for x in around]
        bad = any(x[0] in ("nav", "footer", "aside", "form") for x in around) + 2 * any(c in ("ad", "comments", "cookie-notice") for c in classes)
        article = any(x[0] in ("article", "main") for x in around)
        soft, loose = "related-work" in classes, "notice" in classes
        kinds.append(1 if article and not bad and not soft and not loose else 0)
        boxes = [x for x in around if x[0] in html.BLOCKS or "class" in x[1] or not x[0]]
        tag, n = boxes[-1][0], len(text)
        on = [True, n < 25, n >= 80, n >= 200, text[-1] in ".!?", tag == "p", tag == "h1", tag == "li", 2 * linked > n, 5 * linked > n]
        score = max(-html.MOST, min(html.MOST, sum(w for w, x in zip(weights, on) if x)))
        alone = linked >= n and n < 200 and tag not in ("p", "h1", "li")
        costs.append((score, article, bad, soft, loose, alone))
        paths.append([x[2] for x in boxes])
        tags.append(tag)
        prose.append(n if n >= 25 and 2 * linked <= n and not bad and not loose else 0)
    out = [False] * len(found)
    if not any(kinds) and any(prose):
        # Every box that has three quarters of the prose of the blocks in it; the deepest is the longest path.
        within = lambda box, path: path[: len(box)] == box
        boxes = [p[:k] for p in paths for k in range(1, len(p) + 1)]
        inner = lambda p: p[:-1] or p
        box = max((b for b in boxes if 4 * sum(n for n, p in zip(prose, paths) if within(b, inner(p))) >= 3 * sum(prose)), key=len)
        out = [not within(box, p) for p in paths]
        begin = out.index(False)
        title = [j for j in range(begin) if tags[j] == "h1"][-1:]
        for j in range(title[0] if title else begin, begin):
            out[j] = False
    costs = [round(100 * (s + (html.IN_ARTICLE if a else html.ELSEWHERE if any(kinds) else 0) + html.IN_NAVIGATION * (b & 1) + html.IN_HINTED * (b >> 1) + html.IN_SOFT * q + html.IN_LOOSE * l + html.ONE_LINK * x + html.OUTSIDE * o)) for (s, a, b, q, l, x), o in zip(costs, out)]
    ties = []
    for j in range(len(found)):
        near = {j - 1} if j else set()
        near |= {max([i for i in range(j) if paths[i][:-1][-1:] == paths[j][:-1][-1:]], default=j - 1)} if j else set()
        for i in near:
            shared = sum(x == y for x, y in zip(paths[i], paths[j]))
            ties.append((i, j, round(100 * html.TIE / (1 + len(paths[i]) + len(paths[j]) - 2 * shared))))
    price = lambda keep: sum(max(c, 0) for c, k in zip(costs, keep) if not k) + sum(max(-c, 0) for c, k in zip(costs, keep) if k) + sum(w for a, b, w in ties if keep[a] != keep[b])
    keep = min(([bool(m >> i & 1) for i in range(len(found))] for m in range(1 << len(found))), key=lambda k: (price(k), sum(k)))
    return "\n".join(t for (t, _, _), k in zip(found, keep) if k), sum(k != (c > 0) for k, c in zip(keep, costs))


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 3)):
        text = words(rng.choice([1, 2, 9, 30, 60]), rng.randint(0, 99)) + rng.choice([".", "", " &amp; so on."])
        kind = rng.choice(["p", "p", "p", "div", "h1", "li", "nav", "article", "main", "footer", "ad", "soft", "span", "a", "notice", "only"])
        inner = random_page(rng, depth + 1) if depth < 2 and kind in ("div", "article", "main", "ad") and rng.random() < 0.7 else text
        out += {"notice": f'<p class="notice">{text}</p>', "only": f'<div><a href="x">{text}</a></div>', "ad": f'<div class="ad">{inner}</div>', "soft": f'<p class="related-work">{text}</p>', "a": f'<p>{text} <a href="x">more of it</a></p>',
                "span": f'<p>{text} <span class="ad">Buy <span>now</span> or later</span> {text}</p>'}.get(kind, f"<{kind}>{inner}</{kind}>")
    return out


@pytest.mark.parametrize("weights", [html.PRIOR, (0.2, -2.5, 0.4, 0.3, 0.7, 1.1, 0.1, -0.5, -2.0, -0.7)])
def test_html_is_cheapest_labelling(weights):
    rng, changed = random.Random(11), 0
    pages = [p for p in (random_page(rng) for _ in range(400)) if 0 < len(Tree(p).found) <= 11]
    assert len(pages) > 200
    for page in pages:
        want, moved = brute_text(page, weights)
        assert html.main_text(page, weights) == want, page
        changed += moved
    assert changed > 50  # labels that the cut gives against the sign of their cost


def test_html_fit(spark):
    good, bad = (f"<p>{words(40, i)}.</p>" for i in range(1)), "<li><a href=x>Home</a></li>"
    rows = [(i, "u", f"<nav><ul>{bad * 4}</ul></nav><article><h1>Title {i}</h1>{''.join(good) or f'<p>{words(40, i)}.</p>'}<p>Short.</p></article><div class=ad>Buy now.</div>") for i in range(40)]
    pages = spark.createDataFrame([*rows, rows[0], (99, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    weights = html.fit(pages)
    assert weights != html.PRIOR and weights == html.fit(pages.repartition(3)) and html.fit(pages.limit(0)) == html.PRIOR
    plain = rows[1][2].replace("article", "div").replace("nav>", "div>")
    assert html.main_text(plain, weights).startswith("Title 1\n") and "Home" not in html.main_text(plain, weights)
    assert len(html.extract(pages, weights).collect()) == 42


LONG = "This is a long enough paragraph of the article, which says a good deal about its subject and then goes on to say more."


@pytest.mark.parametrize(
    "part, kept",
    [
        (f'<p class="notice">{LONG} X.</p>', True),
        (f'<div class="legal">{LONG} X.</div>', True),
        (f'<h2 class="copyright">{LONG} X.</h2>', True),
        (f'<section id="search"><p>{LONG} X.</p><p>{LONG} X.</p></section>', True),
        ('<h2><a href="y">A heading that is a link X.</a></h2>', True),
        ('<div class="notice">Our terms have changed X.</div>', False),
        ('<div id="x9"><a href="y">Buy the best shoes now X.</a></div>', False),
        (f'<div class="ad">{LONG} X.</div>', False),
        (f'<p class="cookie-notice">{LONG} X.</p>', False),
    ],
)
def test_html_words_and_neighbours(part, kept):
    page = f"<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A title</h1><p>{LONG} One.</p>{part}<p>{LONG} Two.</p><p>Short.</p></article>"
    got = html.main_text(page)
    assert ("X." in got) == kept and got.startswith("A title\n") and got.endswith("Two.\nShort.") and "Home" not in got


def test_html_box_for_an_article():
    comment = '<div class="c2">Great post, I liked it a lot, really very much indeed, and I thank you for it.</div>'
    article = "".join(f"<p>{LONG} {i}.</p>" for i in range(6))
    page = f"<body><div><h1>A title of some length here</h1>{article}<p>Short.</p></div>{comment * 2}</body>"
    assert html.main_text(page) == "\n".join(["A title of some length here", *(f"{LONG} {i}." for i in range(6)), "Short."])
    # Where comments hold over a quarter of the prose no box stands out, and all of it is text.
    assert html.main_text(page.replace(article, "").replace("Short.", LONG)).count("Great post") == 2
    title_before = f"<h1>A title of some length here</h1><p>What the article is about.</p><div>{article}</div>{comment}"
    assert html.main_text(title_before) == "\n".join(["A title of some length here", "What the article is about.", *(f"{LONG} {i}." for i in range(6))])
    # Sections of about one size are all inside.
    assert html.main_text("".join(f"<div><p>{LONG} {i}.</p></div>" for i in range(3))).count("\n") == 2


def test_html_nesting():
    page = '<main><p class="related-work">Related work.</p><div class="share-price">The share price rose.</div><p>And <math><mi>x</mi></math> <span class="ad">Buy <span>x</span> more text</span>too.</p></main>'
    assert html.main_text(page) == "Related work.\nThe share price rose.\nAnd x\ntoo."
    deep = "<div>" * 30_000 + "<p>Deep down here is a sentence that is long enough to be kept.</p>" * 3
    assert html.main_text(deep).count("\n") == 2


def test_minimum_cut_is_least():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [rng.randint(-50, 50) for _ in range(n)]
        ties = [(i, j, rng.randint(0, 40)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        price = lambda keep: sum(max(c, 0) for c, k in zip(costs, keep, strict=True) if not k) + sum(max(-c, 0) for c, k in zip(costs, keep, strict=True) if k) + sum(w for a, b, w in ties if keep[a] != keep[b])
        best = min(price([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert price(html.minimum_cut(costs, ties)) == best


# 3


def test_language(spark):
    make = lambda lang, i: {"en": "the house and the garden of ", "de": "das haus und der garten von ", "fr": "la maison et le jardin de "}[lang] + words(20, i)
    rows = [(i, make(lang, i), lang) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "und der das hausgarten", None), (903, "", None)]
    got = by_id(language.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    held = [(i, lang) for i, _, lang in rows[:150] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i, _ in held) and np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.95
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 903)] == [("und", 0.0)] * 3 and got[902].lang_pred == "de" and 0 <= got[902].score <= 1
    nothing = by_id(language.report(spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")))
    assert nothing[1].lang_pred == "und"


def plain_backoff(learn, texts):
    """(language, score) of each text: words first, then 4, 3, 2 and 1 characters, from plain counts of (lang, text)."""
    find = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    cut = lambda w, n: [(w[i : i + n], i == 0, i + n == len(w)) for i in range(len(w) - n + 1)]
    names, counts = sorted({x for x, _ in learn}), collections.defaultdict(collections.Counter)
    for lang, t in learn:
        for w in find(t):
            counts[0, lang][w] += 1
            for n in (1, 2, 3, 4):
                counts[n, lang].update(cut(w, n))
    kinds = {n: len(set().union(*(counts[n, x] for x in names))) for n in range(5)}
    size = {(n, x): sum(counts[n, x].values()) + 0.5 * (kinds[n] + 1) for n in range(5) for x in names}
    known = {n: set().union(*(counts[n, x] for x in names)) for n in range(5)}
    out = []
    for t in texts:
        sums = dict.fromkeys(names, 0.0)
        for w in find(t):
            order = 0 if w in known[0] else next((n for n in (4, 3, 2) if any(g in known[n] for g in cut(w, n))), 1)
            for g in [w] if order == 0 else cut(w, order):
                for x in names:
                    sums[x] += math.log((counts[order, x][g] + 0.5) / size[order, x]) / max(1, order)
        best = max(names, key=lambda x: (sums[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(v - sums[best]) for v in sums.values())) if find(t) else ("und", 0.0))
    return out


def test_language_of_twenty(spark):
    """Small languages beside large ones; every prediction equals a plain recomputation; other columns and rows do not matter."""
    rng, rows = random.Random(4), []
    for k in range(20):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéñ", 9)
        own = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(60)]
        for i in range(4 if k in (3, 11) else 40):
            new = "".join(rng.choices(letters, k=5))
            rows.append((len(rows), " ".join([*rng.choices(own, k=12), new]), f"l{k:02}", "x", i))
    rows += [rows[0], rows[0], (5000, "Ünseen wörds überall 漢字 x", None, "x", 1)]
    schema = "doc_id long, text string, lang string, key string, unseen int"
    got = language.report(spark.createDataFrame(rows, schema)).collect()
    learn = [(r[2], r[1]) for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1]
    want = sorted((r[0], *p) for r, p in zip(rows, plain_backoff(learn, [r[1] for r in rows]), strict=True))
    assert len(got) == len(want)
    for r, (i, lang, score) in zip(sorted(got, key=lambda r: r.doc_id), want, strict=True):
        assert (r.doc_id, r.lang_pred) == (i, lang) and r.score == pytest.approx(score, abs=1e-9)
    true = {r[0]: r[2] for r in rows}
    for names in ({"l03", "l11"}, set(true.values()) - {"l03", "l11", None}):
        assert np.mean([r.lang_pred == true[r.doc_id] for r in got if true[r.doc_id] in names]) > 0.9


# 4


def brute_spans(texts, length):
    seen = collections.Counter(b[i : i + length] for b in texts.values() for i in range(len(b) - length + 1))
    out = {}
    for k, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out[k] = gone
    return out


@pytest.mark.parametrize("crowd", [256, 1])
def test_suffix(docs, texts, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    raw = {i: (t or "").encode() for i, t in texts.items()}
    want, got = brute_spans(raw, suffix.LENGTH), by_id(suffix.report(docs))
    for i, b in raw.items():
        kept = bytes(x for x, g in zip(b, want[i], strict=True) if not g)
        spans = sum(g and not (k and want[i][k - 1]) for k, g in enumerate(want[i]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), sum(want[i]), spans), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd", [256, 1])
def test_suffix_rows_that_share_an_id(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    common, polynomial = words(60, 2), thue_morse(2048)
    texts = ["z" * 16, words(300, 5) + common + words(80, 6), common + words(90, 8), words(100, 9), words(100, 9), words(20, 4), polynomial[:1024] + "!" + polynomial[1024:]]
    docs = spark.createDataFrame([(i % 3 if i < 6 else 9, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int").repartition(2)
    raw = dict(enumerate(t.encode() for t in texts))
    want = brute_spans(raw, suffix.LENGTH)
    kept = {i: bytes(x for x, g in zip(b, want[i], strict=True) if not g) for i, b in raw.items()}
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.report(docs).collect())
    assert got == sorted((i % 3 if i < 6 else 9, len(b), sum(want[i]), hashlib.sha256(kept[i]).hexdigest()) for i, b in raw.items())
    left = {r.row: r.text for r in suffix.strip(docs).collect()}
    assert left == {i: b.decode() for i, b in kept.items() if b.strip()}


def test_refine_buckets():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1300] = data[:300]
    got = suffix.refine(data, np.array([0]), np.array([3000 - 49]), 50)
    strings = [data[i : i + 50].tobytes() for i in range(3000 - 49)]
    assert len(set(got.tolist())) == len(set(strings)) == len({(g, s) for g, s in zip(got.tolist(), strings, strict=True)})


def test_strip_leaves_valid_text(docs):
    out = by_id(suffix.strip(docs))
    assert out[0].text is None and out[1].text == "" and 7 not in out
    assert all(r.text is None or r.text.encode().decode() == r.text for r in out.values())


# 5


def plain_fingerprint(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    counts = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(docs, texts):
    want = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in want:
        for b in range(a):
            if (want[a] ^ want[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(simhash.report(docs))
    assert all(got[i].fingerprint == f"{want[i]:016x}" and got[i].component_id == find(i) for i in want)
    assert got[7].component_id == 6 and got[1].component_id == 0
    assert {r.doc_id for r in simhash.dedup(docs).collect()} == {i for i in want if find(i) == i}


def test_links_join_all_near_fingerprints(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    every = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(6)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.node: r.root for r in components.components(simhash.links(spark.createDataFrame([(signed(x),) for x in every], "fp long"))).collect()}
    for a in every:
        for b in every:
            if a != b and (a ^ b).bit_count() <= 2:
                assert got[signed(a)] == got[signed(b)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 299), (299, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[200] == got[150] == 100 and got[300] == got[299] == 299 and 7 in got


# 6


@pytest.mark.parametrize("sites", [2, 10])
def test_lines(docs, texts, sites):
    source = {i: None if i == 7 else f"s{i % 12}" for i in texts}
    spread, first = collections.defaultdict(set), {}
    for i, t in texts.items():
        for x in (t or "").split("\n") if t is not None else []:
            if WORD.search(x.encode()):
                spread[x] |= {source[i]} - {None}
                first.setdefault(x, i)
    want = {i: None if t is None else [x for x in t.split("\n") if not (len(spread[x]) >= sites and first.get(x) != i)] for i, t in texts.items()}
    got = {r.doc_id: r[lines.KEPT] for r in lines.with_kept(docs, sites=sites).collect()}
    assert got == want and any(w is not None and len(w) < len(texts[i].split("\n")) for i, w in want.items())

def test_lines_many_in_one_text(spark):
    """All lines of a long text are gone but those of its own, the first copy keeps all; 17 and 16 removed lines are at the border of the two lookups."""
    many = {**{i: 4000 for i in range(12)}, 20: 16, 21: 17, 22: 1}
    texts = {i: [f"line {k} of them" for k in range(n)] + [f"own {i}", "", f"line {n // 2} of them"] for i, n in many.items()}
    rows = [(i, f"s{i}", "\n".join(x)) for i, x in texts.items()]
    got = {r.doc_id: r[lines.KEPT] for r in lines.with_kept(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {i: x if i == 0 else [f"own {i}", ""] for i, x in texts.items()}


# 7


def test_media(docs, texts):
    got = by_id(media.columns(docs))
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    stored = {r.doc_id: bytes(r.media) for r in media.store(docs).collect()}
    assert all(got[i].media_sha256 == hashlib.sha256(m).hexdigest() and got[i].media_bytes == len(m) for i, m in stored.items())
    assert got[0].media_sha256 == got[1].media_sha256 and got[6].feature == got[7].feature


def walk(jpeg):
    """DC values of all blocks in the order of the scan, read bit by bit."""
    bits, at, out = "", 0, []
    parts = re.split(rb"\xff[\xd0-\xd7]", jpeg.scan)
    codes = {k: {(n, c): s for n, c, s in media._codes(list(t[:16]), list(t[16:]))} for k, t in jpeg.tables.items()}
    _, _, units, blocks = media._grid(jpeg)
    for part in parts:
        bits, at = "".join(f"{x:08b}" for x in part.replace(b"\xff\0", b"\xff")), 0
        last = collections.Counter()

        def take(table):
            nonlocal at
            n = next(n for n in range(1, 17) if (n, int(bits[at : at + n], 2)) in table)
            symbol = table[n, int(bits[at : at + n], 2)]
            at += n
            size = symbol & 15
            value = int(bits[at : at + size] or "0", 2)
            at += size
            return symbol, value if not size or value >> (size - 1) else value - (1 << size) + 1

        for u in range(min(blocks - len(out), jpeg.restart * len(units) or blocks)):
            c = jpeg.components[units[u % len(units)]]
            last[c.ident] += take(codes[c.dc])[1]
            out.append(last[c.ident])
            k = 1
            while k < 64:
                symbol, _ = take(codes[16 | c.ac])
                if symbol == 0:
                    break
                k += (symbol >> 4) + 1
    return out


def test_jpeg_decoders_agree():
    rng = np.random.default_rng(0)
    for n in (64, 640, 64 * 300):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        jpeg = media.parse(media.write(payload))
        assert (np.array(walk(jpeg)) + 128).astype(np.uint8).tobytes() == payload == media.thumbnail(jpeg).tobytes()
    many = [bytes(rng.integers(0, 256, 64 * k, dtype=np.uint8)) for k in (8001, 1, 16000, 3)] + [b"\xff" * 64, bytes(64)]
    assert [x["samples"] for x in media.read([media.write(x) for x in many])] == many
    for bad in (b"not a jpeg", media.write(bytes(64))[:-2], media.write(bytes(128)).replace(b"\xff\xd0", b"")):
        with pytest.raises(ValueError):
            media.read([bad])


@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1)]])
def test_jpeg_of_any_make(sampling):
    """Random tables, colour, coefficients and restarts: decoded side by side as bit by bit."""
    rng = random.Random(len(sampling))
    seg, found = media._segment, []
    for restart in (0, 1, 3):
        dc_table = bytes([0, 1, 1, 2, 3, 4] + [0] * 10 + rng.sample(range(12), 11))
        ac_symbols = [0, 0xF0, *rng.sample([r << 4 | s for r in range(16) for s in range(1, 11)], 30)]
        ac_table = bytes([0, 1, 2, 3, 4, 6, 8, 8] + [0] * 8 + ac_symbols)
        dc, ac = ({s: (n, c) for n, c, s in media._codes(list(t[:16]), list(t[16:]))} for t in (dc_table, ac_table))
        frame = seg(0xC0, bytes([8, 0, 50, 0, 90, len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
        scan_head = seg(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + bytes([0, 63, 0]))
        head = b"\xff\xd8" + seg(0xDB, bytes([0] + [5] * 64)) + seg(0xC4, b"\0" + dc_table) + seg(0xC4, b"\x10" + ac_table) + frame + (seg(0xDD, bytes([0, restart])) if restart else b"") + scan_head
        shape = media._grid(media.parse(head + b"\xff\xd9"))
        parts, per, left = [], len(shape[2]) * (restart or 10**6), shape[3]
        while left:
            bits = ""
            for _ in range(min(per, left)):
                s = rng.choice(sorted(dc))
                bits += f"{dc[s][1]:0{dc[s][0]}b}" + "".join(rng.choice("01") for _ in range(s))
                k = 1
                while k < 64:
                    s = rng.choice(ac_symbols)
                    if s and k + (s >> 4) + 1 > 64:
                        s = 0
                    bits += f"{ac[s][1]:0{ac[s][0]}b}" + "".join(rng.choice("01") for _ in range(s & 15))
                    k = 64 if not s else k + (s >> 4) + 1
            bits += "1" * (-len(bits) % 8)
            parts.append(int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0"))
            left -= min(per, left)
        found.append(media.parse(head + b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(parts) - 1 else b"") for i, p in enumerate(parts)) + b"\xff\xd9"))
    for jpeg, thumb in zip(found, media.thumbnails(found), strict=True):
        high, wide, units, _ = media._grid(jpeg)
        h, v = sampling[0] if len(sampling) > 1 else (1, 1)
        want, values = np.zeros((-(-high // v) * v, -(-wide // h) * h)), walk(jpeg)
        for i, x in enumerate(values):
            m, b = divmod(i, len(units))
            if b < h * v:
                want[m // (-(-wide // h)) * v + b // h, m % (-(-wide // h)) * h + b % h] = x
        assert np.array_equal(thumb, np.clip(np.rint(want[:high, :wide] * 5 / 8 + 128), 0, 255))


def test_jpeg_with_other_coefficients():
    """A block with AC coefficients, four-to-one colour and restarts is walked code by code."""
    seg = media._segment
    dc = seg(0xC4, bytes([0x00] + [0, 2] + [0] * 14 + [0, 3]))  # 00: size 0, 01: size 3
    ac = seg(0xC4, bytes([0x10] + [0, 2] + [0] * 14 + [0x00, 0x02]))  # 00: end, 01: run 0 size 2
    frame = seg(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + dc + ac + frame + seg(0xDD, b"\0\1") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    first, second = "01" + "101" + "01" + "11" + "00", "00" + "00"  # dc 5, one AC, end; dc 0, end
    pack = lambda bits: int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    thumb = media.thumbnail(media.parse(head + pack(first) + b"\xff\xd0" + pack(second) + b"\xff\xd9"))
    assert thumb.tolist() == [[5 * 16 // 8 + 128, 128]]


# 8


def lm_scores(texts):
    return lm_scores_of(list(texts.items()))


def lm_scores_of(rows):
    """(held, n_tokens, n_known, train_tokens, base, score) of each id's (last) text, from plain counts."""
    rows = [(i, [*WORD.findall((t or "").encode().translate(LOWER)), None]) for i, t in rows]
    single, pair, triple, context = (collections.Counter() for _ in range(4))
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, t in rows:
        if not held[i]:
            single.update(t)
            pair.update(zip([None, *t[:-1]], t, strict=True))
            triple.update(zip([None, None, *t[:-2]][: len(t)], [None, *t[:-1]], t, strict=True))
            context.update(zip([None, None, *t[:-2]][: len(t)], [None, *t[:-1]], strict=True))
    n, v, out = sum(single.values()), len(single), {}
    weight = lambda m, fall: 0.5 * m**-fall if m else 1.0
    for i, t in rows:
        base = score = 0.0
        for a, b, c in zip([None, None, *t[:-2]][: len(t)], [None, *t[:-1]], t, strict=True):
            one = (single[c] + 1) / (n + v + 1)
            w2, w3 = weight(single[b], scoring.FALL[0]), weight(context[a, b], scoring.FALL[1])
            two = (1 - w2) * pair[b, c] / max(1, single[b]) + w2 * one
            score += math.log10((1 - w3) * triple[a, b, c] / max(1, context[a, b]) + w3 * two)
            base += math.log10(one)
        out[i] = held[i], len(t), sum(single[w] > 0 for w in t), n, base, score
    return out


def same_scores(rows, want):
    for r in rows:
        held, size, known, n, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n)
        assert r.base_score == pytest.approx(base) and abs(r.score - score) <= 0.04 * size


@pytest.mark.parametrize("every", [1, 1 << 30])
def test_scoring(spark, texts, monkeypatch, every):
    monkeypatch.setattr(scoring, "EVERY", every)  # with 1, words and pairs are found that are dealt over places
    rng = random.Random(1)
    many = texts | {100 + i: " ".join(rng.choice(["of the", "of the", "The", f"x{rng.randint(0, 300)}"]) for _ in range(150)) for i in range(60)}
    docs = spark.createDataFrame(list(many.items()), "doc_id long, text string").repartition(3).cache()
    hot = scoring.find_frequent(docs, 4)
    assert (len(hot.words) >= 2, len(hot.pairs) >= 1) == (every == 1,) * 2
    rows = scoring.score(docs).collect()
    assert len(rows) == len(many)
    same_scores(rows, lm_scores(many))


def test_scoring_pairs_seen_once(spark):
    texts = {i: " ".join(f"w{(i * k + k) % 23}" for k in range(12)) for i in range(40)}
    same_scores(scoring.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), lm_scores(texts))


def test_scoring_layout(spark, docs, texts):
    """Any number of shards gives the same scores."""
    want = {r.doc_id: r for r in scoring.score(docs).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = scoring.score(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(r.score == pytest.approx(want[r.doc_id].score) and r.base_score == pytest.approx(want[r.doc_id].base_score) for r in got)


def test_elias_fano():
    rng = np.random.default_rng(4)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.sort(rng.integers(0, 1 << 40, 3000)).astype(np.uint64), np.arange(500, dtype=np.uint64), np.array([5, 5, 5, 9], np.uint64)):
        ef = trie.EliasFano(values)
        assert np.array_equal(ef.get(np.arange(len(values))), values)
        asked = np.concatenate([values, values + np.uint64(1), rng.integers(0, 1 << 41, 200).astype(np.uint64)])
        assert np.array_equal(ef.successor(asked), np.searchsorted(values, asked, "left"))


def test_trie_level():
    keys = np.array([0 << 32 | 5, 0 << 32 | 9, 3 << 32 | 1, 3 << 32 | 7], np.uint64)
    store = trie.Store()
    level = trie.Level(5, keys, 32, store.keep)
    context, successor = np.array([0, 0, 0, 1, 3, 3, 3, 4, -1]), np.array([5, 6, 9, 5, 1, 7, 8, 0, 5])
    assert level.find(context, successor).tolist() == [0, -1, 1, -1, 2, 3, -1, -1, -1]
    store.close()
    assert np.abs(np.log10(trie.restore(trie.quantise(np.array([-0.1, -3.3])))) - [-0.1, -3.3]).max() < 0.02 and trie.restore(np.zeros(1, np.uint8))[0] == 0


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_identify_is_exact(monkeypatch):
    one = thue_morse(2048)
    spans = [b"", b"a", b"a\0", b"ab" * 200, one[:1024].encode(), one[1024:].encode(), b"ab" * 200, b"a", b"12345678", b"123456789", "é".encode() * 300, b""]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(x) for x in spans])
    for hashes in (K.span_hashes, lambda v, d, s, e: np.zeros(len(s), np.uint64), lambda v, d, s, e: (e - s).astype(np.uint64) % np.uint64(3)):
        monkeypatch.setattr(K, "span_hashes", hashes)
        group, first, _ = K.identify(data, ends - [len(x) for x in spans], ends)
        assert all((group[i] == group[j]) == (a == b) for i, a in enumerate(spans) for j, b in enumerate(spans))
        assert [spans[first[g]] for g in group] == spans


# 9


def test_quality_counts(docs, texts, labels):
    got = by_id(quality.judge(docs, quality.fit(docs, labels)))
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        seen, dups = set(), 0
        for line in (t or "").split("\n"):
            dups += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
            seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dups, len(covered)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.keep(docs, quality.fit(docs, labels)).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and got[12].kept


def plain_verdict(text, chain):
    """Failed, content share and kept, line by line in plain Python."""
    every = WORD.findall(text.encode())
    windows = collections.Counter(zip(every, every[1:], every[2:]))
    covered = {k + j for k in range(len(every) - 2) if windows[every[k], every[k + 1], every[k + 2]] > 1 for j in range(3)}
    failed = len(every) < 50 or 100 * len(covered) > 50 * len(every)
    seen, at, found, ways = set(), 0, [], None
    for line in text.encode().split(b"\n"):
        own = WORD.findall(line)
        if not own:
            continue
        ink, count, among = sum(map(len, own)), len(own), lambda x: sum(line.count(c) for c in x)
        letters = sum(65 <= c <= 90 for c in line)
        bits = [
            True, 100 * among([b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]) > ink, 20 * among([b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]) > ink,
            letters > ink / 4, letters > ink * 0.6, line.count(b"!") > 0.03 * ink, line.count(b"|") > ink / 50, among([b"%d" % k for k in range(10)]) > ink / 5,
            sum(x == y for x, y in zip(own, own[1:])) > count / 5, sum(at + k in covered for k in range(count)) > 0.3 * count,
            line in seen, count < 3, count >= 8, own[-1][-1:] in (b".", b"!", b"?", b":"), ink > 14 * count,
        ]
        seen.add(line)
        at += count
        found.append(ink)
        score = sum(w for w, x in zip(chain.weights, bits) if x)
        if ways is None:
            ways = [(chain.first[y] + score * y, [y]) for y in (0, 1)]
        else:
            ways = [max(((v + chain.steps[x][y] + score * y, [*path, y]) for x, (v, path) in enumerate(ways)), key=lambda z: z[0]) for y in (0, 1)]
    label = max(ways, key=lambda z: z[0])[1] if ways else []
    content = sum(n for n, y in zip(found, label) if not y)
    share = content / sum(found) if found else 0.0
    return failed, share, not failed and share >= quality.SHARE


@pytest.mark.parametrize("fitted", [False, True])
def test_quality_verdicts(spark, docs, texts, labels, fitted):
    rng = random.Random(9)
    bad = ["### *** $$$ | | |", "CLICK HERE NOW!!! BUY!!!", "a | b | c | d", "menu menu menu menu", "12 34 56 78", "Home"]
    noise = lambda: rng.choice([rng.choice(bad), " ".join(x + rng.choice(["!!!", "|||", "###", "$$$"]) for x in words(9, rng.randint(0, 999)).upper().split())])
    mixed = {100 + i: "\n".join(noise() if rng.random() < i / 60 else words(rng.choice([3, 9, 20]), rng.randint(0, 99)) + rng.choice([".", "", ":"]) for _ in range(12)) for i in range(60)}
    rows = spark.createDataFrame(list(mixed.items()), "doc_id long, text string")
    chain = quality.fit(docs, labels) if fitted else quality.PRIOR
    got = by_id(quality.judge(docs.select("doc_id", "text").union(rows), chain))
    want = {i: plain_verdict(t or "", chain) for i, t in (texts | mixed).items()}
    for i, (failed, share, kept) in want.items():
        assert (got[i].base_failed, got[i].kept) == (failed, kept) and got[i].content_share == pytest.approx(share), i
    assert fitted or len({round(x[1], 3) for x in want.values() if 0 < x[1] < 1}) > 20 and any(not x[0] and not x[2] for x in want.values())
    kept = {r.doc_id for r in quality.keep(docs.select("doc_id", "text").union(rows), chain).collect()}
    assert kept == {i for i, x in want.items() if x[2]}


def test_quality_fit_with_repeated_ids(spark, docs, labels):
    """Copies of a labelled row teach nothing more."""
    many = docs.select("doc_id", "text").withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("again")
    one, five = quality.fit(docs, labels), quality.fit(many, labels)
    assert np.allclose(one.weights, five.weights) and np.allclose(one.steps, five.steps)


def test_viterbi_is_best():
    rng = np.random.default_rng(2)
    for _ in range(20):
        chain = quality.Chain(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
        n = int(rng.integers(1, 7))
        bits = rng.integers(0, 1 << len(quality.FEATURES), n)
        score = chain.scores(bits)
        value = lambda y: chain.first[y[0]] + sum(score[k] * y[k] for k in range(n)) + sum(chain.steps[y[k - 1], y[k]] for k in range(1, n))
        best = max(value([m >> k & 1 for k in range(n)]) for m in range(1 << n))
        assert value(quality.viterbi(chain, np.zeros(n, int), bits).tolist()) == pytest.approx(best)


def test_chain_learns():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(60), 5)
    label = np.repeat(rng.integers(0, 2, 60), 5)
    bits = 1 | np.where((label == 1) & (rng.random(300) < 0.9), 2, 0)
    chain = quality.train(doc, bits, label)
    assert (quality.viterbi(chain, doc, bits) == label).mean() > 0.97


# 10


def test_packing(docs, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = texts | {900: "a <|endoftext|> b", 901: "<|endoftext|>", 902: "x<|endoftext|><|endoftext|>\n<|endoftext", 903: "|>"}
    docs = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame([(i, texts[i]) for i in range(900, 904)], "doc_id long, text string"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    rows = sorted(packing.pack(docs, RANKS, packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")), keep_ids=True).collect(), key=lambda r: (r.sequence_id, r.offset))
    at, filled = collections.Counter(), collections.Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = ids[r.doc_id][r.start : r.start + r.length].tobytes()
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece) and bytes(r.ids) == piece
        at[r.doc_id] += r.length
    for r in rows:
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()} and max(filled.values()) <= packing.LENGTH
    assert sum(v < packing.LENGTH for v in filled.values()) <= 8 and 50256 in ids[900]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = packing.hilbert(points, bits)
    assert sorted(key.tolist()) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_copies_are_neighbours(docs):
    rows = {r.doc_id: r for r in packing.tokens(docs, RANKS).collect()}
    assert rows[6].key == rows[7].key and rows[6].ids == rows[7].ids


def test_long_text_is_one_slice():
    batch = pa.record_batch([pa.array(["a" * 50, None, "", "b" * 500, "c"])], ["text"])
    assert [(p.num_rows, len(d)) for p, d, _ in K.slices(batch, most=100)] == [(3, 50), (1, 500), (1, 1)] or sum(p.num_rows for p, _, _ in K.slices(batch, most=100)) == 5


def test_frequent_line_in_plan(docs):
    plan = lines.with_kept(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and F is not None
