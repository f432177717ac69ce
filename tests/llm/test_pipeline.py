"""The pipeline's stages on a small table: each against plain Python on its own input."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lambdalake.llm import lines, quality, suffix
from test_neardup import shingles
from lambdalake.llm.tables import materialize


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    passage, line = prose(60, 5000), "Subscribe to our newsletter now."
    texts = [prose(120, i) for i in range(40)]
    texts += [texts[0], texts[0], texts[1] + " once more"] + [prose(80, 100 + i) + "\n" + passage + "\n" + prose(80, 200 + i) for i in range(3)]
    texts += [line + "\n" + prose(90, 300 + i) for i in range(14)] + ["bad### " * 90, "WHAT!! A!! " * 60, None, "", prose(20, 400)]
    rows = [(i, t, "en", f"s{i % 13}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in list(range(30)) + [60, 61]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, folder), "stage")
        seen[name] = (before, docs.collect())
        assert name == "packing" or docs.columns == columns
    before, after = seen["quality rules"]
    assert {r.doc_id for r in after} == {i for i, r in before.items() if r.text and len(r.text.split()) >= 50 and i < 60}
    before, after = seen["line dedup"]
    lost = [r.doc_id for r in after if r.text != before[r.doc_id].text]
    assert len(after) == len(before) and set(lost) <= set(range(46, 60)) and len(lost) == 13 and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near dedup"]
    assert set(before) - {r.doc_id for r in after} == {40, 41, 42}
    before, after = seen["passage dedup"]
    texts = {i: r.text.encode() for i, r in before.items()}
    windows = [t[k : k + suffix.LENGTH] for t in texts.values() for k in range(len(t) - suffix.LENGTH + 1)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    assert twice
    for r in after:
        t = texts[r.doc_id]
        gone = suffix.merge([(k, k + suffix.LENGTH) for k in range(len(t) - suffix.LENGTH + 1) if t[k : k + suffix.LENGTH] in twice])
        assert r.text.encode() == suffix._kept(t, gone)
    before, after = seen["packing"]
    assert {r.doc_id for r in after} == set(before)
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(after)


encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def again_lines(rows):
    """Lines on ten sites or more stay with their least doc_id alone; ids that share a line share its fate."""
    sites, first = defaultdict(set), {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            if x.strip(" \t\n\v\f\r"):
                sites[x] |= {r.source} - {None}
                first[x] = min([i for i in (first.get(x), r.doc_id) if i is not None], default=None)
    for r in rows:
        kept = [x for x in (r.text or "").split("\n") if len(sites[x]) < lines.SITES or first[x] == r.doc_id or r.doc_id is None]
        if r.text is None or kept:
            yield r.doc_id, r.text if r.text is None else "\n".join(kept)


def again_near(rows):
    sets, seen = [shingles(r.text) for r in rows], {}
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (not sets[i] and not sets[j] or both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                root = [root[j] if r == root[i] else r for r in root]
    for r, top in sorted(zip(rows, root, strict=True), key=lambda x: (x[0].doc_id is None, x[0].doc_id or 0)):
        seen.setdefault(top, (r.doc_id, r.text))
    return seen.values()


def again_passages(rows):
    texts = [(r.text or "").encode() for r in rows]
    n = Counter(t[k : k + suffix.LENGTH] for t in texts for k in range(len(t) - suffix.LENGTH + 1))
    for r, t in zip(rows, texts, strict=True):
        gone = suffix.merge([(k, k + suffix.LENGTH) for k in range(len(t) - suffix.LENGTH + 1) if n[t[k : k + suffix.LENGTH]] > 1])
        left = suffix._kept(t, gone).decode()
        if not gone or left.strip(" \t\n\v\f\r"):
            yield r.doc_id, r.text and left


AGAIN = {"line dedup": again_lines, "near dedup": again_near, "passage dedup": again_passages}


def test_stages_with_repeated_rows(spark, folder):
    """Rows that share an id, repeated rows, nulls, no rows and columns of clashing names go through every stage."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"row": F.lit(1), "spans": F.lit("s"), "line_id": F.lit(2), "key": F.lit("k")})
    many = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id in (20, 60)").withColumn("doc_id", F.lit(3).cast("long"))).union(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    for rows in (many, docs.limit(0)):
        out = materialize(rows, "rows")
        for name, stage in corpus_pipeline.STAGES:
            columns, before = out.columns, out.collect()
            out = materialize(stage(spark, out, folder), "stage")
            assert name == "packing" or out.columns == columns
            if name in AGAIN:
                got = Counter((r.doc_id, r.text) for r in out.collect())
                assert got == Counter(AGAIN[name](before)), name
            if name == "packing":
                ends = Counter((r.doc_id, r.start + r.length) for r in out.collect() if r.start + r.length == r.doc_tokens)
                assert ends == Counter((r.doc_id, len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before)
        assert (out.count() > 0) == (rows is many)


def test_prior_without_labels(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels.where("quality = 1")) is quality.PRIOR
