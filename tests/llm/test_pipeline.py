"""The pipeline's stages on documents whose fate is known, and against their brute-force versions."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from test_operators import ngrams
from test_suffixes import brute, cuts, words

import corpus_pipeline
from tephra.llm import bpe, langid, mixing, ngram_join
from tephra.llm import words as W

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(path, spark):
    rng = random.Random(8)
    vocabulary = [a + b + c for a in ("th", "st", "br", "cl", "pr", "m", "n") for b in ("e", "a", "o", "i") for c in ("r", "n", "d", "st", "ly")]
    text = lambda n: " ".join(rng.choice([*vocabulary, "the", "and", "of"]) for _ in range(n))
    passage = text(70)
    rows = [(i, text(rng.randint(80, 160)), "en", f"src{i % 4}") for i in range(30)]
    rows.append((100, rows[0][1], "en", "src1"))  # a copy
    near = rows[1][1].split()
    near[5] = "changed"
    rows.append((101, " ".join(near), "en", "src1"))  # a near copy
    rows += [(102, text(90) + " " + passage + " " + text(20), "en", "src2"), (103, text(60) + " " + passage + " " + text(50), "en", "src3")]
    rows += [(104, "### 123 %%%", "en", "src0"), (105, "", "en", "src0"), (106, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return {r[0]: r[1] for r in rows}, passage


def test_stages(spark, tmp_path):
    texts, passage = corpus(str(tmp_path), spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == set(texts) - {104, 105, 106}
    assert set(kept[1]) == set(kept[0]) - {100, 101}
    assert passage in kept[2][102] and passage not in kept[2][103] and set(kept[2]) == set(kept[1])
    assert all(kept[2][d] == texts[d] for d in kept[2] if d != 103)
    assert docs.count() == len(kept[2])  # the mixture is as large as its input
    weights = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert weights["src0"] > weights["src3"]
    encoder = bpe.encoder(bpe.VOCABULARY)
    for r in docs.collect():
        assert r.exact and encoder.decode(r.tokens) == r.text == kept[2][r.doc_id]
    assert {(r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, tuple(r.tokens)) for r in docs.collect()}


def test_empty_corpus(spark, tmp_path):
    corpus(str(tmp_path / "some"), spark)
    spark.read.parquet(f"{tmp_path}/some/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def accepted(model, text):
    """Whether known languages have SHARE of the words' probability, by plain forward-backward over the whole text."""
    w = W.of_bytes((text or "").encode())
    tells = [any(c.isalpha() for c in x) for x in words(text)]
    if not any(tells):
        return False
    score, step = np.exp(model.emissions(w.data, w.start, w.end, w.hash).astype(float)), np.exp(model.switch.astype(float))
    k = len(model.labels)
    ahead, back, v = np.zeros_like(score), np.ones_like(score), np.full(k, 1 / k)
    for t in range(len(score)):
        v = (v @ step) * score[t]
        v /= v.sum()
        ahead[t] = v
    for t in range(len(score) - 2, -1, -1):
        back[t] = step @ (score[t + 1] * back[t + 1])
        back[t] /= back[t].sum()
    p = ahead * back
    p /= p.sum(1, keepdims=True)
    return p[np.array(tells), : k - 1].sum() / sum(tells) >= langid.SHARE


def grouped(rows):
    """The row of the least id of each group that hangs together."""
    root = {r["doc_id"]: r["doc_id"] for r in rows}
    sets = [(r["doc_id"], ngrams(r["text"])) for r in rows]
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a != b and x and y and len(x & y) / len(x | y) >= ngram_join.THRESHOLD:
            a, b = root[a], root[b]
            root = {d: min(a, b) if r in (a, b) else r for d, r in root.items()}
    return [r for r in rows if root[r["doc_id"]] == r["doc_id"]]


def without_repeats(rows):
    gone = cuts(brute(list({(r["doc_id"], r["text"]): 0 for r in rows}), 50))
    out = []
    for r in rows:
        x = W.of_bytes(r["text"].encode())
        keep = [not any(d == r["doc_id"] and a <= i < a + n for (d, a), n in gone.items()) for i in range(len(x.hash))]
        edges = [*x.start, len(x.data)]
        edges[0] = 0
        text = b"".join(x.data[edges[i] : edges[i + 1]].tobytes() for i in range(len(keep)) if keep[i]).decode()
        if any(keep):
            out.append(r | {"text": text, "n_chars": len(text)})
    return out


def test_every_stage_against_plain_versions(spark, tmp_path):
    rng = random.Random(21)
    lexicon = {"en": "the of and to in is that was it for on are with".split(), "de": "der die und in den von zu das mit sich auf ist".split()}
    stems = {"en": ["ther", "ing", "ough", "ness", "wh", "sh"], "de": ["sch", "ung", "keit", "pf", "ver", "ein"]}
    text = lambda y, n: " ".join(rng.choice(lexicon[y]) if rng.random() < 0.5 else rng.choice(stems[y]) + rng.choice(stems[y]) + str(rng.randint(0, 9)) for _ in range(n))
    rows = []
    add = lambda t, y, source="src0": rows.append((len(rows), t, y, source, len(t or "")))
    shared = [text(y, 60) for y in ("en", "de", "en")]
    for i in range(60):
        y = rng.choice(["en", "de"])
        t = text(y, rng.choice([1, 5, 40, 90]))
        if rng.random() < 0.3:
            t += rng.choice([" ", "\n"]) + rng.choice(shared) + " " + text(y, rng.randint(0, 30))
        add(t, y, rng.choice(["src0", "src1", "src9", None]))
    for i in (3, 3, 7, 11, 12):  # copies and near copies
        near = rows[i][1].split(" ")
        near[len(near) // 2] = "other"
        add(rows[i][1] if i == 3 else " ".join(near), rows[i][2])
    add("bcdfg hjklm npqrs tvwxz qwrtp sdfgh jklzx cvbnm " * 3, None)
    add(None, "en")
    add("", None)
    add("12 34 !!", "de")
    add(text("en", 40) + " " + text("de", 40), "en")
    rows.append(rows[5])  # a repeated row
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    own = lambda df: [r.asDict() for r in df.collect()]
    key = lambda r: repr(sorted(r.items()))

    def same(df, plain):
        assert sorted(own(df), key=key) == sorted(plain, key=key)

    stages = [f for _, f in corpus_pipeline.STAGES]
    model = langid.train(langid.sample(docs))
    plain = [r for r in own(docs) if accepted(model, r["text"])]
    assert 60 < len(plain) < len(rows) - 3
    docs = stages[0](spark, docs, str(tmp_path))
    same(docs, plain)
    plain, docs = grouped(plain), stages[1](spark, docs, str(tmp_path))
    same(docs, plain)
    changed = without_repeats(plain)
    assert sum(a["text"] != b["text"] for a, b in zip(plain, changed)) > 3
    plain, docs = changed, stages[2](spark, docs, str(tmp_path))
    same(docs, plain)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(plain).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    mixed = con.execute(mixing.mix_sql()).fetchall()
    plain = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r[:5])) for r in mixed for _ in range(r[5])]
    docs = stages[3](spark, docs, str(tmp_path))
    same(docs, plain)
    vocabulary = bpe.encoder(bpe.VOCABULARY).vocabulary
    out = own(stages[4](spark, docs, str(tmp_path)))
    assert len(out) == len(plain) and all(r["exact"] for r in out)
    for r in out:
        assert r["tokens"] == [t for piece in bpe.pieces(r["text"]) for t in vocabulary.merged(piece.encode())] and r["n_tokens"] == len(r["tokens"])


def test_names_that_stages_use_themselves(spark, tmp_path):
    corpus(str(tmp_path / "some"), spark)
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    extra = ["language", "accepted", "rid", "key", "__start", "__gone", "copies", "__part", "tokens", "u", "h"]
    for name in extra:
        docs = docs.withColumn(name, F.lit("mine"))
    docs.write.parquet(f"{tmp_path}/more/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/more").collect()
    assert len(out) == 32
    assert all(r[n] == "mine" for r in out for n in ("rid", "key", "__start", "__gone", "__part", "u", "h", "language", "accepted", "copies"))
