"""The other operators against brute force, SQL and edge cases."""

import base64
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tephra.llm import bpe, langid, mixing, ngram_join, rules, shards, token_counts, topk

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PLAIN = [
    (1, "The cat and the dog are in the house of the old man and the woman.", "en", "src0", 66),
    (1, "The cat and the dog are in the house of the old man and the woman.", "en", "src0", 66),
    (2, "The cat and the dog are in the house of the old man and the girl.", "en", "src1", 65),
    (3, None, "en", "src1", None),
    (4, "", None, None, 0),
    (None, "Der Hund und die Katze sind in dem Haus und nicht in dem Garten.", "de", "src2", 64),
    (5, "x " * 60_000, "en", "src0", 120_000),
    (6, "Der Hund und die Katze sind in dem Haus und nicht in dem Garten.", "de", None, 64),
    (7, " \n\t ", "de", "src0", 4),
]


def frame(spark, rows=PLAIN):
    return spark.createDataFrame(rows, COLUMNS)


def clashing(spark):
    """Extra columns named as operators name their own."""
    df = frame(spark)
    for name in ("copies", "key", "size", "rid", "tokens", "language", "shard_id", "at", "__x", "u", "root", "signature", "h", "piece", "__part", "__rest", "__mass", "__bin", "__h", "__size", "__gone", "___bin", "n_tokens"):
        df = df.withColumn(name, F.lit("mine"))
    return df


def sql(spark, df, query):
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    return con.execute(query)


def same(df, result):
    names = sorted(df.columns)
    assert names == sorted(c[0] for c in result.description)
    order = [c[0] for c in result.description]
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    other = sorted((tuple(r[order.index(n)] for n in names) for r in result.fetchall()), key=repr)
    assert mine == other


def made(n, seed=1):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(n)]) if rng.random() < 0.05 else i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 5) for _ in range(rng.randint(0, 60))), "en", rng.choice(["src0", "src0", "src1", "z", None]), 0) for i in range(n)]


@pytest.mark.parametrize("operator", ["mix", "encode", "identify", "one_of_each", "shard", "keep"])
def test_every_case_and_clashing_names(spark, operator):
    run = {"mix": mixing.mix, "encode": bpe.encode, "identify": langid.identify, "one_of_each": ngram_join.one_of_each, "shard": shards.shard, "keep": rules.keep}[operator]
    own = {"mix": "copies", "encode": "tokens", "identify": "language", "shard": "shard_id"}.get(operator)
    full = run(clashing(spark)).cache()
    for name in ("key", "h", "__part", "__rest", "__mass", "__bin", "__h", "__size", "__gone", "___bin"):
        assert full.where(F.col(name) != "mine").count() == 0
    if own:
        assert full.where(F.col(own).cast("string") == "mine").count() == 0
    assert run(frame(spark, [])).count() == 0


def test_joins_on_every_case(spark):
    pairs = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_join.join(clashing(spark)).collect()}
    assert set(pairs) == {(1, 2)}  # rows of a null id take no part
    left = [r.doc_id for r in ngram_join.one_of_each(clashing(spark)).collect()]
    assert sorted(left, key=repr) == sorted([1, 1, 3, 4, None, 5, 6, 7], key=repr)
    assert ngram_join.join(frame(spark, [])).count() == 0
    assert token_counts.count(frame(spark, [])).count() == 0


def ngrams(text, n=3):
    w = [x for x in re.split(r"[ \t\n\r\v\f]+", text or "") if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def test_join_against_all_pairs(spark):
    rng, rows = random.Random(4), []
    for g in range(12):
        base = [rng.choice(["ab", "cd", "ef", "gh"]) + str(rng.randint(0, 30)) for _ in range(rng.choice([3, 20, 200, 1500]))]
        for _ in range(rng.randint(1, 5)):
            copy = [w if rng.random() > 0.06 else "new" + str(rng.randint(0, 9)) for w in base] if rng.random() < 0.7 else base
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    classes = {}
    for d, text, *_ in rows:
        classes.setdefault(ngrams(text), []).append(d)
    expected = {(m[0], d): 1.0 for s, m in classes.items() for d in m[1:]}
    for (a, x), (b, y) in itertools.combinations([(m[0], s) for s, m in classes.items()], 2):
        j = len(x & y) / len(x | y)
        if j >= ngram_join.THRESHOLD:
            expected[min(a, b), max(a, b)] = j
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_join.join(frame(spark, rows)).collect()}
    assert got == pytest.approx(expected) and len(expected) > 10
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in expected:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = {r.doc_id: r.root for r in ngram_join.components(ngram_join.join(frame(spark, rows))).collect()}
    assert roots == {x: find(x) for x in list(parent)}


def test_all_pairs_of_classes(spark):
    rng, rows = random.Random(6), []
    for g in range(5):
        base = [f"w{g}x{rng.randint(0, 200)}" for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(3):
            copy = [w if rng.random() > 0.03 else "new" + str(rng.randint(0, 9)) for w in base]
            rows += [(len(rows) + k, " ".join(copy), "en", "s", 0) for k in range(rng.choice([1, 2, 9]))]
    rows += [rows[0], (rows[1][0], *rows[-1][1:]), (rows[2][0], *rows[-1][1:]), (None, *rows[0][1:]), (rows[5][0], *rows[-2][1:])]
    expected = {}
    for (d, x), (e, y) in itertools.combinations([(r[0], ngrams(r[1])) for r in rows if r[0] is not None], 2):
        j = len(x & y) / len(x | y)
        if d != e and j >= ngram_join.THRESHOLD:
            expected[min(d, e), max(d, e)] = max(j, expected.get((min(d, e), max(d, e)), 0))
    for piece in (512, 2):
        got = ngram_join.all_pairs(frame(spark, rows), piece=piece).collect()
        assert len(got) == len(expected)
        assert {(r.doc_id_a, r.doc_id_b): r.jaccard for r in got} == pytest.approx(expected)
    assert ngram_join.all_pairs(frame(spark, [])).count() == 0


def test_query_gives_a_row_for_each_document(spark, tmp_path):
    one, two = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(58))
    rows = [(i, one if i < 4 else two, "en", "s", 0) for i in range(6)] + [(9, "alone", "en", "s", 0), (10, None, "en", "s", 0), (11, "", "en", "s", 0), (None, one, "en", "s", 0), (0, one, "en", "s", 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in ngram_join.query(spark, str(tmp_path)).select("doc_id", "class_id", "links").collect())
    assert got == [(i, 0, 5) for i in range(6)] + [(i, i, 0) for i in (9, 10, 11)]


def test_classes_lose_no_link(spark):
    rng, rows = random.Random(16), []
    for g in range(6):
        base = [f"w{g}x{rng.randint(0, 200)}" for _ in range(rng.choice([2, 3, 6, 40, 200]))]
        for _ in range(6):
            copy = [w if rng.random() > 0.05 else "new" + str(rng.randint(0, 9)) for w in base]
            rows += [(len(rows) + k, " ".join(copy), "en", "s", 0) for k in range(rng.choice([1, 1, 4]))]
    for more in ([], [rows[0], (rows[1][0], *rows[-1][1:]), (rows[2][0], *rows[-1][1:]), (None, *rows[0][1:]), (rows[5][0], *rows[-2][1:]), (999, None, "en", "s", 0)]):
        df = frame(spark, rows + more)
        same(ngram_join.classes(df, piece=2), sql(spark, df, ngram_join.classes_sql()))
    assert ngram_join.classes(frame(spark, [])).count() == 0


def test_frequent_ngrams_are_no_meeting_place():
    """Signatures rely on several shared n-grams, so those that most texts have are dropped from prefixes."""
    assert ngram_join.shared_at_least(0.6) == 12
    m, k, rng = 12, ngram_join.SIGNATURE, np.random.default_rng(1)
    for _ in range(300):  # sets of similarity 0.6 or a little more: the shared part is always seen
        both, rest = rng.integers(1, 2**63, 300, dtype=np.uint64), rng.integers(1, 2**63, 200, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, x])) for x in (rest[:100], rest[100:]))
        assert len(np.intersect1d(a[:k], b[:k])) >= m


def test_pairs_of_a_large_cluster_are_summed_where_they_are_found(spark, monkeypatch):
    """301 near copies have about 45,000 pairs; no table that is written has a row for each."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:100], f"x{i}", *base[101:]]), "en", "s", 0) for i in range(300)] + [(900, " ".join(base[:9]), "en", "s", 0)]
    df = frame(spark, rows + rows[:5] + [(300, *rows[0][1:])])
    written, tables = ngram_join.written, []
    monkeypatch.setattr(ngram_join, "written", lambda df: tables.append(written(df)) or tables[-1])
    got = ngram_join.classes(df)
    left = sorted(r.doc_id for r in ngram_join.one_of_each(df).collect())
    assert max(t.count() for t in tables) < 22_000 and left == [0, 0, 900]
    same(got, sql(spark, df, ngram_join.classes_sql()))


def test_few_pairs_are_looked_at_for_a_frequent_ngram(spark, monkeypatch):
    rng = random.Random(3)
    line = " ".join(f"c{i}" for i in range(20))
    rows = [(i, line + " " + " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(100)), "en", "s", 0) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more", "en", "s", 0) for i in range(3)]
    written, tables = ngram_join.written, []
    monkeypatch.setattr(ngram_join, "written", lambda df: tables.append(written(df)) or tables[-1])
    got = {(r.doc_id, r.class_id, r.links) for r in ngram_join.classes(frame(spark, rows)).where("links > 0").collect()}
    assert got == {(x, i, 1) for i in range(3) for x in (i, 1000 + i)}
    groups = next(t for t in tables if t.columns == ["key", "one", "two", "piece", "id"])
    assert groups.groupBy("key", "one", "two").count().agg(F.max("count")).first()[0] < 100


def test_tree_bound_never_drops_a_pair():
    rng = np.random.default_rng(0)
    own = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in rng.integers(1, 4000, 40)]
    own += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for s in own]
    sizes = np.array([len(s) for s in own])
    found = set()
    for key in {int(k) for s in own for k in s[: ngram_join.SIGNATURE]}:
        at = [i for i, s in enumerate(own) if np.uint64(key) in s[: ngram_join.SIGNATURE]]
        for i, j in ngram_join._candidates(key, np.stack([ngram_join._signature(own[a]) for a in at]), [ngram_join._vector(own[a]) for a in at], sizes[at], 0.6):
            for a, b in zip(i, j):
                pair = tuple(sorted((at[a], at[b])))
                assert pair not in found
                found.add(pair)
    for i, j in itertools.combinations(range(len(own)), 2):
        both = len(np.intersect1d(own[i], own[j]))
        if both / (sizes[i] + sizes[j] - both) >= 0.6:
            assert (i, j) in found


def test_small_groups_together_as_one_by_one():
    rng = np.random.default_rng(7)
    size, own, key = rng.integers(1, 9, 60), [], []
    for k, c in enumerate(size):
        base = rng.integers(1, 2**63, rng.integers(2, 900), dtype=np.uint64)
        own += [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(1, 2**63, 3, dtype=np.uint64)])) for _ in range(c)]
        key += [int(np.unique(base)[0])] * c
    signatures, packed, sizes = np.stack([ngram_join._signature(s) for s in own]), [ngram_join._vector(s) for s in own], np.array([len(s) for s in own])
    piece, split = rng.integers(0, 2, len(own)), np.repeat(rng.random(len(size)) < 0.5, size)
    expected, lo = set(), 0
    for c in size:
        at = slice(lo, lo + c)
        for i, j in ngram_join._candidates(key[lo], signatures[at], packed[at], sizes[at], 0.6, piece[at] if split[lo] else None):
            expected |= {(lo + min(a, b), lo + max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
        lo += c
    i, j = ngram_join._of_small(size, np.array(key, np.uint64), signatures, packed, sizes, 0.6, split, piece)
    assert set(zip(i.tolist(), j.tolist())) == expected and len(expected) > 50


def test_heavy_ngrams_are_split(spark, monkeypatch):
    rng, rows = random.Random(9), []
    common = " ".join(f"c{i}" for i in range(30))
    for i in range(90):  # of one set of frequent n-grams, with a word or more of their own
        rows.append((i, common + " " + " ".join(f"own{i}x{k}" for k in range(rng.choice([1, 4, 30]))), "en", "s", 0))
    expected = {}
    for (d, x), (e, y) in itertools.combinations([(r[0], ngrams(r[1])) for r in rows], 2):
        if len(x & y) / len(x | y) >= ngram_join.THRESHOLD:
            expected[d, e] = len(x & y) / len(x | y)
    for heavy in (2048, 7):
        monkeypatch.setattr(ngram_join, "HEAVY", heavy)
        got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in ngram_join.all_pairs(frame(spark, rows)).collect()}
        assert got == pytest.approx(expected) and len(got) > 1000
    same(ngram_join.all_pairs(frame(spark, rows)), sql(spark, frame(spark, rows), ngram_join.all_pairs_sql()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("doc_id_a"), (F.col("id") + 1).alias("doc_id_b")).repartition(7)
    assert {r.root for r in ngram_join.components(edges).collect()} == {0}
    assert ngram_join.components(edges.limit(0)).count() == 0


def test_mixing(spark):
    for rows in (PLAIN, made(300), made(300) + made(300)[:40]):
        df = frame(spark, rows)
        got = mixing.mix(df, {"src0": 3.0, "z": 0.5})
        same(got, sql(spark, df, mixing.mix_sql(weights={"src0": 3.0, "z": 0.5})))
        assert got.agg(F.sum("copies")).first()[0] == len(rows) == mixing.repeated(got).count()
    sizes = {r.source: r.n for r in mixing.mix(frame(spark, made(300)), {"src0": 1.0, "src1": 1.0}, 0.0, 500).groupBy("source").agg(F.sum("copies").alias("n")).collect()}
    assert sizes == {"src0": 250, "src1": 250}


def test_mixing_follows_inclusion_odds(spark):
    df = frame(spark, [(i, "x" * (10 if i % 2 else 30), "en", "s", 0) for i in range(4000)])
    got = dict(mixing.mix(df, {}, size=1000).groupBy(F.length("text")).agg(F.sum("copies")).collect())
    assert got[30] + got[10] == 1000 and abs(got[30] - 750) < 50


def test_shards(spark):
    empty = shards.shard(frame(spark, []))
    assert empty.count() == 0 and empty.columns[-1] == "shard_id"
    for rows, target in ((made(400), 2000), (made(400) + [(9, "y" * 300 + str(i), "en", "s", 0) for i in range(50)], 2000), (PLAIN, 100), (PLAIN, 1 << 20)):
        df = frame(spark, rows)
        got = shards.shard(df, target, least=1)
        same(got, sql(spark, df, shards.shard_sql(target=target, least=1)))
        whole = got.withColumn("part", F.spark_partition_id()).groupBy("shard_id").agg(F.countDistinct("part").alias("n"))
        assert whole.where("n > 1").count() == 0
        sizes = got.groupBy("shard_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n"), F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("most")).collect()
        repeats = max(r["count"] for r in df.groupBy("doc_id", "text").count().collect())
        assert all(r.n <= shards.OVER * target + repeats * r.most for r in sizes)
        assert got.count() == len(rows)


def test_shards_are_many_by_default(spark):
    df = frame(spark, [(i, "word " * (i % 37), "en", "s", 0) for i in range(3000)])
    got = shards.shard(df)
    assert got.select("shard_id").distinct().count() > 300
    same(got, sql(spark, df, shards.shard_sql()))


def test_token_counts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary = bpe.Vocabulary(bpe.VOCABULARY)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.rank, special_tokens={})
    rows = PLAIN + made(60)
    lengths = [len(other.encode_ordinary(r[1])) for r in rows if r[1] is not None]
    sums = token_counts.count(frame(spark, rows)).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.n_docs == lengths.count(n) and r.docs_over == sum(x > n for x in lengths) and r.total == sum(lengths)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.tokens_over == sum(x for x in lengths if x > n)
    for limit in (0, 1, 7, 100, 10**6):
        assert sums.agg(token_counts.truncated_total(sums, limit)).first()[0] == sum(min(x, limit) for x in lengths)
    assert sums.agg(token_counts.quantile(0.5)).first()[0] == sorted(lengths)[-(-len(lengths) // 2) - 1]


ALPHABET = ["a", "bc", "the", "in", "'s", "'t", "'ll", " ", "  ", "\n", "\t", "é", "½", "²", "9", "12", ",", ".", "!", "_", "中文", "​", "😀", "ⅷ", " "]


def test_bpe(spark):
    tiktoken = pytest.importorskip("tiktoken")
    enc = bpe.encoder(bpe.VOCABULARY)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.vocabulary.rank, special_tokens={})
    rng = random.Random(1)
    for i in range(2000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25)))
        if i % 2:
            enc.prepare([text])
        assert enc.encode(text).tolist() == other.encode_ordinary(text)
        assert enc.decode(enc.encode(text).tolist()) == text
        piece = text.encode()[:12]
        table = bpe.Prefixes(enc.vocabulary)
        for k in range(len(piece)):
            table.append(piece[k : k + 1])
            assert table.tokens() == enc.vocabulary.merged(piece[: k + 1]) == table.tokens(k + 1)
        doc = bpe.Document(enc, text)
        for _ in range(3):
            a = rng.randint(0, len(doc.text))
            doc.replace(a, rng.randint(a, len(doc.text)), rng.choice(ALPHABET) * rng.randint(0, 2))
            assert doc.tokens() == other.encode_ordinary(doc.text)
        doc.append(" and more")
        assert doc.tokens() == other.encode_ordinary(doc.text)
    long = bpe.Document(enc, "word " * 5000 + "end")
    assert long.replace(9999, 10003, "w") < 100
    solid = bpe.Document(enc, "abc" * 5000)  # one piece: an append encodes what is new alone
    assert solid.append("def") == 3 and solid.tokens() == other.encode_ordinary(solid.text)
    out = {r.doc_id: r for r in bpe.encode(frame(spark)).collect()}
    assert out[3].tokens is None and out[3].n_tokens is None and out[4].tokens == [] and all(r.exact for r in out.values() if r.text is not None)
    assert out[5].tokens == other.encode_ordinary(PLAIN[6][1])


def vocabulary(path, *tokens):
    """All single bytes and then `tokens`, as a rank file."""
    every = [bytes([i]) for i in range(256)] + list(tokens)
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(every)))
    return str(path)


def test_bpe_on_white_space(tmp_path):
    enc = bpe.Encoder(vocabulary(tmp_path / "v", b"\n ", b" \x1c", b" b", b"\n\n", b"\n \n", b"  ", b"\x1c\x1c"))
    t = {bytes(v): r for v, r in enc.vocabulary.rank.items()}
    one = lambda s: [t[bytes([c])] for c in s.encode()]
    for text, tokens in {
        "a\n ": one("a") + [t[b"\n "]],
        "a\n b": one("a\n") + [t[b" b"]],
        "a\n \nb": one("a") + [t[b"\n "]] + one("\nb"),
        "a \x1c": one("a") + [t[b" \x1c"]],
        "a \x1c\x1cb": one("a") + [t[b" \x1c"]] + one("\x1cb"),
        "  b": one(" ") + [t[b" b"]],
        "b  ": one("b") + [t[b"  "]],
        "\u3000 b": one("\u3000") + [t[b" b"]],
        "b \u2003": one("b \u2003"),
    }.items():
        for ahead in (False, True):
            if ahead:
                enc.prepare([text])
            assert enc.encode(text).tolist() == tokens, repr(text)
            assert bpe.Document(enc, text).tokens() == tokens and enc.decode(tokens) == text


def test_bpe_of_fixed_texts():
    enc = bpe.encoder(bpe.VOCABULARY)
    assert enc.encode("Hello world").tolist() == [15496, 995]
    assert enc.encode("hello, it's 42!\n\n  x").tolist() == [31373, 11, 340, 338, 5433, 0, 628, 220, 2124]
    assert enc.encode("").tolist() == []


def test_pieces_against_another_tokenizer(tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    enc = bpe.Encoder(vocabulary(tmp_path / "v", b"\n ", b" \x1c", b" b", b"\n\n", b"\n \n", b"  ", b" \x1c\x1d", b"\xc2\xa0", b"\xc2\xa0 "))
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=enc.vocabulary.rank, special_tokens={})
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", " ", " ", "\n", "\t", "\x1c", "\x1d", "\x1f", "\x85", "\xa0", "\u2003", "\u2028", "\u200b", "é", "'s", "1", "."]) for _ in range(rng.randint(0, 12)))
        enc.prepare([text])
        assert enc.encode(text).tolist() == other.encode_ordinary(text), repr(text)
        doc = bpe.Document(enc, text)
        a = rng.randint(0, len(text))
        doc.replace(a, rng.randint(a, len(text)), rng.choice(["", " ", "\n", "b", " b"]))
        assert doc.tokens() == other.encode_ordinary(doc.text), repr(doc.text)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    first = np.array([0, 4, 4, 5, 9])
    gold = rng.integers(0, 3, 9)
    e, switch = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))

    def likelihood(e, switch):
        """By summing over all label sequences; any label may stand before the first word."""
        total = 0.0
        for lo, hi in zip(first, first[1:]):
            if hi == lo:
                continue
            weight = lambda y: np.exp(switch[:, y[0]]).sum() * np.exp(sum(e[lo + t, y[t]] for t in range(hi - lo)) + sum(switch[y[t - 1], y[t]] for t in range(1, hi - lo)))
            total += np.log(weight(tuple(gold[lo:hi]))) - np.log(sum(weight(y) for y in itertools.product(range(3), repeat=hi - lo)))
        return total

    by_word, by_switch = langid.gradient(e, first, switch, gold)
    for x, got in ((e, by_word), (switch, by_switch)):
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = likelihood(e, switch)
            x[at] -= 2e-5
            down = likelihood(e, switch)
            x[at] += 1e-5
            assert got[at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.where("length(text) > 300")


def test_accuracy_on_spliced_words_and_junk(spark):
    import pyarrow as pa

    docs = held_out(spark)
    chosen = langid.sample(docs, 12)
    model = langid.train(chosen)
    seen = {t for _, t in chosen}
    rest = [(r.lang, r.text.split()) for r in docs.collect() if r.text not in seen and r.lang in model.labels and "###" not in r.text and "%%%" not in r.text]
    rng = random.Random(4)
    right = total = 0
    for _ in range(60):
        (a, x), (b, y) = rng.sample(rest, 2)
        x, y = x[:40], y[:40]
        _, _, n, accepted, starts, labels = next(langid.describe(model, langid.SHARE, pa.array([" ".join(x + y)])))
        got = [labels[sum(s <= i for s in starts) - 1] for i in range(n)]
        right += sum(g == (a if i < len(x) else b) for i, g in enumerate(got))
        total += n
    assert right / total > 0.85
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(60)) for _ in range(30)]
    assert sum(d[3] for d in langid.describe(model, langid.SHARE, pa.array(junk))) <= 3
    assert sum(d[3] for d in langid.describe(model, langid.SHARE, pa.array([" ".join(x) for _, x in rest]))) >= 0.97 * len(rest)


def test_the_sample_is_bounded(spark):
    rows = [(1, "the cat and the dog " * 4000 + str(i), "en", "s", 0) for i in range(30)] + [(2, "der Hund", "de", "s", 0)] * 20
    got = langid.sample(frame(spark, rows), 5, most=1000)
    assert len(got) == 6 and max(len(t) for _, t in got) == 1000
    assert langid.sample(frame(spark, []), 5) == []


def test_forward_backward_against_plain():
    rng = np.random.default_rng(0)
    first = np.array([0, 0, 3, 900, 1500])
    e, switch = rng.normal(size=(1500, 4)).astype(np.float32), rng.normal(size=(4, 4)).astype(np.float32)
    got = langid.posteriors(e, first, switch)
    for lo, hi in zip(first, first[1:]):
        x = np.exp(e[lo:hi]).astype(float)
        f, b, v = np.zeros_like(x), np.ones_like(x), np.full(4, 0.25)
        for t in range(len(x)):
            v = (v @ np.exp(switch)) * x[t]
            v /= v.sum()
            f[t] = v
        for t in range(len(x) - 2, -1, -1):
            b[t] = np.exp(switch) @ (x[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        g = f * b
        assert np.allclose(got[lo:hi], g / g.sum(1, keepdims=True), atol=1e-5)


def test_language_accuracy_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = {t for _, t in langid.sample(docs, 15)}
    held = langid.identify(docs, per_language=15).where("n_words >= 20").collect()
    held = [r for r in held if r.text not in seen]
    assert len(held) > 80 and sum(r.language == r.lang for r in held) / len(held) > 0.93
    out = {r.doc_id: r for r in langid.identify(frame(spark)).collect()}
    assert out[3].language is None and not out[3].accepted and not out[4].accepted and not out[7].accepted
    assert out[6].language == "de" and out[1].language == "en"
    assert langid.identify(frame(spark).withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == len(PLAIN)
    # code-switched words
    de, en = ("Der Hund und die Katze sind in dem Haus " * 3).strip(), ("The cat and the dog are in the house of " * 3).strip()
    model = langid.train([("de", de), ("en", en)] * 5)
    import pyarrow as pa

    _, share, n, _, starts, labels = next(langid.describe(model, 0.5, pa.array([en + " " + de])))
    assert labels == ["en", "de"] and abs(starts[1] - len(en.split())) <= 1 and n == len(en.split()) + len(de.split()) and 0.4 < share < 0.65


def test_rules(spark):
    rows = PLAIN + [(1000 + i, *r[1:]) for i, r in enumerate(made(100))] + [(200, "#%& " * 30, "en", "s", 0), (201, "AAA BBB CCC", "en", "s", 0), (202, "a. b! c?\n" * 20, "en", "s", 0), (203, "12 34 56", "en", "s", 0)]
    rows += [(300, "\n".join(f"- point {i} of it" for i in range(9)), "en", "s", 0), (301, "\n".join(f"line {i} goes on..." for i in range(9)), "en", "s", 0), (302, "\n\n".join(["the same"] * 5), "en", "s", 0), (303, " ".join(f"wo{i}rd" for i in range(60)), "en", "s", 0), (304, "the one two three four of " * 40, "en", "s", 0), (305, " ".join(f"wo{i}rd of the" for i in range(60)), "en", "s", 0)]
    df = frame(spark, rows)
    got = rules.keep(df)
    same(got, sql(spark, df, rules.keep_sql()))
    kept = {r.doc_id for r in got.collect()}
    assert {1, 2, 6, 305} <= kept and not kept & {3, 5, 7, 200, 201, 202, 203, 300, 301, 302, 303, 304}
    order = rules.estimate(df, rules.rules())
    runs = [[e.rule.name for e in rules.estimate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rules.rules())] for _ in range(5)]
    assert all(r == runs[0] for r in runs)
    assert {e.rule.name for e in order} == {r.name for r in rules.rules()} and order[0].rejected > 0
    assert rules.keep(df, list(reversed(rules.rules())), 5).count() == got.count()


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_top(rows, k):
    good = {(i, tuple(np.float32(v) for v in e)) for i, e, _ in rows if i is not None and e and len(e) == 6 and all(x is not None and x == x for x in e)}
    out = {}
    for i, e in good:
        best = {}
        for j, f in good:
            if i != j:
                s = round(float(np.dot(np.array(e, float), np.array(f, float))), 9)
                best[j] = max(best.get(j, -1e9), s)
        for j, s in best.items():
            out.setdefault(i, {})
            out[i][j] = max(out[i].get(j, -1e9), s)
    return {i: sorted(b.items(), key=lambda x: (-x[1], x[0]))[:k] for i, b in out.items()}


@pytest.mark.parametrize("kind", ["unit", "skewed", "ties", "tiny"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(3)
    n = {"tiny": 4}.get(kind, 300)
    x = rng.normal(size=(n, 6))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "skewed":
        x *= rng.pareto(1.0, size=(n, 1)) * [3, 2, 1, 0.1, 0.1, 0.1]
    if kind == "ties":
        x = np.round(x)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [rows[0], (1, rows[2][1], 0), (None, rows[0][1], 0), (900, None, 0), (901, [], 0), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (903, [float("nan")] * 6, 0), (904, [1.0], 0)]
    got = {}
    for r in topk.top_k(vectors(spark, rows).withColumn("rank", F.lit(1)), 7).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.neighbor_id, r.score))
    expected = brute_top(rows, 7)
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in expected.items()}
    for i, v in got.items():
        assert [s for _, s in v] == pytest.approx([s for _, s in expected[i]], abs=2e-6)
    assert topk.top_k(vectors(spark, [])).count() == 0


def test_top_k_of_negative_ids_and_odd_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i - 1500, [float(v) for v in x], 0) for i, x in enumerate(rng.normal(size=(2600, 4)))]
    rows += [(7777, [float(v) for v in x], 0) for x in rng.normal(size=(60, 4)) * 9] + [(-1, [1.0] * 4, 0), (8000, [1.0] * 5, 0), (8001, [2.0] * 3, 0), (8002, [3.0] * 3, 0), (8003, [1e200] * 3, 0)]
    df = vectors(spark, []).sparkSession.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = topk.top_k(df).cache()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.register("some", df.select("vec_id", "embedding").toPandas())
    con.execute("INSERT INTO embeddings SELECT * FROM some")
    expected = {(r[0], r[1]): r[2] for r in con.execute(f"SELECT vec_id, rank, neighbor_id FROM ({topk.top_k_sql()})").fetchall()}
    assert {(r.vec_id, r.rank): r.neighbor_id for r in got.collect()} == expected
    assert got.where("vec_id = 7777").count() == 10 and got.where("vec_id = 8000").count() == 0
    assert [r.neighbor_id for r in got.where("vec_id = 8001").collect()] == [8002]


@pytest.mark.parametrize("n, copies", [(1000, 3), (2500, 3), (2500, 5), (700, 100)])
def test_top_k_where_many_ids_have_several_vectors(n, copies):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(n // copies, 6)), copies, axis=0)
    x += rng.normal(size=x.shape) * 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = np.repeat(np.arange(n // copies), copies)
    mixed = rng.permutation(len(x))
    x, own = x[mixed], own[mixed]
    blocks = [(1 + 1e-12, own[lo : lo + topk.BLOCK], x[lo : lo + topk.BLOCK]) for lo in range(0, len(x), topk.BLOCK)]
    best = topk.search(own, x, blocks, topk.K)
    product = np.full((len(x), n // copies), -np.inf)
    np.maximum.at(product, (slice(None), own), np.round(x @ x.T, 9))
    product[np.arange(len(x)), own] = -np.inf
    for i, row in enumerate(product):
        order = np.lexsort((np.arange(len(row)), -row))[: min(topk.K, len(row) - 1)]
        assert best.id[i, : len(order)].tolist() == order.tolist()
        assert best.score[i, : len(order)] == pytest.approx(row[order], abs=2e-9)


def test_query_asks_every_fiftieth_id_of_all_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i - 1300, [float(v) for v in x], 0) for i, x in enumerate(rng.normal(size=(2600, 4)))] + [(50, [9.0] * 4, 0), (100, [1.0] * 3, 0), (7, [2.0] * 3, 0), (None, [1.0] * 4, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r["rank"]): r.neighbor_id for r in topk.query(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = {(r[0], r[1]): r[2] for r in con.execute(f"SELECT vec_id, rank, neighbor_id FROM ({topk.top_k_sql(every=topk.EVERY)})").fetchall()}
    assert got == expected and {i for i, _ in got} == set(range(-1300, 1300, 50))
    assert any(n % 50 for n in got.values())
