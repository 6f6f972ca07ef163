"""Both substring operators against plain enumeration."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F
from tephra.llm import suffix_array, suffix_tree, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[ \t\n\r\v\f]+", text or "") if w]


def brute(rows, least):
    """{(n_words, occurrences)} of maximal repeats; rows: distinct (doc_id, text)."""
    docs = [(d, words(t)) for d, t in rows]
    out = set()
    longest = max((len(w) for _, w in docs), default=0)
    for n in range(least, longest + 1):
        where = defaultdict(list)
        for r, (d, w) in enumerate(docs):
            for i in range(len(w) - n + 1):
                where[tuple(w[i : i + n])].append((r, i))
        for places in where.values():
            if len(places) > 1:
                left = {docs[r][1][i - 1] if i else (r, "start") for r, i in places}
                right = {docs[r][1][i + n] if i + n < len(docs[r][1]) else (r, "end") for r, i in places}
                if len(left) > 1 and len(right) > 1:
                    out.add((n, tuple(sorted(((docs[r][0], i) for r, i in places), key=repr))))
    return out


def cuts(groups):
    """What the tree operator gives: the longest repeat of each place that has an earlier occurrence."""
    best = {}
    for n, places in groups:
        places = sorted(places, key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
        first = places[0]
        for d, i in places[1:]:
            if d != first[0] or i - first[1] >= n:
                best[d, i] = max(best.get((d, i), 0), n)
    return best


def groups(rows):
    """[(n_words, occurrences)] of rows that are one occurrence, or a run of them, each."""
    found = defaultdict(list)
    for r in rows:
        found[r.repeat_hash, r.n_words] += [(r.doc_id, r.start + t) for t in range(r.times)]
    return [(n, tuple(sorted(places, key=repr))) for (_, n), places in found.items()]


def unnested(rows):
    """[(n_words, occurrences)] of rows that give each place once."""
    own, above, size, count = defaultdict(set), {}, {}, {}
    for r in rows:
        own[r.repeat_hash] |= {(r.rid, r.doc_id, r.start + t) for t in range(r.times)}
        above[r.repeat_hash], size[r.repeat_hash], count[r.repeat_hash] = r.parent, r.n_words, r.occurrences
    every = {h: set(p) for h, p in own.items()}
    for h, places in own.items():
        while above[h] is not None:
            assert size[above[h]] < size[h]
            h = above[h]
            every[h] |= places
    assert all(len(every[h]) == count[h] for h in every)
    return [(size[h], tuple(sorted(((d, i) for _, d, i in places), key=repr))) for h, places in every.items()]


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "dé", "e", "f"][: rng.choice([1, 2, 3, 6])]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 25))] for _ in range(3)]
    rows = []
    for d in range(rng.randint(2, 9)):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3 and text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        rows.append((d, rng.choice([" ", "\n", "  "]).join(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(4))
def test_against_enumeration(spark, seed):
    rows = sample(seed)
    for least in (4, 7):
        expected = brute(rows, least)
        for memory in (1 << 20, 10):
            got = suffix_array.repeats(frame(spark, rows), least, memory).collect()
            assert set(groups(got)) == expected
            assert len(groups(got)) == len(expected) == len({r.repeat_hash for r in got})
            assert sorted(unnested(suffix_array.nested(frame(spark, rows), least, memory).collect())) == sorted(groups(got))
            tree = suffix_tree.repeats(frame(spark, rows), least, memory).collect()
            assert {(r.doc_id, r.start): r.n_words for r in tree} == cuts(expected)


def test_cases(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, "x " + passage + " y"), (1, "x " + passage + " y"), (None, "u " + passage + " v"), (2, None), (3, ""), (4, passage), (5, "s " + passage * 1 + " " + "z" * 50000), (1, "other " + passage)]
    distinct = list(dict.fromkeys(r for r in rows if r[1]))
    expected = brute(distinct, 10)
    got = suffix_array.repeats(frame(spark, rows), 10).collect()
    assert set(groups(got)) == expected
    assert dict(suffix_array.repeats(frame(spark, rows), 10).dtypes)["doc_id"] == "bigint"
    tree = suffix_tree.repeats(frame(spark, rows).withColumnRenamed("lang", "key").withColumnRenamed("source", "rid"), 10).collect()
    assert {(r.doc_id, r.start) for r in tree} == set(cuts(expected))
    left = suffix_array.deduplicate(frame(spark, rows), 10)
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    texts = {(r.doc_id, r.text) for r in left.collect()}
    assert (None, "u " + passage + " v") in texts and (2, None) in texts and (3, "") in texts
    assert (1, "x y") in texts and (1, "other ") in texts and not any(d == 4 for d, _ in texts)
    assert all(r.n_chars == len(r.text) for r in left.where("text IS NOT NULL").collect())


def test_texts_of_one_id_are_cut_each(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, f"{passage} n{i}") for i in range(4)] + [(1, f"{passage} o{i}") for i in range(3)] + [(1, f"{passage} o0")]
    got = suffix_tree.repeats(frame(spark, rows), 10).collect()
    assert sorted((r.doc_id or 0, r.start, r.n_words) for r in got) == [(0, 0, 12)] * 3 + [(1, 0, 12)] * 3
    assert len({r.rid for r in got}) == 6


def test_anchors_past_24_bits_of_words():
    n = (1 << 24) + 300
    h = np.random.default_rng(2).integers(0, 2**63, n, dtype=np.uint64)
    g, start, chosen = suffixes.anchors(h, np.array([0, n]), 6)
    windows = np.lib.stride_tricks.sliding_window_view(g >> np.uint64(24), 4)
    assert len(start) == n - 5
    for some in (slice(0, 1000), slice(-1000, None)):
        assert (chosen[some] == start[some] + windows[start[some]].argmin(1)).all()


def test_rows_of_nested_repeats_grow_with_places(spark, tmp_path):
    """Passages that end one word after the other: each is a repeat in all that are longer."""
    passage = [f"p{i}" for i in range(140)]
    rows = [(d, " ".join([f"a{d}", *passage[: 60 + d], f"b{d}"])) for d in range(70)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = suffix_array.query(spark, str(tmp_path)).collect()
    full = groups(suffix_array.repeats(frame(spark, rows)).collect())
    assert sorted(unnested(got)) == sorted(full) and sum(len(p) for _, p in full) > 2000
    assert len(got) <= 2 * len(rows)
    assert {r.doc_id for r in got} == set(range(70))
    assert suffix_array.nested(frame(spark, [])).count() == 0


def test_names_that_the_operator_uses_itself(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    df = frame(spark, [(1, "x " + passage), (2, "y " + passage)])
    names = ["__start", "__n", "__cuts", "__rid", "__own", "rid", "at", "key", "opens", "before", "___rid"]
    for name in names:
        df = df.withColumn(name, F.lit("mine"))
    left = suffix_array.deduplicate(df, 10)
    assert left.columns == df.columns and {(r.doc_id, r.text) for r in left.collect()} == {(1, "x " + passage), (2, "y ")}
    assert all(r[n] == "mine" for r in left.collect() for n in names)
    assert suffix_array.repeats(df, 10).count() == 2


def test_a_long_text_of_distinct_words(spark):
    long = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(long)), (2, "head " + " ".join(long[150_000:150_040]) + " tail"), (3, "w" * 300_000)]
    got = suffix_array.repeats(frame(spark, rows), 20).collect()
    assert groups(got) == [(40, ((1, 150_000), (2, 1)))]


def test_empty(spark):
    none = frame(spark, [])
    assert suffix_array.repeats(none).count() == suffix_tree.repeats(none).count() == suffix_array.deduplicate(none).count() == 0
