"""Language ID of the words of code-switched texts by a linear-chain CRF.

A word's features are its bytes' n-grams, its affixes and its entries in word
lists of each language. Transitions between the languages of neighbouring words
are learned with the feature weights, by the exact gradient of the likelihood, on
sequences spliced from labelled texts. One more label, OTHER, stands for what is no
known language; it is learned from the sample's words with their letters shuffled.
Whole texts are labelled by forward-backward. Long ones are cut into blocks whose
transfer matrices carry the exact messages across, so that all blocks of a batch
advance together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tephra.llm import words as W
from tephra.llm.frames import documents, mapped, uniform, with_fields

#: Bound of the labelled sample: texts of each language.
SAMPLE = 150
#: Characters of a sampled text that the model is fitted on.
SAMPLE_CHARS = 20_000
#: Hashed n-gram and affix features; word-list features follow.
SLOTS = 1 << 16
LISTED = 200
BLOCK = 256
CHUNK = 1 << 20
#: A text is kept if known languages have this share of its words' probability, OTHER the rest.
SHARE = 0.5
OTHER = "other"
#: Training sequences for each label, the most spans that one is spliced from, and a span's least and most words.
SEQUENCES = 100
SPANS = 4
SPAN_WORDS = (3, 39)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Model:
    """weights: (features, labels); switch: (labels, labels) log scores; listed: word hashes by label."""

    def __init__(self, labels: list[str], listed: list[np.ndarray]):
        self.labels, self.listed = labels, listed
        self.weights = np.zeros((SLOTS + len(labels) + 1, len(labels)), np.float32)
        self.switch = np.where(np.eye(len(labels), dtype=bool), 0.0, -3.0).astype(np.float32)

    def features(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words one after another, and where each word's begin."""
        n = len(start)
        size = (end - start) + 2
        at = np.zeros(n + 1, np.int64)
        np.cumsum(size, out=at[1:])
        total = int(at[-1])
        word = np.repeat(np.arange(n), size)
        inside = np.arange(total) - at[word]
        letters = np.zeros(total + 3, np.uint64)
        source = np.clip(start[word] + inside - 1, 0, max(len(data) - 1, 0))
        letters[:total] = _LOWER[data[source]] if len(data) else 0
        first, last = inside == 0, inside == size[word] - 1
        letters[:total][first] = 1
        letters[:total][last] = 2
        a, b, c, d = (letters[k : k + total] for k in range(4))
        left = size[word] - inside  # bytes from here to the end mark
        two = a | b << np.uint64(8)
        three, four = two | c << np.uint64(16), two | c << np.uint64(16) | d << np.uint64(24)
        kinds = [(two, left >= 2, 1), (three, left >= 3, 2), (four, left >= 4, 3)]
        found, owner = [], []
        for value, there, kind in kinds:
            found.append(W.mix(value[there] * np.uint64(8) + np.uint64(kind)) % np.uint64(SLOTS))
            owner.append(word[there])
        for k in (2, 3, 4):  # affixes: the same bytes, but told from n-grams within the word
            long = np.flatnonzero(size - 2 >= k)
            for where, kind in ((at[:-1][long] + 1, 4), (at[1:][long] - 1 - k, 5)):
                value = np.zeros(len(long), np.uint64)
                for j in range(k):
                    value = value << np.uint64(8) | letters[where + j]
                found.append(W.mix(value * np.uint64(64) + np.uint64(8 * k + kind)) % np.uint64(SLOTS))
                owner.append(long)
        for y, listed in enumerate(self.listed):
            if len(listed):
                place = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
                hit = np.flatnonzero(listed[place] == hashes)
                found.append(np.full(len(hit), SLOTS + y, np.uint64))
                owner.append(hit)
        found.append(np.full(n, SLOTS + len(self.labels), np.uint64))
        owner.append(np.arange(n))
        owner, found = np.concatenate(owner), np.concatenate(found).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=n)
        begin = np.zeros(n, np.int64)
        np.cumsum(counts[:-1], out=begin[1:])
        return found[order], begin

    def emissions(self, data, start, end, hashes) -> np.ndarray:
        """Log scores of the words' labels; words without letters tell nothing."""
        if not len(start):
            return np.zeros((0, len(self.labels)), np.float32)
        feature, begin = self.features(data, start, end, hashes)
        out = np.add.reduceat(self.weights[feature], begin, axis=0)
        lettered = np.concatenate([[0], np.cumsum(_LETTER[data])])
        out[lettered[end] == lettered[start]] = 0
        return out


def messages(emission: np.ndarray, first: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at each word, each scaled to a sum of one; sequence i is first[i]:first[i + 1].

    A label of equal chances stands before each sequence.
    """
    n, k = emission.shape
    if not n:
        return emission, emission
    score = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(switch - switch.max()).astype(np.float32)
    size = np.diff(first)
    blocks = (size + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(size)), blocks)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = first[:-1][owner] + index * BLOCK
    length = np.minimum(BLOCK, first[1:][owner] - begin)
    order = np.argsort(-length, kind="stable")
    owner, index, begin, length = owner[order], index[order], begin[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, BLOCK + 1), "right")  # blocks that have word t
    steps = int(length[0])
    m = len(owner)
    where = np.full((len(size), int(blocks.max())), -1)
    where[owner, index] = np.arange(m)
    enter, leave = np.full((m, k), 1.0 / k, np.float32), np.ones((m, k), np.float32)
    if where.shape[1] > 1:
        move = np.tile(np.eye(k, dtype=np.float32), (m, 1, 1))
        many = blocks[owner] > 1
        for t in range(steps):
            b = np.flatnonzero(many[: alive[t]])
            if not len(b):
                break
            x = (move[b].reshape(-1, k) @ step).reshape(-1, k, k) * score[begin[b] + t][:, None, :]
            move[b] = x / x.sum((1, 2), keepdims=True)
        for j in range(1, where.shape[1]):
            has = where[:, j] >= 0
            here, before = where[has, j], where[has, j - 1]
            x = np.einsum("ij,ijk->ik", enter[before], move[before])
            enter[here] = x / x.sum(1, keepdims=True)
        for j in range(where.shape[1] - 2, -1, -1):
            has = where[:, j + 1] >= 0
            here, after = where[has, j], where[has, j + 1]
            x = np.einsum("ijk,ik->ij", move[after], leave[after])
            leave[here] = x / x.sum(1, keepdims=True)
    ahead, back = np.empty((n, k), np.float32), np.empty((n, k), np.float32)
    x = enter
    for t in range(steps):
        at = begin[: alive[t]] + t
        x = (x[: alive[t]] @ step) * score[at]
        x /= x.sum(1, keepdims=True)
        ahead[at] = x
    x = leave
    for t in range(steps - 1, -1, -1):
        at, live = begin[: alive[t]] + t, alive[t]
        y = x[:live]
        back[at] = y
        y = (score[at] * y) @ step.T
        y /= y.sum(1, keepdims=True)
        x[:live] = y
    return ahead, back


def posteriors(emission: np.ndarray, first: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Forward-backward: marginals of each word."""
    ahead, back = messages(emission, first, switch)
    out = ahead * back
    return out / out.sum(1, keepdims=True) if len(out) else out


def gradient(emission: np.ndarray, first: np.ndarray, switch: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the labels' log likelihood, by each word's scores and by the transitions."""
    k = emission.shape[1]
    ahead, back = messages(emission, first, switch)
    p = ahead * back
    p /= p.sum(1, keepdims=True)
    by_word = np.eye(k, dtype=np.float32)[gold] - p
    step = np.exp(switch - switch.max())
    heads = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(gold), bool)
    inner[heads] = False
    pairs = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[pairs - 1], gold[pairs]), 1)
    # probability of each pair of labels: what comes before, the step, the word and what comes after
    score = np.exp(emission - emission.max(1, keepdims=True))
    both = ahead[pairs - 1][:, :, None] * step[None] * (score * back)[pairs][:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    # the label before the first word isn't observed
    start = step / step.sum(0)
    return by_word, seen - both.sum(0, dtype=np.float64) + start * by_word[heads].sum(0, dtype=np.float64)


def _shuffled(w: W.Words, a: int, b: int, rng: np.random.Generator) -> bytes:
    """Words a to b - 1 with the letters of each in another order."""
    return " ".join("".join(rng.permutation([*word])) for word in w.text(a, b).decode("utf-8", "replace").split()).encode()


def train(texts: list[tuple[str, str]], epochs: int = 6, seed: int = 5, sequences: int = SEQUENCES, spans: int = SPANS, span_words: tuple[int, int] = SPAN_WORDS) -> Model | None:
    """texts: (language, text). None if there is no labelled word.

    The weights are fitted on `sequences` spliced sequences for each label, each of 1 to
    `spans` spans of `span_words` words of one language or of OTHER; the word lists on all texts.
    """
    labels = sorted({lang for lang, _ in texts})
    per: dict[str, list[W.Words]] = {y: [] for y in labels}
    for lang, text in sorted(texts):
        w = W.of_bytes(text.encode("utf-8", "surrogatepass"))
        if len(w.hash):
            per[lang].append(w)
    labels = [y for y in labels if per[y]]
    if not labels:
        return None
    listed = []
    for y in labels:
        h, c = np.unique(np.concatenate([w.hash for w in per[y]]), return_counts=True)
        listed.append(np.sort(h[np.argsort(-c, kind="stable")[:LISTED]]))
    model = Model([*labels, OTHER], [*listed, np.zeros(0, np.uint64)])
    rng = np.random.default_rng(seed)
    k = len(model.labels)
    first, parts, gold, count = [0], [], [], 0
    for _ in range(sequences * k):  # most of them switch language
        for _ in range(rng.integers(1, spans + 1)):
            y = int(rng.integers(k))
            source = per[labels[y if y < len(labels) else int(rng.integers(len(labels)))]]
            w = source[int(rng.integers(len(source)))]
            a = int(rng.integers(len(w.hash)))
            b = min(len(w.hash), a + int(rng.integers(span_words[0], span_words[1] + 1)))
            part = w.text(a, b) if y < len(labels) else _shuffled(w, a, b, rng)
            n = len(W.of_bytes(part).hash)
            parts.append(part)
            gold.append(np.full(n, y))
            count += n
        first.append(count)
    every = W.of_bytes(b" ".join(parts))
    first, gold = np.array(first), np.concatenate(gold)
    feature, begin = model.features(every.data, every.start, every.end, every.hash)
    sizes = np.diff(np.append(begin, len(feature)))
    owner = np.repeat(np.arange(len(begin)), sizes)
    square, square2 = np.full_like(model.weights, 1e-2), np.full_like(model.switch, 1e-2)
    for _ in range(epochs * 5):
        e = np.add.reduceat(model.weights[feature], begin, axis=0)
        by_word, by_switch = gradient(e, first, model.switch, gold)
        up = np.stack([np.bincount(feature, by_word[owner, y], len(model.weights)) for y in range(k)], 1).astype(np.float32) / 50 - 1e-3 * model.weights
        square += up**2
        model.weights += 0.3 * up / np.sqrt(square)
        change = (by_switch / 50).astype(np.float32)
        square2 += change**2
        model.switch += 0.1 * change / np.sqrt(square2)
    return model


def sample(docs: DataFrame, per_language: int = SAMPLE, seed: int = 11, most: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """Labelled texts for training: those of the smallest hashes of each language, up to `most` characters of each.

    Rows that repeat an id and a text count once.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    u = uniform(seed, F.col("doc_id"), F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "h"))
    keys = known.select("lang", "doc_id", F.xxhash64("text").alias("h"), u.alias("u")).distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).drop("u", "rank")
    if keys.isEmpty():
        return []
    rows = known.withColumn("h", F.xxhash64("text")).select("lang", "doc_id", "h", F.substring("text", 1, most).alias("text"))
    rows = rows.join(F.broadcast(keys), ["lang", "doc_id", "h"]).dropDuplicates(["lang", "doc_id", "h"])  # per_language keys a language
    return sorted((r["lang"], r["text"]) for r in rows.select("lang", "text").collect())


def describe(model: Model, share: float, texts: pa.Array):
    """For each text: language, its share, words, accepted, runs of labels (first word, label)."""
    k = len(model.labels)
    known = k - 1
    for a, b in W.chunks(texts, CHUNK):
        w = W.Words(texts, a, b)
        _, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        e = model.emissions(w.data, w.start[at], w.end[at], w.hash[at])[back]
        p = posteriors(e, w.first, model.switch)
        lettered = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
        tells = (lettered[w.end] > lettered[w.start])[:, None]
        sums = np.zeros((len(p) + 1, k))
        np.cumsum(p * tells, axis=0, out=sums[1:])
        count = np.concatenate([[0], np.cumsum(tells[:, 0])])
        mass, told = sums[w.first[1:]] - sums[w.first[:-1]], np.diff(count[w.first])
        best = p.argmax(1) if len(p) else np.zeros(0, int)
        change = np.ones(len(best), bool)
        change[1:] = best[1:] != best[:-1]
        heads = w.first[:-1][np.diff(w.first) > 0]
        change[heads] = True
        runs = np.flatnonzero(change)
        edge = np.searchsorted(runs, w.first)
        for i in range(b - a):
            r = runs[edge[i] : edge[i + 1]]
            if told[i]:
                y = int(mass[i][:known].argmax())
                top, all_known = float(mass[i][y] / told[i]), float(mass[i][:known].sum() / told[i])
                yield model.labels[y], round(top, 4), int(w.first[i + 1] - w.first[i]), all_known >= share, (r - w.first[i]).tolist(), [model.labels[j] for j in best[r]]
            else:
                yield None, None, int(w.first[i + 1] - w.first[i]), False, [], []


def identify(docs: DataFrame, share: float = SHARE, per_language: int = SAMPLE) -> DataFrame:
    """`docs` with language, language_share, n_words, accepted, run_start and run_language.

    language is the known one of the most words; a text is accepted if known languages
    together have `share` of its words' probability, so a text in several languages is,
    and one in an unknown language or of junk isn't. run_language may be OTHER.
    A text whose words have no letters, an empty text and a null text have a null
    language and aren't accepted. Without any labelled row there is no model: no
    language, and every row is accepted, null texts too. Repeated rows get equal answers. Input
    columns of the new names are replaced; others are passed through.
    """
    docs = docs.drop("language", "language_share", "n_words", "accepted", "run_start", "run_language")
    model = train(sample(docs, per_language))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    out = with_fields(docs, "language string, language_share double, n_words int, accepted boolean, run_start array<int>, run_language array<string>")
    kinds = [pa.string(), pa.float64(), pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches):
        known = shared.value
        for batch in batches:
            texts = W.column(batch, "text")
            if known is None:
                new = [[None] * len(texts), [None] * len(texts), [None] * len(texts), [True] * len(texts), [[]] * len(texts), [[]] * len(texts)]
            else:
                new = list(zip(*describe(known, share, texts))) if len(texts) else [[]] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(new, kinds))], names=[*batch.schema.names, *(f.name for f in out.fields[-6:])])

    return docs.transform(mapped, run, out)


def query(spark, sf_dir: str) -> DataFrame:
    """The texts that are accepted, with their labels."""
    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang")).where("accepted").drop("text")
