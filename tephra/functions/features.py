"""Features of keys for the learned filters and page predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tephra.functions.quantiles import ACCURACY, quantiles

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def key_profile(positives: DataFrame, accuracy: int = ACCURACY) -> dict[str, object]:
    """Bounds and exact quantiles (keys that occur) of the keys that exist: a few numbers, on the driver. accuracy: of a sketch that finds them."""
    keys = positives.select(F.col("key").cast("double").alias("key"))
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    found = quantiles(keys, "key", QUANTILES, accuracy=accuracy).first() if lo is not None else None
    return {"lo": lo, "hi": hi, "quantiles": list(found[0]) if found else []}


def boundary_features(fences: list[tuple[float, float]], key: Column | None = None) -> list[Column]:
    """6 numbers of a key by pages' bounds (min_key, max_key), in order: the page that it falls to by a search of the
    bounds and that page's place, distances to its bounds, whether it lies inside, and its place in the page."""
    x = (F.col("key") if key is None else key).cast("double")

    def search(lo: int, hi: int, leaf) -> Column:
        if hi - lo == 1:
            return leaf(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(fences[mid][0]), search(lo, mid, leaf)).otherwise(search(mid, hi, leaf))

    if not fences:
        return [F.lit(0.0).alias(f"b{i}") for i in range(6)]
    n = len(fences)
    at, low, high = (search(0, n, leaf) for leaf in (lambda i: F.lit(float(i)), lambda i: F.lit(fences[i][0]), lambda i: F.lit(fences[i][1])))
    out = [at, at / n, x - low, high - x, ((x >= low) & (x <= high)).cast("double"), F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))]
    return [c.alias(f"b{i}") for i, c in enumerate(out)]


def membership_features(profile: dict[str, object], key: Column | None = None) -> list[Column]:
    """45 numbers of a key: its place among the keys, distances, buckets, hashes and hash bits."""
    x = (F.col("key") if key is None else key).cast("double")
    lo, hi, qs = profile["lo"], profile["hi"], profile["quantiles"]
    span = max(hi - lo, 1e-12)
    out = [x, (x - lo) / span, F.signum(x) * F.log1p(F.abs(x)), F.log1p(F.abs(F.lit(hi) - x))]
    out += [(x - q) / span for q in qs]
    edges = [None, *qs, None]
    for a, b in zip(edges, edges[1:]):
        low = F.lit(True) if a is None else x >= F.lit(a)
        high = F.lit(True) if b is None else x < F.lit(b)
        out.append((low & high).cast("double"))
    hashes = [F.xxhash64(x, F.lit(s)) for s in range(6)]
    out += [F.pmod(h, F.lit(1000)).cast("double") / 1000 for h in hashes]
    out += [F.shiftright(hashes[0], i).bitwiseAND(F.lit(1)).cast("double") for i in range(24)]
    return [c.alias(f"f{i}") for i, c in enumerate(out)]


def filter_features(profile: dict[str, object], examples: list[float], key: Column | None = None) -> list[Column]:
    """9 numbers: raw twice, place, clipped distances to both ends, in range, nearest of some examples, is an example, hash."""
    x = (F.col("key") if key is None else key).cast("double")
    lo, hi = profile["lo"], profile["hi"]
    span = max(hi - lo, 1e-12)
    some = F.array(*[F.lit(float(e)) for e in examples[:100]]) if examples else F.array(F.lit(lo))
    nearest = F.array_min(F.transform(some, lambda e: F.abs(e - x)))
    out = [
        x,
        F.signum(x) * F.log1p(F.abs(x)),
        (x - lo) / span,
        F.least(F.greatest((x - lo) / span, F.lit(-1.0)), F.lit(1.0)),
        F.least(F.greatest((F.lit(hi) - x) / span, F.lit(-1.0)), F.lit(1.0)),
        x.between(lo, hi).cast("double"),
        F.least(nearest / span, F.lit(1.0)),
        (nearest == 0).cast("double"),
        F.pmod(F.xxhash64(x), F.lit(10000)).cast("double") / 10000,
    ]
    return [c.alias(f"f{i}") for i, c in enumerate(out)]


def page_features(profile: dict[str, object], pages: int) -> list[Column]:
    """12 numbers of a key for page prediction: place, quantile distances, buckets."""
    x = F.col("key").cast("double")
    lo, hi, qs = profile["lo"], profile["hi"], profile["quantiles"]
    span = max(hi - lo, 1e-12)
    place = (x - lo) / span
    out = [x, place, F.signum(x) * F.log1p(F.abs(x)), place * pages, F.floor(place * pages).cast("double"), place * place, F.sqrt(F.greatest(place, F.lit(0.0)))]
    out += [(x - q) / span for q in qs]
    return [c.alias(f"f{i}") for i, c in enumerate(out)]


def heuristic_score(profile: dict[str, object], key: Column | None = None) -> Column:
    """Membership score without a model: near 0 out of range, less the farther away."""
    x = (F.col("key") if key is None else key).cast("double")
    lo, hi = profile["lo"], profile["hi"]
    span = max(hi - lo, 1e-12)
    outside = F.greatest(F.lit(lo) - x, x - F.lit(hi), F.lit(0.0)) / span
    return F.when(x.between(lo, hi), 0.9).when(outside < 0.1, 0.25 * (1 - outside * 10) + 0.05).otherwise(0.05)
