"""Scalars: rounding, points, decay, blends, bands, names and paths. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the bands of a score begin.
LEVELS = {"critical": 75, "high": 55, "medium": 35}


def round_half_away(v: Column, digits: int = 0) -> Column:
    """Multiply, round half away from zero, divide; in doubles, as the scores need it (not the decimal round())."""
    scale = float(10**digits)
    x = v.cast("double") * F.lit(scale)
    return F.when(x >= 0, F.floor(x + 0.5).cast("double")).otherwise(F.ceil(x - 0.5).cast("double")) / F.lit(scale)


def whole(v: Column) -> Column:
    return round_half_away(v).cast("int")


def points(v: Column, per: float, start: float, most: float) -> Column:
    """Linear points beyond a start, at most so many."""
    return F.least(F.lit(float(most)), F.greatest(F.lit(0.0), v.cast("double") - F.lit(float(start))) * F.lit(float(per)))


def half_life(age: Column, days: float) -> Column:
    """0.5 to the power of age in half lives; ages below 0 count as 0."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / F.lit(float(days)))


def age_days(ts: Column, ref: Column) -> Column:
    """Fractional days from ts to ref (TIMESTAMP_NTZ or TIMESTAMP)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(ref) - micros(ts)).cast("double") / F.lit(86400e6)


def level(score: Column, cuts: dict[str, int] = LEVELS) -> Column:
    """The name of the highest band that the score reaches, else low."""
    out = F
    for name, cut in sorted(cuts.items(), key=lambda x: -x[1]):
        out = out.when(score >= cut, name)
    return out.otherwise("low")


def damped(n: Column) -> Column:
    """1 + ln(n), for n below 1 as for 1."""
    return 1 + F.log(F.greatest(F.lit(1.0), n.cast("double")))


def bounded(score: Column, floor: Column | None = None, cap: Column | None = None) -> Column:
    """At least the floor, then at most the cap; null is no bound."""
    out = score if floor is None else F.greatest(score, F.coalesce(floor, score))
    return out if cap is None else F.least(out, F.coalesce(cap, out))


def blend(rank: Column, rollback: Column, floor: Column | None = None, cap: Column | None = None, w_rank: float = 0.55, w_rollback: float = 0.45) -> Column:
    """The impact score of a rank and a rollback score."""
    return bounded(whole(F.lit(w_rank) * rank.cast("double") + F.lit(w_rollback) * rollback.cast("double")), floor, cap)


def prior_base(impact: Column, likelihood: Column) -> Column:
    """Geometric mean; what isn't known counts 50."""
    both = F.coalesce(impact, F.lit(50)).cast("double") * F.coalesce(likelihood, F.lit(50)).cast("double")
    return whole(F.sqrt(both))


def total(prior: Column, trust: Column, clean: Column, attention: Column) -> Column:
    """The prior less the trust that a clean review earns, but not below the review's attention."""
    return F.greatest(attention, whole(prior.cast("double") * (1 - trust * clean)))


def tally(scores: Column) -> Column:
    """Sum of the factors of 0.5 or more, unrounded, then rounded once and at most 100."""
    kept = F.filter(scores, lambda x: x >= 0.5)
    return F.least(F.lit(100), whole(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)))


# names and paths


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Without the last part; empty for a path of one part."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def ancestors(path: Column, itself: bool = False) -> Column:
    """All directories that hold a path, shallow first (and the path itself)."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if itself else 1)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(n >= 1, some).otherwise(F.array().cast("array<string>"))


def normal_symbol(s: Column) -> Column:
    """(*T).M and (T).M as T.M."""
    return F.regexp_replace(F.trim(s), r"^\(\*?([^)]*)\)\.", "$1.")


def normal_operation(s: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{Nd}]", ""))


def short_name(symbol: Column) -> Column:
    return F.element_at(F.split(normal_symbol(symbol), r"\."), -1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))


def url_path(url: Column) -> Column:
    """Without host, query and fragment."""
    return F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def hash_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def truncated(text: Column, most: int, mark: str) -> Column:
    """struct(text, truncated): at most so many characters, with a mark if some were cut."""
    long = F.char_length(text) > most
    return F.struct(F.when(long, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text).alias("text"), long.alias("truncated"))


# ordered folds over arrays


def greedy_fill(sizes: Column, budget: int) -> Column:
    """Booleans: what is taken if items are taken in order while they fit; one that is too long is skipped."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def take(a: Column, x: Column) -> Column:
        fits = a["used"] + x <= budget
        return F.struct((a["used"] + F.when(fits, x.cast("bigint")).otherwise(0)).alias("used"), F.concat(a["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(sizes, start, take, lambda a: a["taken"])


def pack(sizes: Column, limit: int) -> Column:
    """Batch numbers from 0: an item that would take a batch beyond the limit starts the next."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("of"))

    def put(a: Column, x: Column) -> Column:
        new = (a["used"] > 0) & (a["used"] + x > limit)
        batch = a["batch"] + new.cast("int")
        return F.struct((F.when(new, F.lit(0).cast("bigint")).otherwise(a["used"]) + x).alias("used"), batch.alias("batch"), F.concat(a["of"], F.array(batch)).alias("of"))

    return F.aggregate(sizes, start, put, lambda a: a["of"])
