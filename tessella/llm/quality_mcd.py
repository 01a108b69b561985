"""Quality rules: multivariate outliers by minimum covariance determinant, per language and source.

Every document gets word statistics from its whole text. Four of them, transformed towards symmetry, form
a vector. Each (language, source) group gets a robust location and scatter, and a document is rejected
when its squared Mahalanobis distance passes a chi-square cutoff.

The estimate is a deterministic MCD. Vectors are first centred by exact medians and scaled by exact MADs,
each row counted. Three starts (independent axes, spatial signs, hyperbolic tangents) are concentrated side
by side: weigh the ``h`` closest rows by one, all others by zero, and take their mean and covariance anew,
until no start of any group lowers its determinant any more. The start with the least determinant is
kept, and reweighted once by the rows within a chi-square quantile. Rows of the distance bucket (a
thirty-second of a bit) in which the ``h``-th lies count by the share that is due, so that all weights add
up to ``h`` and ties need no order.

All groups are treated alike: the estimate of a group of n rows is averaged with that of all rows together
by n and ``prior`` rows. What a group of few rows lacks thus comes from all, and large ones stay as they are.

Each step is one aggregation with map-side combine into (group, distance bucket) moments, so no group is
ever gathered in one task however many rows it has. Vectors are fixed-point integers, so sums are exact and
results don't depend on how rows are partitioned.

Everything runs as Spark expressions: no Python code touches a row.

Defined results: a null or wordless text has zero words and fails the base rules; null language and source
act as empty strings; repeated rows each count and get equal verdicts; texts of any length are read whole;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessella.runtime import materialize

#: White space that separates words, as escapes of a Java character class.
SPACE = r"\x20\x09-\x0D"
_SPACE_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Fixed point of the transformed statistics.
UNIT = 1024
DIMS = 4
PAIRS = list(combinations_with_replacement(range(DIMS), 2))


@dataclass(frozen=True)
class QualityConfig:
    """``floors``: least standard deviation of each transformed statistic, so that a group whose
    inner part is constant (no symbols at all, say) does not reject the first document that is not.
    ``cutoff``: chi-square quantile with 4 degrees of freedom at 1 - 1e-9."""

    min_words: int = 50
    max_repeat_percent: int = 50
    subset: float = 0.75
    #: most concentration steps, and the fall of a log determinant that counts as one
    steps: int = 30
    tolerance: float = 1e-3
    #: rows that the estimate of all groups together counts for in each
    prior: int = 30
    broadcast_groups: int = 50_000
    salts: int = 64
    floors: tuple[float, ...] = (0.05, 0.04, 0.08, 0.10)
    cutoff: float = 48.6
    #: chi-square with 4 degrees of freedom at 0.5 and 0.975
    chi_median: float = 3.3567
    chi_reweight: float = 11.1433


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and give it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """How many words lie in a three-word window that the text has twice or more."""

    def marked(sorted_windows: Column) -> Column:
        """Starts of repeated windows: neighbours with an equal key in the sorted array."""
        n = F.size(sorted_windows)
        hits = F.filter(
            sorted_windows,
            lambda x, k: ((k > 0) & (F.get(sorted_windows, k - 1)["h"] == x["h"]))
            | ((k < n - 1) & (F.get(sorted_windows, k + 1)["h"] == x["h"])),
        )
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g)

    def windows(w: Column) -> Column:
        n = F.size(w)
        keyed = F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
            ),
        )
        return F.when(n >= 3, _let(F.sort_array(keyed), lambda s: _let(marked(s), covered))).otherwise(F.lit(0).cast("long"))

    return _let(ws, windows)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of whole texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, _SPACE_CHARS, "") != "")
    return docs.withColumns(
        {
            "_stats": _let(
                words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))
            ),
            "word_chars": F.length(F.translate(t, _SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        }
    ).withColumns({"n_words": F.col("_stats.n"), "n_repeat_words": F.col("_stats.r")}).drop("_stats")


def _fixed(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def vectors(stats: DataFrame) -> DataFrame:
    """Adds z0..z3, fixed-point transformed statistics: log mean word length, and square roots of the
    shares of symbols, repeated lines and repeated words."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    z = (
        F.log(chars / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return stats.withColumns({f"z{i}": _fixed(x) for i, x in enumerate(z)})


def _distance(mean: list[Column], low: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance of z0..z3 by forward substitution in the Cholesky factor."""
    y = []
    for i in range(DIMS):
        rest = F.col(f"z{i}") - mean[i]
        for j in range(i):
            rest = rest - low[i, j] * y[j]
        y.append(rest / low[i, i])
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _cholesky(groups: DataFrame) -> DataFrame:
    """Columns l<i><j> from covariance columns c<i><j>, one level of the factor at a time."""
    for j in range(DIMS):
        square = F.col(f"c{j}{j}")
        for k in range(j):
            square = square - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        groups = groups.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(1e-6))))
        for i in range(j + 1, DIMS):
            cross = F.col(f"c{j}{i}")
            for k in range(j):
                cross = cross - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            groups = groups.withColumn(f"l{i}{j}", cross / F.col(f"l{j}{j}"))
    return groups


#: Distance buckets to a doubling.
FINE = 32


def _bucket(d2: Column) -> Column:
    """Logarithmic bucket of a squared distance; about 1400 buckets to 1e12."""
    return F.floor(F.log2(F.least(d2, F.lit(1e12)) * 16 + 1) * FINE).cast("int")


def _upper(bucket: Column) -> Column:
    return (F.pow(F.lit(2.0), (bucket + 1) / FINE) - 1) / 16


MEAN = [f"m{i}" for i in range(DIMS)]
COV = [f"c{i}{j}" for i, j in PAIRS]
LOW = [f"l{i}{j}" for i in range(DIMS) for j in range(i + 1)]


def _sums() -> dict[str, Column]:
    sums = {"n": F.sum("weight")}
    sums |= {f"s{i}": F.sum(F.col("weight") * F.col(f"z{i}")) for i in range(DIMS)}
    return sums | {f"p{i}{j}": F.sum(F.col("weight") * F.col(f"z{i}") * F.col(f"z{j}")) for i, j in PAIRS}


def _moments(summed: DataFrame, config: QualityConfig) -> DataFrame:
    """Means, covariances (with the floors) and their Cholesky factor from columns of ``_sums``."""
    g = summed.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIMS)})
    for i, j in PAIRS:
        cov = F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
        g = g.withColumn(f"c{i}{j}", cov + (config.floors[i] * UNIT) ** 2 if i == j else cov)
    return _factored(g)


def _factored(g: DataFrame) -> DataFrame:
    """``g`` with the factor of its covariances and the logarithm of their determinant."""
    return _cholesky(g).withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, DIMS)), F.log("l00")))


def _closest(near: DataFrame, keys: list[str], config: QualityConfig) -> DataFrame:
    """Sums of the closest ``h`` of each group of rows (keys, z0..z3, weight, d2)."""
    sums = _sums()
    binned = near.withColumn("b", _bucket(F.col("d2"))).groupBy(*keys, "b").agg(*(v.alias(k) for k, v in sums.items()))
    w = Window.partitionBy(*keys)
    upto = F.coalesce(F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    binned = binned.withColumns({"_total": F.sum("n").over(w), "_upto": upto})
    due = F.ceil(F.col("_total") * config.subset) - F.col("_upto")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), due / F.col("n")))
    return binned.withColumn("_share", share).groupBy(*keys).agg(*(F.sum(F.col("_share") * F.col(k)).alias(k) for k in sums))


def _starts(cells: DataFrame, config: QualityConfig) -> DataFrame:
    """(grp, start, m, l): three scatters around the medians, scaled by the MADs."""
    median = lambda x: F.expr(f"percentile({x}, 0.5, weight)").cast("double")  # noqa: E731  exact, each row counted
    centre = materialize(cells.groupBy("grp").agg(*(median(f"z{i}").alias(f"m{i}") for i in range(DIMS))), "mcd")
    mads = _with_groups(cells, centre, "grp", config).groupBy("grp").agg(*(median(f"abs(z{i} - m{i})").alias(f"d{i}") for i in range(DIMS)))
    scales = [F.greatest(F.col(f"d{i}") * 1.4826 + config.floors[i] * UNIT, F.lit(1.0)).alias(f"d{i}") for i in range(DIMS)]
    scaled = materialize(centre.join(mads, "grp").select("grp", *MEAN, *scales), "mcd")
    y = [(F.col(f"z{i}") - F.col(f"m{i}")) / F.col(f"d{i}") for i in range(DIMS)]
    # fixed point again, so that the sums are exact
    whole = lambda x: F.round(x * (1 << 20)).cast("long") * F.col("weight")
    rows = _with_groups(cells, scaled, "grp", config).withColumns({f"y{i}": c for i, c in enumerate(y)})
    length = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMS)), F.col("y0") * F.col("y0"))
    rows = rows.withColumns({"_q": length, "_w": F.lit(1 << 20) * F.col("weight")} | {f"t{i}": F.tanh(f"y{i}") for i in range(DIMS)})
    sums = {f"a{i}{j}": F.sum(whole(F.when(F.col("_q") > 0, F.col(f"y{i}") * F.col(f"y{j}") / F.col("_q")).otherwise(0.0))) for i, j in PAIRS}
    sums |= {f"b{i}{j}": F.sum(whole(F.col(f"t{i}") * F.col(f"t{j}"))) for i, j in PAIRS}
    sums |= {f"t{i}": F.sum(whole(F.col(f"t{i}"))) for i in range(DIMS)}
    g = rows.groupBy("grp").agg(F.sum("_w").alias("w"), *(v.alias(k) for k, v in sums.items()))
    g = g.join(scaled, "grp")
    cross = {
        1: lambda i, j: F.col(f"a{i}{j}") / F.col("w"),
        2: lambda i, j: F.col(f"b{i}{j}") / F.col("w") - F.col(f"t{i}") / F.col("w") * F.col(f"t{j}") / F.col("w"),
    }

    def scatter(start: int) -> Column:
        def correlation(i: int, j: int) -> Column:
            if i == j or start == 0:
                return F.lit(float(i == j))
            both = cross[start](i, i) * cross[start](j, j)
            # a little towards independence, so that it can always be factored
            return F.when(both > 1e-12, 0.99 * cross[start](i, j) / F.sqrt(both)).otherwise(0.0)

        return F.struct(F.lit(start).alias("start"), *((correlation(i, j) * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for i, j in PAIRS))

    each = g.select("grp", *MEAN, F.explode(F.array(*(scatter(k) for k in range(3)))).alias("x")).select("grp", *MEAN, "x.*")
    return _factored(each).select("grp", "start", *MEAN, *LOW)


def concentrated(cells: DataFrame, config: QualityConfig) -> DataFrame:
    """(grp, start, logdet, m, c, l): each group's closest ``h`` rows by the start that ends with the
    least determinant."""
    kept = ["grp", "start", "logdet", *MEAN, *COV, *LOW]

    def step(model: DataFrame) -> DataFrame:
        near = _with_groups(cells, model.select("grp", "start", *MEAN, *LOW), "grp", config).withColumn("d2", _joined_distance())
        return _moments(_closest(near, ["grp", "start"], config), config).select(*kept)

    model = materialize(step(materialize(_starts(cells, config), "mcd")), "mcd")
    for _ in range(config.steps - 1):
        new = step(model).select("grp", "start", F.struct(*kept[2:]).alias("new"))
        better = F.col("new.logdet") < F.col("logdet") - config.tolerance
        both = model.select("grp", "start", F.struct(*kept[2:]).alias("old"), "logdet").join(new, ["grp", "start"])
        moved = materialize(both.select("grp", "start", better.alias("moved"), F.when(better, F.col("new")).otherwise(F.col("old")).alias("x")), "mcd")
        model = moved.select("grp", "start", "x.*")
        if moved.filter("moved").isEmpty():
            break
    best = model.groupBy("grp").agg(F.min(F.struct("logdet", "start", *kept[3:])).alias("x"))
    return materialize(best.select("grp", "x.*").select(*kept), "mcd")


def _joined_distance() -> Column:
    mean = [F.col(f"m{i}") for i in range(DIMS)]
    return _distance(mean, {(i, j): F.col(f"l{i}{j}") for i in range(DIMS) for j in range(i + 1)})


def _with_groups(rows: DataFrame, groups: DataFrame, on: str, config: QualityConfig) -> DataFrame:
    """Rows with their group's columns. Group tables are broadcast while their checked count allows;
    beyond that both sides are salted, so that a group with a third of all rows is dealt out."""
    if groups.count() <= config.broadcast_groups:
        return rows.join(F.broadcast(groups), on)
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != on]), F.lit(config.salts))
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1)).cast("array<bigint>")))
    return rows.withColumn("_salt", salt).join(spread, [on, "_salt"]).drop("_salt")


def _reweighted(cells: DataFrame, config: QualityConfig) -> DataFrame:
    """(grp, n, m, c) of each group's rows within a chi-square quantile of its MCD."""
    raw = concentrated(cells, config).select("grp", *MEAN, *LOW)
    scaled = raw.join(_medians(cells, raw, config), "grp").withColumn(
        "reach", _upper(F.greatest(F.col("mid"), _bucket(F.lit(config.chi_median)))) * config.chi_reweight / config.chi_median
    )
    inner = _with_groups(cells, materialize(scaled.drop("mid"), "mcd"), "grp", config).filter(_joined_distance() <= F.col("reach"))
    return materialize(_moments(inner.groupBy("grp").agg(*(v.alias(k) for k, v in _sums().items())), config).select("grp", "n", *MEAN, *COV), "mcd")


def _scaled(cells: DataFrame, model: DataFrame, config: QualityConfig) -> DataFrame:
    """(grp, m, l, scale); ``scale`` turns raw squared distances into ones whose median is the
    chi-square median."""
    factored = materialize(_factored(model).select("grp", *MEAN, *LOW), "mcd")
    scale = config.chi_median / F.greatest(_upper(F.col("mid")), F.lit(config.chi_median))
    return factored.join(_medians(cells, factored, config), "grp").withColumn("scale", scale).drop("mid")


def estimate(cells: DataFrame, config: QualityConfig) -> DataFrame:
    """Robust location and scatter of each ``grp`` of (grp, z0..z3, weight), from its own rows alone."""
    return _scaled(cells, _reweighted(cells, config), config)


#: Stands for all groups together; no group's own name is without a separator.
ALL = "*"


def shared_estimate(cells: DataFrame, config: QualityConfig) -> DataFrame:
    """As ``estimate``, with each group's averaged with that of all rows, which count for ``prior``."""
    z = [f"z{i}" for i in range(DIMS)]
    every = materialize(cells.groupBy(*z).agg(F.sum("weight").alias("weight")).select(F.lit(ALL).alias("grp"), *z, "weight"), "cells")
    model = _reweighted(cells.unionByName(every), config)
    overall = model.filter(F.col("grp") == ALL).first()
    if overall is None:
        return _scaled(cells, model, config)
    share = F.lit(float(config.prior)) / (F.col("n") + config.prior)
    drawn = [((1 - share) * F.col(c) + share * F.lit(float(overall[c]))).alias(c) for c in (*MEAN, *COV)]
    return _scaled(cells, model.filter(F.col("grp") != ALL).select("grp", *drawn), config)


def _medians(cells: DataFrame, model: DataFrame, config: QualityConfig) -> DataFrame:
    """(grp, mid): the bucket of each group's median distance."""
    counts = _with_groups(cells, model, "grp", config).groupBy("grp", _bucket(_joined_distance()).alias("b")).agg(F.sum("weight").alias("n"))
    w = Window.partitionBy("grp")
    counts = counts.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("b"))})
    return counts.filter(F.col("upto") >= F.col("total") / 2).groupBy("grp").agg(F.min("b").alias("mid"))


def quality_verdicts(
    docs: DataFrame,
    config: QualityConfig = QualityConfig(),
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance (null where the base rules failed)."""
    grp = F.concat_ws("\x1f", F.coalesce(F.col(lang), F.lit("")), F.coalesce(F.col(source), F.lit("")))
    plain = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), grp.alias("own"))
    stats = vectors(text_statistics(plain, "_text").drop("_text"))
    failed = (F.col("n_words") < config.min_words) | (
        100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words")
    )
    stats = materialize(stats.withColumn("base_failed", failed), "stats")
    passing = stats.filter(~F.col("base_failed"))
    z = [f"z{i}" for i in range(DIMS)]
    cells = materialize(passing.groupBy(F.col("own").alias("grp"), *z).agg(F.count("*").alias("weight")), "cells")
    model = materialize(shared_estimate(cells, config).withColumnRenamed("grp", "own"), "mcd")
    judged = _with_groups(passing, model, "own", config).withColumn("distance", _joined_distance() * F.col("scale"))
    failing = stats.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= config.cutoff)
    return judged.select(*failing.columns).unionByName(failing).select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", kept.alias("kept"), "distance",
    )
