"""Statistics that hold frequency norms against human ratings, and corpora against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions.python_text import t_pvalue

ALPHAS = (0.1, 1.0, 10.0)


def log_frequency(freq: Column, gini: bool = False, negative: bool = False) -> Column:
    """log10 of the frequency, its negative, or for GINI values their negative."""
    return -freq if gini else -F.log10(freq) if negative else F.log10(freq)


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson's r of the rows that have both; null where either is constant (F.corr divides by zero there)."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))


def correlation(rows: DataFrame, by: list[str], x: str, y: str, missing: str | None = None, reference: str | None = None) -> DataFrame:
    """Pearson's r over all rows, over rows that aren't missing and against a reference column, with n and n_missing."""
    out = [corr(x, y).alias("r"), F.count("*").alias("n")]
    if missing:
        out += [F.count_if(F.col(missing)).alias("n_missing"), corr(F.when(~F.col(missing), F.col(x)), F.when(~F.col(missing), F.col(y))).alias("r_without_missing")]
    if reference:
        out.append(corr(x, reference).alias("r_reference"))
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def ridge_fit(rows: DataFrame, by: list[str], x: str, y: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(by..., alpha, slope, intercept) of one-feature ridge regression; alpha by least leave-one-out squared error (ties: the smaller).

    Two aggregations: moments, then the errors e / (1 - h), h = 1/n + (x - mean)^2 / (Sxx + alpha), of all alphas at once.
    """
    moments = rows.groupBy(*by) if by else rows.groupBy(F.lit(1).alias("_one"))
    keys = by or ["_one"]
    base = rows if by else rows.withColumn("_one", F.lit(1))
    m = moments.agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * F.count("*")).alias("sxx"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"))
    both = base.join(m, keys)

    def loo(a: float) -> Column:
        dx = F.col(x) - F.col("mx")
        e = F.col(y) - F.col("my") - F.col("sxy") / (F.col("sxx") + a) * dx
        h = 1 / F.col("n") + dx * dx / (F.col("sxx") + a)
        return F.avg((e / (1 - h)) * (e / (1 - h)))

    errors = both.groupBy(*keys).agg(*(loo(a).alias(f"e{k}") for k, a in enumerate(alphas)))
    best = F.array_min(F.array(*(F.struct(F.col(f"e{k}").alias("e"), F.lit(a).alias("alpha")) for k, a in enumerate(alphas))))
    out = errors.withColumn("alpha", best["alpha"]).join(m, keys)
    slope = F.col("sxy") / (F.col("sxx") + F.col("alpha"))
    return out.select(*by, "alpha", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def predict(rows: DataFrame, models: DataFrame, by: list[str], x: str) -> DataFrame:
    """rows with prediction, clipped to [0, 1]."""
    joined = rows.join(F.broadcast(models), by) if by else rows.crossJoin(F.broadcast(models))  # one row a group
    return joined.withColumn("prediction", F.least(F.greatest(F.col("intercept") + F.col("slope") * F.col(x), F.lit(0.0)), F.lit(1.0))).drop("alpha", "slope", "intercept")


def metrics(rows: DataFrame, by: list[str], y: str, p: str = "prediction") -> DataFrame:
    """Pearson's r, mean absolute and squared error, and R2 = 1 - SSE / SST."""
    e = F.col(y) - F.col(p)
    out = [corr(y, p).alias("r"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2")]
    return rows.groupBy(*by).agg(*out) if by else rows.agg(*out)


def js_distance(counts: DataFrame, corpus: str = "corpus", common: bool = False, top: int | None = None) -> DataFrame:
    """(a, b, distance) of all pairs of corpora (a <= b) from rows (corpus, word, count): square root of the Jensen-Shannon divergence, natural log.

    A word contributes to a pair only where one of the two has it. Words of both are joined on the word; those of one add p ln 2 / 2,
    so that sum comes from totals and no outer join is needed. common: only words of both, renormalised. top: only words among the top of either.
    """
    total = counts.groupBy(corpus).agg(F.sum("count").alias("_t"))
    p = counts.join(F.broadcast(total), corpus).select(F.col(corpus).alias("c"), "word", (F.col("count") / F.col("_t")).alias("p"), F.col("count").alias("n"))
    if top is not None:
        p = p.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "word")))
        a, b = p.alias("a"), p.alias("b")
        names = p.select("c").distinct()
        grid = names.select(F.col("c").alias("a")).join(names.select(F.col("c").alias("b")), F.col("a") <= F.col("b"))  # corpora, not words
        left = grid.join(p, F.col("c") == F.col("a")).select("a", "b", "word", F.col("p").alias("p"), F.lit(0.0).alias("q"), (F.col("rank") <= top).alias("k"))
        right = grid.join(p, F.col("c") == F.col("b")).select("a", "b", "word", F.lit(0.0).alias("p"), F.col("p").alias("q"), (F.col("rank") <= top).alias("k"))
        both = left.unionByName(right).groupBy("a", "b", "word").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), F.bool_or("k").alias("k")).filter("k")
        both = both.filter("p > 0 AND q > 0") if common else both
        sums = both.groupBy("a", "b").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
        x = both.join(F.broadcast(sums), ["a", "b"]).withColumn("p", F.col("p") / F.col("sp")).withColumn("q", F.col("q") / F.col("sq"))
        return x.groupBy("a", "b").agg(F.sqrt(F.greatest(F.sum(_js("p", "q")), F.lit(0.0)) / 2).alias("distance"))
    a = p.select(F.col("c").alias("a"), "word", "p")
    b = p.select(F.col("c").alias("b"), "word", F.col("p").alias("q"))
    shared = a.join(b, "word").filter("a <= b")
    if common:
        sums = shared.groupBy("a", "b").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
        x = shared.join(F.broadcast(sums), ["a", "b"]).withColumn("p", F.col("p") / F.col("sp")).withColumn("q", F.col("q") / F.col("sq"))
        return x.groupBy("a", "b").agg(F.sqrt(F.greatest(F.sum(_js("p", "q")), F.lit(0.0)) / 2).alias("distance"))
    found = shared.groupBy("a", "b").agg(F.sum(_js("p", "q")).alias("s"), F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    names = total.select(F.col(corpus).alias("a"))
    grid = names.join(total.select(F.col(corpus).alias("b")), F.col("a") <= F.col("b"))  # corpora, not words
    out = grid.join(found, ["a", "b"], "left")
    alone = (2 - F.coalesce("sp", F.lit(0.0)) - F.coalesce("sq", F.lit(0.0))) * F.log(F.lit(2.0))
    return out.select("a", "b", F.sqrt(F.greatest(F.coalesce("s", F.lit(0.0)) + alone, F.lit(0.0)) / 2).alias("distance"))


def _js(p: str, q: str) -> Column:
    m = (F.col(p) + F.col(q)) / 2
    part = lambda v: F.when(F.col(v) > 0, F.col(v) * F.log(F.col(v) / m)).otherwise(0.0)
    return part(p) + part(q)


def types_tokens(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.count("*").alias("types"), F.sum("count").alias("tokens"))


def coverage(correlations: DataFrame) -> DataFrame:
    return correlations.withColumn("coverage", 1 - F.col("n_missing") / F.col("n"))


def pivot(rows: DataFrame, index: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row an index value, one column a listed column value."""
    return rows.groupBy(index).pivot(column, columns).agg(F.first(value))


def steiger(xy: Column, xz: Column, yz: Column, n: Column) -> Column:
    """t of the difference between two dependent correlations, n - 3 degrees of freedom; null for equal ones with yz = 1 and for missing input."""
    determinant = 1 - xy * xy - xz * xz - yz * yz + 2 * xy * xz * yz
    mean = (xy + xz) / 2
    u = (n - 1) * (1 + yz) / (2 * (n - 1) / (n - 3) * determinant + mean * mean * F.pow(1 - yz, F.lit(3)))
    return F.when((xy == xz) & (yz == 1), F.lit(None).cast("double")).otherwise((xy - xz) * F.sqrt(u))


def steiger_pvalue(xy: Column, xz: Column, yz: Column, n: Column) -> Column:
    """Two-sided p; 1 where rounding makes t undefined, null where steiger is."""
    t = steiger(xy, xz, yz, n)
    given = xy.isNotNull() & xz.isNotNull() & yz.isNotNull() & n.isNotNull() & ~((xy == xz) & (yz == 1))
    return F.when(given, F.when(F.isnan(t) | t.isNull(), 1.0).otherwise(t_pvalue(t, n - 3)))


def fisher_interval(r: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high): confidence interval of a correlation."""
    at = lambda s: F.tanh(F.atanh(r) + s * z / F.sqrt(n - 3))
    return F.struct(at(-1).alias("low"), at(1).alias("high"))


def zou_interval(xy: Column, xz: Column, yz: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high): confidence interval of the difference of two dependent correlations."""
    one, two = fisher_interval(xy, n, z), fisher_interval(xz, n, z)
    rho = ((yz - xy * xz / 2) * (1 - xy * xy - xz * xz - yz * yz) + yz * yz * yz) / ((1 - xy * xy) * (1 - xz * xz))
    sq = lambda x: x * x
    low = xy - xz - F.sqrt(sq(xy - one["low"]) + sq(two["high"] - xz) - 2 * rho * (xy - one["low"]) * (two["high"] - xz))
    high = xy - xz + F.sqrt(sq(one["high"] - xy) + sq(xz - two["low"]) - 2 * rho * (one["high"] - xy) * (xz - two["low"]))
    return F.struct(low.alias("low"), high.alias("high"))


def independent_z(r1: Column, r2: Column, n1: Column, n2: Column) -> Column:
    """|z| of the difference of two independent correlations."""
    return F.abs((F.atanh(r1) - F.atanh(r2)) / F.sqrt(1 / (n1 - 3) + 1 / (n2 - 3)))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def highlight(rows: DataFrame, by: list[str], value: str, tolerance: float = 0.0, least: bool = False) -> DataFrame:
    """rows with best: within the tolerance of the group's largest (or least) value."""
    w = Window.partitionBy(*by)
    mark = (F.col(value) <= F.min(value).over(w) + tolerance) if least else (F.col(value) >= F.max(value).over(w) - tolerance)
    return rows.withColumn("best", mark)


def trimmed_mean(rows: DataFrame, key: str, value: str, low: float, high: float, keep: Column | None = None) -> DataFrame:
    kept = rows.filter(keep) if keep is not None else rows
    return kept.filter(F.col(value).between(low, high)).groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def key_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias("mean"))


def proportions(rows: DataFrame, label: Column, by: list[str] = ()) -> DataFrame:
    """(by..., label, n, share) of labels."""
    counts = rows.groupBy(*by, label.alias("label")).agg(F.count("*").alias("n"))
    total = rows.groupBy(*by).agg(F.count("*").alias("_all"))
    joined = counts.join(total, list(by)) if by else counts.crossJoin(F.broadcast(total))
    return joined.select(*by, "label", "n", (F.col("n") / F.col("_all")).alias("share"))


def combined_label(*labels: Column, separator: str = ",") -> Column:
    """The different labels of a row in order of name."""
    return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), separator)


def concatenated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, label): the labels of several columns below each other; empty ones are kept as ''."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return rows.select(F.expr(f"stack({len(columns)}, {pairs}) AS (column, label)")).withColumn("label", F.coalesce("label", F.lit("")))


def checked_annotations(rows: DataFrame, columns: list[str], labels: list[str], size: int | None = None) -> DataFrame:
    """The rows, if there are `size` of them and their columns hold no label but those listed; an error with what is unexpected otherwise."""
    if size is not None and (n := rows.count()) != size:
        raise ValueError(f"{n} rows in place of {size}")
    odd = concatenated(rows, columns).filter(~F.col("label").isin(*labels)).distinct().limit(20).collect()
    if odd:
        raise ValueError(f"unexpected labels {sorted((r['column'], r['label']) for r in odd)}")
    return rows


def reference_correlation(rows: DataFrame, reference: DataFrame, by: list[str], key: str, x: str) -> DataFrame:
    """(by..., r, n, n_reference): r of x in both tables over equal keys; null where a group has other keys or another number of them in the two."""
    here = rows.select(*by, key, F.col(x).alias("_x"), F.lit(1).alias("_here"))
    there = reference.select(*by, key, F.col(x).alias("_y"), F.lit(1).alias("_is"))
    both = here.join(there, [*by, key], "full_outer")
    out = [corr("_x", "_y").alias("_r"), F.count("_here").alias("n"), F.count("_is").alias("n_reference"), F.count("*").alias("_all")]
    found = both.groupBy(*by).agg(*out) if by else both.agg(*out)
    return found.select(*by, F.when((F.col("n") == F.col("n_reference")) & (F.col("n") == F.col("_all")), F.col("_r")).alias("r"), "n", "n_reference")


def majority(rows: DataFrame, key: str, label: str, one: str, two: str, both: str, unknown: str, share: float = 0.95, ignore: int = 1) -> DataFrame:
    """(key, variant): the variant whose lines, with those that can be both, make up `share` of the known lines, or whose rival has at most
    `ignore` lines, provided it is the larger; `both`, `unknown` or 'mixed' else."""
    c = rows.groupBy(key).agg(F.count_if(F.col(label) != unknown).alias("n"), *(F.count_if(F.col(label) == v).alias(k) for k, v in (("a", one), ("b", two), ("c", both))))
    wins = lambda x, y: (F.col(x) > F.col(y)) & (((F.col(x) + F.col("c")) / F.col("n") >= share) | (F.col(y) <= ignore))
    return c.select(key, F.when(F.col("n") == 0, unknown).when(F.col("c") == F.col("n"), both).when(wins("a", "b"), one).when(wins("b", "a"), two).otherwise("mixed").alias("variant"))


def size_correlation(sizes: DataFrame, correlations: DataFrame, by: list[str], outliers: list[tuple] = ()) -> DataFrame:
    """(by..., log_tokens, r) of corpora that both know. outliers: keys to leave out; it is an error if one of them isn't there."""
    both = sizes.join(correlations, by)
    if outliers:
        listed = sizes.sparkSession.createDataFrame([tuple(o) for o in outliers], ", ".join(f"`{c}` {sizes.schema[c].dataType.simpleString()}" for c in by))
        if gone := listed.join(both.select(*by).distinct(), by, "left_anti").collect():
            raise KeyError([tuple(r) for r in gone])
        both = both.join(listed, by, "left_anti")
    return both.select(*by, F.log10("tokens").alias("log_tokens"), "r")


def duration_class(seconds: Column) -> Column:
    return F.when(seconds >= 600, 2).when(seconds >= 180, 1).otherwise(0)
