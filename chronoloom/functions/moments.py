"""Count, means and central second moments of one or two columns, measured by Spark and merged pairwise.

No sum of squares about a fixed point is ever taken, so the level of the values doesn't matter: Spark's
own aggregates update moments row by row, and two groups merge by the distance of their means.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE, TWO = ("xx",), ("xx", "xy", "yy")  # products, by number of columns
_SIDES = {"xx": ("x", "x"), "xy": ("x", "y"), "yy": ("y", "y")}


def names(products: tuple[str, ...]) -> list[str]:
    return ["x", "y"] if "yy" in products else ["x"]


def row(cols: list[Column], products: tuple[str, ...]) -> Column:
    """The values of a row as doubles; null unless all are known."""
    known = cols[0].isNotNull()
    for c in cols[1:]:
        known = known & c.isNotNull()
    return F.struct(*[F.when(known, c.cast("double")).alias(n) for c, n in zip(cols, names(products), strict=True)])


def measured(rows: Column, products: tuple[str, ...], over: Callable[[Column], Column] = lambda a: a) -> Column:
    """Moments of a column of ``row`` structs, as aggregates wrapped in ``over``."""
    n = over(F.count(rows["x"]))
    out = [n.alias("n"), *[F.coalesce(over(F.avg(rows[c])), F.lit(0.0)).alias(c) for c in names(products)]]
    for p in products:
        a, b = _SIDES[p]
        spread = F.var_pop(rows[a]) if a == b else F.covar_pop(rows[a], rows[b])
        out.append(F.coalesce(over(spread) * n, F.lit(0.0)).alias(p))
    return F.struct(*out)


def _gain(x: Column, y: Column, before: Column, n: Column) -> Column:
    """What two groups of ``before`` and ``n`` rows add to a product by the distances of their means."""
    return F.when((before > 0) & (n > 0), x * y * (before.cast("double") * n / (before + n))).otherwise(0.0)


def merge(a: Column, b: Column, products: tuple[str, ...]) -> Column:
    """Moments of two groups together; a null struct is an empty group."""
    n = a["n"] + b["n"]
    far = {c: b[c] - a[c] for c in names(products)}
    out = [n.alias("n"), *[(a[c] + far[c] * (b["n"] / n)).alias(c) for c in names(products)]]
    for p in products:
        i, j = _SIDES[p]
        out.append((a[p] + b[p] + _gain(far[i], far[j], a["n"], b["n"])).alias(p))
    empty = lambda m: m.isNull() | (m["n"] == 0)
    return F.when(empty(a), b).when(empty(b), a).otherwise(F.struct(*out))


def folded(groups: Column, products: tuple[str, ...]) -> Column:
    """Moments of an array of groups together."""
    zero = F.struct(
        F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(c) for c in (*names(products), *products)]
    )
    return F.aggregate(groups, zero, lambda a, b: merge(a, b, products))


def before(m: Column, products: tuple[str, ...], over: Callable[[Column], Column]) -> tuple[dict[str, Column], Callable]:
    """Moments of all groups before each, in two steps of windows.

    The first gives the count and the sums before each group. Each group then adds its own products and a
    term by the distance of its mean from the mean before it; all terms are added up by the second.
    """
    first = {"n": F.coalesce(over(F.sum(m["n"])), F.lit(0))}
    first |= {c: over(F.sum(m["n"] * m[c])) for c in names(products)}

    def second(found: dict[str, Column]) -> Column:
        n = found["n"]
        mean = {c: F.coalesce(found[c] / n, F.lit(0.0)) for c in names(products)}
        far = {c: m[c] - mean[c] for c in names(products)}
        terms = [
            F.coalesce(over(F.sum(m[p] + _gain(far[_SIDES[p][0]], far[_SIDES[p][1]], n, m["n"]))), F.lit(0.0)).alias(p)
            for p in products
        ]
        return F.struct(n.cast("bigint").alias("n"), *[mean[c].alias(c) for c in mean], *terms)

    return first, second


def variance(m: Column) -> Column:
    return F.when(m["n"] > 1, m["xx"] / (m["n"] - 1))


def covariance(m: Column) -> Column:
    return F.when(m["n"] > 1, m["xy"] / (m["n"] - 1))


def correlation(m: Column) -> Column:
    """Null where a column is constant."""
    varies = (m["n"] > 1) & (m["xx"] > 0) & (m["yy"] > 0)
    return F.when(varies, m["xy"] / (F.sqrt(m["xx"]) * F.sqrt(m["yy"])))
