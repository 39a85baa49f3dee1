"""Column functions for score normalisation.

All of them are plain Catalyst expressions, so they stay inside whole-stage
codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docreason.schemas import BUCKET_THRESHOLDS, CORRECT_TOL


def null_d() -> Column:
    return F.lit(None).cast("double")

# Number syntax accepted by Python's float(): digits with single underscores
# between them, optional fraction and exponent, or inf/infinity/nan.
PY_FLOAT_RE = (r"^[+-]?((([0-9](_?[0-9])*)?\.[0-9](_?[0-9])*|[0-9](_?[0-9])*\.?)"
               r"([eE][+-]?[0-9](_?[0-9])*)?|(?i:inf|infinity|nan))$")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN is a value in Spark (greater than every number); the analysis treats
    it as missing, so it becomes NULL at the boundary."""
    return F.nanvl(col(c), null_d())


def clip01(c) -> Column:
    """Clip to [0, 1]; NULL and NaN stay missing (NULL)."""
    x = nan_to_null(c)
    return F.when(x.isNull(), null_d()).otherwise(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)))


# What str.strip() removes (fixed by Python's definition of white space).
PY_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace as str.strip() does (Spark's trim only
    removes spaces)."""
    return F.btrim(col(c), F.lit(PY_SPACE))


def coerce_float(c) -> Column:
    """Text or number to DOUBLE the way float(str(x).strip()) does; unparsable,
    missing and NaN give NULL."""
    s = py_strip(col(c).cast("string"))
    parsed = F.when(s.rlike(PY_FLOAT_RE), F.regexp_replace(s, "_", "").try_cast("double"))
    return nan_to_null(parsed)


def tri_anchor(c) -> Column:
    """Nearest of 0, 0.5, 1; a tie goes to the lower anchor."""
    x = col(c)
    return (F.when(x.isNull(), null_d()).when(x <= 0.25, F.lit(0.0))
            .when(x <= 0.75, F.lit(0.5)).otherwise(F.lit(1.0)))


def bucketize(c, thr=BUCKET_THRESHOLDS) -> Column:
    """Low < thr[0] <= Med < thr[1] <= High."""
    x = col(c)
    return F.when(x < thr[0], "Low").when(x < thr[1], "Med").otherwise("High")


def bool_flag(c) -> Column:
    """str(x).lower().strip() == 'true'."""
    return F.coalesce(F.lower(py_strip(col(c).cast("string"))) == "true", F.lit(False))


def norm_type(c) -> Column:
    """str(x).lower().strip() of a block type; missing gives ''."""
    return F.lower(py_strip(F.coalesce(col(c).cast("string"), F.lit(""))))


def abs_err(pred, gold) -> Column:
    return F.abs(col(pred) - col(gold))


def correct_bin(err, tol: float = CORRECT_TOL) -> Column:
    """1 when |pred - gold| <= tol, else 0; a missing error counts as 0."""
    return F.coalesce((col(err) <= tol).cast("int"), F.lit(0))


def id_fallback(id_col, question_col, length: int | None = 64) -> Column:
    """The id, or the first ``length`` characters of the question ('' if none).
    64 is the analysed system's rule; questions with the same opening share
    such an id, which ``length=None`` (the whole question) avoids."""
    question = F.coalesce(col(question_col), F.lit(""))
    return F.coalesce(col(id_col).cast("string"), question if length is None else F.substring(question, 1, length))


def run_id(at: Column | None = None) -> Column:
    """The id of a run: the time it began, now if none is given."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd-HHmmss")


def rnd(c, digits: int = 9) -> Column:
    """Round a reported double so that engines summing in different orders
    agree on the printed value."""
    return F.round(col(c), digits)


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """``n`` edges from lo to hi computed as i*step + lo, last edge exactly hi
    (the same doubles a NumPy linspace yields)."""
    step = (hi - lo) / (n - 1)
    edges = [i * step + lo for i in range(n)]
    edges[-1] = hi
    return edges


def with_bin(df, out: str, x, edges: list[float], close_last: bool = False):
    """Add column ``out``: index i with edges[i] <= x < edges[i+1] (digitize -
    1) for ``edges`` made by :func:`linspace`.

    x below the first edge gives -1, x at or above the last gives len(edges)-1,
    unless ``close_last`` puts x == last edge into the last bin (histogram
    rule). Edge i is recomputed as i * step + lo -- the very doubles of the
    edge list, 0.30000000000000004 included -- so a floor estimate is
    corrected against exact edges with a few arithmetic operations. The
    intermediate steps are columns, which keeps generated code small.
    """
    n = len(edges)
    lo, hi = edges[0], edges[-1]
    step = (hi - lo) / (n - 1)

    def e(i):
        return F.when(i >= n - 1, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))

    v = F.col("_bx")
    k0 = F.least(F.greatest(F.floor((v - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(0)),
                 F.lit(n - 2))
    last = F.lit(n - 2) if close_last else F.lit(n - 1)
    # One step down, then one step up: the estimate is off by at most one.
    return (df.withColumn("_bx", col(x))
            .withColumn("_bk0", k0)
            .withColumn("_bk1", F.greatest(F.col("_bk0") - (v < e(F.col("_bk0"))).cast("int"), F.lit(0)))
            .withColumn(out, F.when(v.isNull(), F.lit(None).cast("int"))
                        .when(v < F.lit(lo), F.lit(-1))
                        .when(v > F.lit(hi), F.lit(n - 1))
                        .when(v == F.lit(hi), last)
                        .otherwise(F.col("_bk1") + (v >= e(F.col("_bk1") + 1)).cast("int")))
            .drop("_bx", "_bk0", "_bk1"))
