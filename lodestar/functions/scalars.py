"""Pure Column functions. Everything here stays JVM-side (codegen), no UDFs.

Spark 4 runs with ANSI mode on: every coercion uses ``try_*`` and every
division guards its denominator, so bad input becomes NULL, never an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- coercion

def coerce_numeric(c: ColumnOrName) -> Column:
    """Bad text -> NULL, NaN -> NULL (pandas ``to_numeric(errors='coerce')``)."""
    v = _c(c).try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def nan_to_null(c: ColumnOrName) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def coerce_date(c: ColumnOrName, fmt: str = "yyyyMMdd") -> Column:
    return F.try_to_timestamp(_c(c).cast("string"), F.lit(fmt)).cast("date")


def year_from_mmyyyy(c: ColumnOrName) -> Column:
    return F.right(_c(c).cast("string"), F.lit(4)).try_cast("int")


# ---------------------------------------------------------------- periods

def quarter_start(ts: ColumnOrName) -> Column:
    return F.date_trunc("quarter", _c(ts)).cast("date")


def quarter_end(ts: ColumnOrName) -> Column:
    return F.last_day(F.add_months(quarter_start(ts), 2))


def quarter_label(ts: ColumnOrName) -> Column:
    return F.concat(F.year(_c(ts)).cast("string"), F.lit("Q"), F.quarter(_c(ts)).cast("string"))


# ---------------------------------------------------------------- arithmetic

def safe_ratio(num: ColumnOrName, den: ColumnOrName, scale: float = 1.0) -> Column:
    """num / nullif(den, 0) * scale; never raises under ANSI."""
    r = _c(num) / F.nullif(_c(den), F.lit(0))
    return r * F.lit(scale) if scale != 1.0 else r


def clip(c: ColumnOrName, lo: float | None = None, hi: float | None = None) -> Column:
    """Clip keeping NULL as NULL (``least``/``greatest`` would skip nulls)."""
    c = _c(c)
    out = c
    if hi is not None:
        out = F.when(c > F.lit(hi), F.lit(float(hi))).otherwise(out)
    if lo is not None:
        out = F.when(c < F.lit(lo), F.lit(float(lo))).otherwise(out)
    return out


def log1p_clip0(c: ColumnOrName) -> Column:
    c = _c(c)
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c))


def dti_midpoint(c: ColumnOrName, variant: str = "A") -> Column:
    """Parse debt-to-income text to a number (NULL when unparsable).

    Variant A splits ``a-b`` ranges after removing only ``%``, so ``20%-<30%``
    is NULL; other values drop ``%``, ``<``, ``>``. Variant B removes all three
    before splitting, so ``20%-<30%`` becomes 25.
    """
    s = _c(c).cast("string")

    v = F.trim(F.translate(s, "%<>", ""))
    ranged_src = v if variant.upper() == "B" else F.replace(s, F.lit("%"), F.lit(""))
    # one dash, and none of the signs that no number has: a failed cast throws within the JVM, which is dear
    two = (F.length(ranged_src) - F.length(F.translate(ranged_src, "-", "")) == 1) & (F.translate(ranged_src, "<>", "") == ranged_src)
    mid = (F.substring_index(ranged_src, "-", 1).try_cast("double") + F.substring_index(ranged_src, "-", -1).try_cast("double")) / 2
    out = F.when(F.contains(ranged_src, F.lit("-")), F.when(two, mid)).otherwise(v.try_cast("double"))
    return F.nanvl(out, F.lit(None).cast("double"))


def indicator(cond: Column) -> Column:
    """Boolean condition -> 0/1 int, NULL comparisons -> 0 (pandas NaN semantics)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def keyword_any(c: ColumnOrName, keywords: Sequence[str]) -> Column:
    low = F.lower(_c(c))
    cond = F.lit(False)
    for k in keywords:
        cond = cond | low.contains(k.lower())
    return F.coalesce(cond, F.lit(False))


def normalize_entity(c: ColumnOrName, rules: Sequence[tuple[str, str]], default: str | None = "Other") -> Column:
    """Ordered first-match rule list ``(keyword, canonical)`` -> canonical name."""
    low = F.lower(_c(c))
    out = None
    for kw, canon in rules:
        cond = low.contains(kw)
        out = F.when(cond, F.lit(canon)) if out is None else out.when(cond, F.lit(canon))
    dflt = F.lit(default) if default is not None else F.lit(None).cast("string")
    return out.otherwise(dflt) if out is not None else dflt


def clean_entity_name(c: ColumnOrName, removals: Sequence[str]) -> Column:
    """lower, ordered literal removals, drop ',' and '.', trim."""
    s = F.lower(_c(c))
    for r in removals:
        s = F.replace(s, F.lit(r), F.lit(""))
    s = F.replace(F.replace(s, F.lit(","), F.lit("")), F.lit("."), F.lit(""))
    return F.trim(s)


def row_any_equals(cols: Iterable[ColumnOrName], value) -> Column:
    arr = F.array(*[_c(x).cast("string") for x in cols])
    return F.coalesce(F.exists(arr, lambda x: x == F.lit(str(value))), F.lit(False))


def row_count_nonblank(cols: Iterable[ColumnOrName]) -> Column:
    arr = F.array(*[_c(x).cast("string") for x in cols])
    return F.size(F.filter(arr, lambda x: x.isNotNull() & (F.trim(x) != F.lit(""))))


def significance_label(p: ColumnOrName) -> Column:
    p = _c(p)
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("n.s.")


def risk_tier_prob(p: ColumnOrName) -> Column:
    p = _c(p)
    return F.when(p.isNull(), F.lit(None).cast("string")) \
        .when(p >= 0.15, "High").when(p >= 0.05, "Elevated").otherwise("Watch")


def risk_tier_texas(t: ColumnOrName) -> Column:
    t = _c(t)
    return F.when(t.isNull(), F.lit(None).cast("string")) \
        .when(t > 100, "Distressed").when(t > 50, "Elevated").otherwise("Healthy")


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def linear_score(coefs: dict[str, float], intercept: float = 0.0, present: Iterable[str] | None = None) -> Column:
    """intercept + sum(beta * x); terms missing from ``present`` count as 0."""
    z = F.lit(float(intercept))
    for name, b in coefs.items():
        if present is not None and name not in present:
            continue
        z = z + F.lit(float(b)) * F.col(name)
    return z
