"""Column expressions (JVM-side, whole-stage codegen friendly).

Everything here returns a ``Column``; nothing touches data.
"""

from __future__ import annotations

import re

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions import tokens as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text ----

def norm_text(c) -> Column:
    """lower(trim(x)); NULL stays NULL (never the text 'nan')."""
    return F.lower(F.trim(col(c).cast("string")))


def token_to_null(c, tokens: Sequence[str] = T.MISSING_TOKENS) -> Column:
    """Category clean: trim, lower, missing tokens -> NULL."""
    s = norm_text(c)
    return F.when(s.isin(list(tokens)), F.lit(None).cast("string")).otherwise(s)


def is_missing(c, tokens: Sequence[str] = T.MISSING_TOKENS, numeric: bool = False) -> Column:
    """Missing mask: NULL, NaN for numbers, tokens for text."""
    if numeric:
        d = col(c).cast("double")
        return d.isNull() | F.isnan(d)
    return col(c).isNull() | norm_text(c).isin(list(tokens))


_NUMERIC_RE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c) -> Column:
    """Value-level numeric cast: unparseable -> NULL (no '1.5d' suffix forms, no NaN)."""
    s = col(c).cast("string")
    return F.when(s.rlike(_NUMERIC_RE), F.trim(s).try_cast("double"))


def nan_to_null(c) -> Column:
    d = col(c).cast("double")
    return F.when(~F.isnan(d), d)


def bool_like(c) -> Column:
    """Boolean-like text -> 1.0 / 0.0 / NULL."""
    s = norm_text(c)
    return (F.when(s.isin(list(T.TRUE_TOKENS)), F.lit(1.0))
            .when(s.isin(list(T.FALSE_TOKENS)), F.lit(0.0)))


def binary_target(c) -> Column:
    """Binary target tokens (EN/ES) -> 1 / 0 / NULL (int)."""
    return bool_like(c).cast("int")


def round1_even(x) -> Column:
    """pandas ``.round(1)``: half-to-even on the scaled value."""
    return F.rint(col(x) * 10.0) / 10.0


def days_to_years(c, negate: bool = False) -> Column:
    d = to_number(c)
    if negate:
        d = -d
    return round1_even(d / 365.25)


# ----------------------------------------------------------------- bins ----

def bin_expr(c, edges: Sequence[float], labels: Sequence[str], right: bool = False,
             include_lowest: bool = False) -> Column:
    """Fixed-edge binning as one CASE (pandas ``cut`` semantics).

    right=False: [e_i, e_{i+1}); right=True: (e_i, e_{i+1}], with the lowest
    edge included when ``include_lowest``.
    """
    x = col(c).cast("double")
    expr = None
    for i, lab in enumerate(labels):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if right:
            lo_ok = (x >= lo) if (include_lowest and i == 0) else (x > lo)
            cond = lo_ok & (x <= hi)
        else:
            cond = (x >= lo) & (x < hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


# ---------------------------------------------------------------- odds -----

def smoothed_odds_ratio(pos_in, neg_in, pos_out, neg_out, smoothing: float = 0.5) -> Column:
    """+0.5 on every cell: ((a+s)/(b+s)) / ((c+s)/(d+s))."""
    s = F.lit(float(smoothing))
    return ((col(pos_in) + s) / (col(neg_in) + s)) / ((col(pos_out) + s) / (col(neg_out) + s))


def or_to_weight(or_value, factor: float) -> Column:
    """1 + f * tanh(ln OR); a non-finite or non-positive OR gives 1."""
    o = col(or_value)
    ok = o.isNotNull() & (o > 0) & ~F.isnan(o) & (o < F.lit(float("inf")))
    return F.when(ok, F.lit(1.0) + F.lit(float(factor)) * F.tanh(F.log(o))).otherwise(F.lit(1.0))


def clamped_logit(p, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(col(p), F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (F.lit(1.0) - q))


def py_logit(p: float, eps: float = 1e-6) -> float:
    p = min(max(float(p), eps), 1 - eps)
    return math.log(p / (1 - p))


# ------------------------------------------------------------- hashing -----

def hash_u32(*parts) -> Column:
    """Deterministic 32-bit integer from md5 of the ':'-joined parts
    (``Column`` parts are cast to text, anything else is a literal).

    Reproducible in any SQL engine with md5:
    ``('0x' || substr(md5(p1 || ':' || p2 ...), 1, 8))::BIGINT``.
    """
    s = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_fraction(*parts) -> Column:
    """Uniform [0, 1) from :func:`hash_u32`."""
    return hash_u32(*parts) / F.lit(4294967296.0)


def poisson1(u) -> Column:
    """Poisson(1) draw from a uniform by inverse CDF (0..10)."""
    u = col(u)
    expr = None
    for k, c in enumerate(T.POISSON1_CDF):
        expr = F.when(u < F.lit(c), F.lit(k)) if expr is None else expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(F.lit(len(T.POISSON1_CDF)))


# ------------------------------------------------------- coded surveys -----

def coded_sex(c) -> Column:
    n = to_number(c)
    expr = None
    for code, lab in T.CODED_SEX.items():
        expr = F.when(n == code, F.lit(lab)) if expr is None else expr.when(n == code, F.lit(lab))
    return expr


def coded_ethnicity(c) -> Column:
    """1, 2 -> hispanic or latino; everything else, NULL included -> not hispanic or latino."""
    n = to_number(c)
    return F.when(n.isin(list(T.CODED_HISPANIC)), F.lit("hispanic or latino")) \
        .otherwise(F.lit("not hispanic or latino"))


def coded_race(c) -> Column:
    n = to_number(c)
    expr = None
    for code, lab in T.CODED_RACE.items():
        expr = F.when(n == code, F.lit(lab)) if expr is None else expr.when(n == code, F.lit(lab))
    return expr


def coded_smoker(q1, q2) -> Column:
    """q1=1 -> 1, q1=2 -> 0, else q2 in (1, 2) -> 1, q2=3 -> 0."""
    a, b = to_number(q1), to_number(q2)
    return (F.when(a == 1, F.lit(1.0)).when(a == 2, F.lit(0.0))
            .when(b.isin(1, 2), F.lit(1.0)).when(b == 3, F.lit(0.0)))


def smoking_status(c, legacy: bool = False) -> Column:
    """Free-text smoking status -> 1 / 0 / NULL.

    ``legacy=True`` tests positive words first, so 'never' (contains 'ever')
    and 'non-smoker' (contains 'smok') map to 1.  The default first tests for
    the whole words 'never' and 'no' (alone) and for 'non-smok...', so 'not
    specified' or 'diagnosis' beside a positive word change nothing.
    """
    raw = col(c)
    s = norm_text(raw)
    num = to_number(raw)
    pos = None
    for w in T.SMOKING_POSITIVE_WORDS:
        pos = s.contains(w) if pos is None else (pos | s.contains(w))
    neg = None
    for w in T.SMOKING_NEGATIVE_WORDS:
        neg = s.contains(w) if neg is None else (neg | s.contains(w))
    expr = F.when(raw.isNull(), F.lit(None).cast("double")).when(num == 0, F.lit(0.0)) \
        .when(num == 1, F.lit(1.0)).when(s.isin(list(T.MISSING_TOKENS)), F.lit(None).cast("double"))
    if legacy:
        expr = expr.when(pos, F.lit(1.0)).when(neg, F.lit(0.0))
    else:
        denied = s.rlike(r"\bnever\b|\bnon[- ]?smok|^no$|\bno smok|\bnot (a )?(current |former |ever )?smok")
        expr = expr.when(denied, F.lit(0.0)).when(pos, F.lit(1.0)).when(neg, F.lit(0.0))
    return (expr.when(s.isin(list(T.SMOKING_TRUE_TEXT)), F.lit(1.0))
            .when(s.isin(list(T.SMOKING_FALSE_TEXT)), F.lit(0.0)))


def sex_display(c) -> Column:
    s = norm_text(c)
    return (F.when(s.isin(list(T.SEX_MALE_TEXT)), F.lit("Male"))
            .when(s.isin(list(T.SEX_FEMALE_TEXT)), F.lit("Female")).otherwise(F.lit("Unknown")))


def ajcc_ordinal(c) -> Column:
    s = norm_text(c)
    expr = None
    for i, st in enumerate(T.AJCC_STAGES):
        expr = F.when(s == st, F.lit(i)) if expr is None else expr.when(s == st, F.lit(i))
    return expr


def age_years(given=None, days_to_birth=None, dx_days=None) -> Column:
    """Given years, else -days_to_birth/365.25 (1 dp), else dx days/365.25 (1 dp)."""
    parts = []
    if given is not None:
        parts.append(to_number(given))
    if days_to_birth is not None:
        parts.append(days_to_years(days_to_birth, negate=True))
    if dx_days is not None:
        parts.append(days_to_years(dx_days))
    return F.coalesce(*parts) if parts else F.lit(None).cast("double")


# ------------------------------------------------------- prior / cap -------

def piecewise_linear(x, anchors: Sequence[tuple[float, float]]) -> Column:
    """Linear interpolation through sorted anchors, flat outside (``np.interp``)."""
    xs = [float(a) for a, _ in anchors]
    ys = [float(b) for _, b in anchors]
    v = col(x).cast("double")
    expr = F.when(v <= xs[0], F.lit(ys[0]))
    for i in range(len(xs) - 1):
        x0, x1, y0, y1 = xs[i], xs[i + 1], ys[i], ys[i + 1]
        if x1 == x0:
            seg = F.lit(y1)
        else:
            seg = F.lit(y0) + (v - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0))
        expr = expr.when(v <= x1, seg)
    return F.when(v.isNotNull(), expr.otherwise(F.lit(ys[-1])))


def apply_prior(p, prior, mode: str = "floor", alpha: float = 0.5) -> Column:
    """floor = max(p, q); blend = (1-a)p + a q; odds = sigmoid(logit p + a logit q)."""
    q = F.coalesce(col(prior), F.lit(0.0))
    mode = mode.lower()
    if mode == "blend":
        return (F.lit(1.0 - alpha) * col(p)) + F.lit(alpha) * q
    if mode == "odds":
        z = clamped_logit(col(p)) + F.lit(alpha) * clamped_logit(q)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return F.greatest(col(p), q)


def cap_probability(p, cap: float | None) -> Column:
    """least(p, cap); ignored unless 0 < cap < 1."""
    if cap is None or not (0.0 < float(cap) < 1.0):
        return col(p)
    return F.least(col(p), F.lit(float(cap)))


def risk_label(p, threshold: float) -> Column:
    """High or low risk; NULL for a missing score."""
    v = F.nanvl(col(p).cast("double"), F.lit(None).cast("double"))
    return F.when(v >= F.lit(float(threshold)), F.lit(T.HIGH_RISK_LABEL)).when(v.isNotNull(), F.lit(T.LOW_RISK_LABEL))


def snake(name: str) -> str:
    """Lower case without outer space; each separator becomes ``_``, and pairs of ``_`` one (a single pass)."""
    return re.sub("__", "_", re.sub(r"[-/\\ .]", "_", str(name).strip())).lower()
