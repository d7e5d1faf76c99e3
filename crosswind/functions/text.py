"""Text columns: redaction, fingerprints, operator aliases, idea keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED_PATH = "<redacted-path>"
REDACTED_VALUE = "<redacted>"

# What counts as a secret assignment or an absolute path, applied in this order.
SECRET = r"""(?i)\b([A-Za-z_][A-Za-z0-9_]*(?:key|token|secret|password|passwd|credential)s?[A-Za-z0-9_]*)\s*=\s*([^\s'"]+)"""
FILE_URL = r"""(?i)\bfile://[^\s'"`;,)\]}]+"""
UNC_PATH = r"""\\\\[^\s\\'"`;,)\]}]+(?:\\[^\s\\'"`;,)\]}]+)+"""
WINDOWS_PATH = r"""\b[A-Za-z]:[\\/][^\s'"`;,)\]}]+"""
POSIX_PATH = r"""(?:~|/(?:Users|home|root|private|var|tmp|opt|mnt|srv|etc|usr|Volumes|Library))(?:/[^\s'"`;,)\]}]+)+"""
PATHS = (FILE_URL, UNC_PATH, WINDOWS_PATH, POSIX_PATH)

# Operator aliases. Only equivalents are rewritten, the others are reported.
ALIAS_REWRITE = {"ts_stddev": "stddev"}
ALIAS_REPAIR = {"rolling_std": "stddev", "ts_corr": "correlation", "ts_cov": "covariance"}
ALIAS_DRAFT = ("industry_neutralize",)

# Idea keywords in order of precedence, with name and formula.
IDEA_RULES = (
    (("小市值", "小盘", "small cap", "market cap", "市值小"), "small_cap", "-rank(market_cap)"),
    (("动量", "momentum"), "momentum_5d", "rank(return_5d)"),
    (("低波", "波动", "volatility"), "low_volatility", "-rank(volatility_5d)"),
    (("成交量", "交易活跃", "放量", "volume", "liquidity"), "volume_strength", "rank(volume)"),
)
IDEA_DEFAULT = ("close_strength", "rank(close)")
NON_ST_WORDS = ("非st", "non-st", "non st")


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, SECRET, "$1=" + REDACTED_VALUE)
    for pattern in PATHS:
        out = F.regexp_replace(out, pattern, REDACTED_PATH)
    return out


def compact(text: Column) -> Column:
    """Formula text without white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def canonical_filters(filters: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(filters, compact)), ",")


def canonical_fingerprint(**fields: Column) -> Column:
    """sha256 of the fields as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def formula_fingerprint(formula: Column, horizon: Column, filters: Column) -> Column:
    parts = F.concat_ws("|", compact(formula), horizon.cast("string"), canonical_filters(filters))
    return F.sha2(parts, 256)


def _call(names) -> str:
    return r"\b(" + "|".join(names) + r")\s*\("


def rewrite_aliases(formula: Column) -> Column:
    for alias, name in ALIAS_REWRITE.items():
        formula = F.regexp_replace(formula, rf"\b{alias}\s*\(", f"{name}(")
    return formula


def alias_status(formula: Column) -> Column:
    """How a formula's operator names resolve: draft review, repair, rewrite or canonical."""
    return (
        F.when(formula.rlike(_call(ALIAS_DRAFT)), "requires_draft")
        .when(formula.rlike(_call(ALIAS_REPAIR)), "requires_repair")
        .when(formula.rlike(_call(ALIAS_REWRITE)), "rewritten")
        .otherwise("canonical")
    )


def _mentions(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def idea_rule(text: Column) -> Column:
    """Struct (name, formula, non_st) of the first rule whose keyword the text mentions."""
    low = F.lower(F.trim(text))
    non_st = _mentions(low, NON_ST_WORDS)
    name, formula = F.lit(IDEA_DEFAULT[0]), F.lit(IDEA_DEFAULT[1])
    for words, rule_name, rule_formula in reversed(IDEA_RULES):
        hit = _mentions(low, words)
        label = F.lit(rule_name)
        if rule_name == "small_cap":
            label = F.when(non_st, "small_cap_non_st").otherwise("small_cap")
        name, formula = F.when(hit, label).otherwise(name), F.when(hit, rule_formula).otherwise(formula)
    return F.struct(name.alias("name"), formula.alias("formula"), non_st.alias("non_st"))
