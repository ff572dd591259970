"""Cleaning rules as column expressions (no Python UDF: everything stays in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_outside(c, lo: float, hi: float) -> Column:
    """NULL unless lo <= c <= hi (NaN and NULL also become NULL)."""
    c = col(c)
    return F.when(c.between(lo, hi), c)


def nan_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def fill_unknown(c, value: str = "Unknown") -> Column:
    return F.coalesce(col(c), F.lit(value))


def remote_flag(c) -> Column:
    """1 when the posting says remote, else 0 (an absent flag counts as not remote)."""
    return F.coalesce(col(c), F.lit(0)).cast("int")


def listed_date(c) -> Column:
    return F.timestamp_millis(col(c).cast("long"))


def regex_group(c, pattern: str, group: int = 1) -> Column:
    """First capture of ``pattern`` or NULL when it does not match."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


STATE_END = r",\s*([A-Z]{2})\s*$"
STATE_TOKEN = r",\s*([A-Z]{2})(?:\s|$)"
CITY_HEAD = r"^([^,]+)"


def extract_state(c) -> Column:
    """Two-letter state after the last comma at the end of a location ('Austin, TX')."""
    return regex_group(c, STATE_END)


def extract_state_token(c, fallback=None, default: str | None = "Unknown") -> Column:
    """State code after a comma, followed by space or end; then ``fallback``; then ``default``."""
    parts = [regex_group(c, STATE_TOKEN)]
    if fallback is not None:
        parts.append(col(fallback))
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def extract_state_end(c, company_state, default: str = "Unknown") -> Column:
    """State code right at the end of a location, else the company's state, else ``default``."""
    return F.coalesce(regex_group(c, r",\s*([A-Z]{2})$"), col(company_state).cast("string"), F.lit(default))


def is_yearly(c) -> Column:
    return F.upper(F.coalesce(col(c), F.lit(""))) == "YEARLY"


def extract_city(c, default: str | None = None) -> Column:
    """Text before the first comma of a location (trimmed in the dashboard form)."""
    e = regex_group(c, CITY_HEAD)
    if default is not None:
        e = F.coalesce(F.nullif(F.trim(e), F.lit("")), F.lit(default))
    return e


def label_map(c, mapping: dict, default=None) -> Column:
    """value -> label lookup as a CASE chain; unmapped values give ``default``."""
    c = col(c)
    e = None
    for k, v in mapping.items():
        e = F.when(c == F.lit(k), F.lit(v)) if e is None else e.when(c == F.lit(k), F.lit(v))
    return e.otherwise(F.lit(default))


def size_label(c) -> Column:
    return label_map(c, rules.SIZE_LABELS)


def band(c, edges, labels, include_lowest: bool = False) -> Column:
    """Interval label with (lo, hi] bins; ``None`` as the last edge means unbounded.

    Values outside every bin (including NULL) give NULL. ``include_lowest`` closes the first bin.
    """
    c = col(c)
    e = None
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = (c >= lo) if (i == 0 and include_lowest) else (c > lo)
        if hi is not None:
            cond = cond & (c <= hi)
        e = F.when(cond, F.lit(lab)) if e is None else e.when(cond, F.lit(lab))
    return e


def cap_label(c, cap: int) -> Column:
    """Counts 1..cap-1 as text, cap and above as 'cap+'."""
    c = col(c)
    return F.when(c >= cap, F.lit(f"{cap}+")).otherwise(c.cast("string"))


def title_clean(c) -> Column:
    """lower, non-letters to space, collapse spaces, trim."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    t = F.regexp_replace(t, r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title_norm(c) -> Column:
    return F.trim(F.lower(col(c)))


def slug(c, empty: str | None = "unknown") -> Column:
    """lower, runs of non-alphanumerics to '_', trimmed of '_'; empty -> ``empty``."""
    s = F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), r"[^a-z0-9]+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty)) if empty is not None else s


def competition_score(applies, views, null_applies: str = "drop") -> Column:
    """applies / views where views > 0.

    ``drop``: NULL unless both are present (rows are filtered by the caller);
    ``zero``: missing applies count as 0, missing or zero views give NULL.
    """
    a, v = col(applies), col(views)
    if null_applies == "zero":
        return F.when(F.coalesce(v, F.lit(0.0)) > 0, F.coalesce(a, F.lit(0.0)) / v)
    return F.when(a.isNotNull() & v.isNotNull() & (v > 0), a / v)


def salary_usable(salary, currency, lo=10_000, hi=300_000, currencies=("USD",)) -> Column:
    """Salary in [lo, hi] and currency in the list or missing."""
    cur = col(currency)
    return (col(salary).between(lo, hi) & (cur.isin(list(currencies)) | cur.isNull()))


def rule_label(c, rule_table, default: str) -> Column:
    """First rule whose regex is found in lower(c) gives the label."""
    t = F.lower(F.coalesce(col(c), F.lit("")))
    e = None
    for pattern, lab in rule_table:
        e = F.when(t.rlike(pattern), F.lit(lab)) if e is None else e.when(t.rlike(pattern), F.lit(lab))
    return e.otherwise(F.lit(default))


def title_family(c) -> Column:
    return rule_label(c, rules.TITLE_FAMILY_RULES, rules.TITLE_FAMILY_DEFAULT)


def log1p_safe(c) -> Column:
    """log1p of max(c, 0) with NULL/NaN/inf -> 0."""
    c = col(c).cast("double")
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.log1p(F.greatest(F.when(ok, c).otherwise(F.lit(0.0)), F.lit(0.0)))


def to_number(c) -> Column:
    return F.coalesce(F.expr(f"try_cast({c} as double)") if isinstance(c, str)
                      else col(c).try_cast("double"), F.lit(0.0))


def normalize_city(c) -> Column:
    """City of the salary model: missing/blank -> Unknown; 'remote' anywhere -> Remote; known
    metro names (first match); else the text before the first comma; else the whole text."""
    loc = F.trim(col(c))
    low = F.lower(loc)
    e = F.when(col(c).isNull() | (loc == ""), F.lit("Unknown")).when(low.contains("remote"), F.lit("Remote"))
    for key, val in rules.CITY_METRO_MAP:
        e = e.when(low.contains(key), F.lit(val))
    return e.when(loc.contains(","), F.trim(F.substring_index(loc, ",", 1))).otherwise(loc)


def extract_state_model(c, company_state) -> Column:
    """State of the salary model: code after a comma; else a known metro name; else the
    company's state; else 'Unknown'."""
    low = F.lower(col(c))
    metro = None
    for key, val in rules.STATE_METRO_MAP:
        metro = F.when(low.contains(key), F.lit(val)) if metro is None else metro.when(low.contains(key), F.lit(val))
    return F.coalesce(regex_group(c, STATE_TOKEN), metro, col(company_state).cast("string"), F.lit("Unknown"))


def interaction(a, b) -> Column:
    return F.concat_ws("__", col(a).cast("string"), col(b).cast("string"))
