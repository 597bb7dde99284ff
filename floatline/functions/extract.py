"""Prospectus text -> typed fields.

One column expression per field, built from ``regexp_extract`` /
``regexp_extract_all`` and higher-order array functions.  ``first_match``
gives "first pattern that matches wins" through ``coalesce``, which stops at
the first non-null branch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from floatline.functions import patterns as P
from floatline.functions.literals import Gate
from floatline.functions.scalars import PY_WS, col_of, parse_number, py_strip
from floatline.functions.text import lockup_section, lockup_section_start


def jp(p: str, dotall: bool = True) -> Column:
    return F.lit(P.java_pattern(p, dotall=dotall))


def _gated(value: Column, gate: Gate | None, pattern: str, otherwise: Column | None = None) -> Column:
    """``value`` where the pattern's words occur, else ``otherwise`` (null)."""
    if gate is None:
        return value
    out = F.when(gate.open(pattern), value)
    return out if otherwise is None else out.otherwise(otherwise)


def first_match(text, patterns: list[str], group: int = 1, dotall: bool = True, gate: Gate | None = None) -> Column:
    """the group of the first pattern that matches; null if none does."""
    t = col_of(text)
    return F.coalesce(*[_gated(F.nullif(F.regexp_extract(t, P.java_pattern(p, dotall=dotall), group), F.lit("")), gate, p)
                        for p in patterns])


def _all_matches(text: Column, pattern: str, dotall: bool, gate: Gate | None) -> Column:
    found = F.regexp_extract_all(text, jp(pattern, dotall), F.lit(1))
    # no text, no list: only a text without the words has an empty one
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return _gated(found, gate, pattern, none)


def all_numbers(text, pattern: str, dotall: bool = False, gate: Gate | None = None) -> Column:
    """every non-overlapping match, parsed; unparsable ones dropped."""
    vals = F.transform(_all_matches(col_of(text), pattern, dotall, gate), lambda s: parse_number(s))
    return F.filter(vals, lambda v: v.isNotNull())


# ── Offering fields ───────────────────────────────────────────────────────────

def offer_price(text) -> Column:
    """X1."""
    return parse_number(first_match(text, P.OFFER_PRICE))


def price_range(text) -> tuple[Column, Column]:
    """(low, high), both from the first pattern that matches."""
    t = col_of(text)
    low_raw = high_raw = None
    for p in P.PRICE_RANGE:
        jpat = P.java_pattern(p, dotall=False)
        g1 = F.regexp_extract(t, jpat, 1)
        g2 = F.regexp_extract(t, jpat, 2)
        if low_raw is None:
            low_raw, high_raw = F.when(g1 != "", g1), F.when(g1 != "", g2)
        else:
            low_raw = low_raw.when(g1 != "", g1)
            high_raw = high_raw.when(g1 != "", g2)
    return parse_number(low_raw), parse_number(high_raw)


def shares_offered_total(text) -> Column:
    """X3."""
    return parse_number(first_match(text, P.SHARES_OFFERED_TOTAL))


def shares_primary(text) -> Column:
    """X4 (company part)."""
    return parse_number(first_match(text, P.SHARES_PRIMARY))


def shares_secondary(text) -> Column:
    """X4 (selling holders part)."""
    return parse_number(first_match(text, P.SHARES_SECONDARY))


def greenshoe_shares(text) -> Column:
    """X5."""
    return parse_number(first_match(text, P.GREENSHOE))


def bookrunners(text, gate: Gate | None = None) -> Column:
    """X6: "A; B; C" from the cover-page block (else the managers heading)."""
    block = first_match(text, [P.BOOKRUNNER_BLOCK, P.BOOKRUNNER_FALLBACK], dotall=False, gate=gate)
    lines = F.split(block, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    cleaned = F.transform(lines, lambda s: py_strip(F.regexp_replace(py_strip(s), r"\*+\z", "")))
    skip = P.java_pattern(P.BOOKRUNNER_SKIP_LINE, dotall=False)
    names = F.filter(cleaned, lambda s: (s != "") & ~s.rlike(skip)
                     & (F.length(s) >= P.BOOKRUNNER_MIN_LEN) & ~s.rlike(r"(?U)^\d"))
    return F.when(F.size(names) > 0, F.array_join(names, P.BOOKRUNNER_SEPARATOR))


# ── Capitalization fields ─────────────────────────────────────────────────────

def shares_post_ipo(text) -> Column:
    """Tier-1 first match; else the largest of all tier-2 matches."""
    tier1 = first_match(text, P.POST_IPO_TIER1)
    tier2 = F.concat(*[all_numbers(text, p) for p in P.POST_IPO_TIER2])
    return F.when(tier1.isNotNull(), parse_number(tier1)).otherwise(F.array_max(tier2))


def shares_pre_ipo(text) -> Column:
    """X8."""
    return parse_number(first_match(text, P.PRE_IPO))


def fully_diluted_shares(text) -> Column:
    """X9."""
    return parse_number(first_match(text, P.FULLY_DILUTED))


# ── Lock-up fields ────────────────────────────────────────────────────────────

def lockup_day_votes(haystack, gate: Gate | None = None) -> Column:
    """Every day count of every pattern, pattern-major, within 30..730."""
    h = col_of(haystack)
    per_pattern = [_all_matches(h, p, dotall, gate)
                   for p, dotall in zip(P.LOCKUP_DAYS, P.LOCKUP_DAYS_DOTALL)]
    days = F.transform(F.flatten(F.array(*per_pattern)), lambda s: s.try_cast("int"))
    return F.filter(days, lambda d: d.between(P.LOCKUP_DAYS_MIN, P.LOCKUP_DAYS_MAX))


def lockup_votes(text) -> Column:
    """Votes in the lock-up section; the whole text when the section has none
    and a section title was found."""
    t = col_of(text)
    start = lockup_section_start(t)
    in_section = lockup_day_votes(lockup_section(t, start))
    return F.when(F.size(in_section) > 0, in_section).when(
        start.isNotNull(), lockup_day_votes(t)).otherwise(in_section)


def mode_first(votes) -> Column:
    """Most frequent value; ties go to the value seen first."""
    v = col_of(votes)
    counts = F.transform(v, lambda x: F.size(F.filter(v, lambda y: y == x)))
    top = F.array_max(counts)
    return F.get(F.filter(v, lambda x: F.size(F.filter(v, lambda y: y == x)) == top), 0)


def lockup_days(text) -> Column:
    """X10."""
    return mode_first(lockup_votes(text))


def staged_unlock(section, gate: Gate | None = None) -> Column:
    """X11: any staged-release phrase in the lock-up section."""
    s = col_of(section)
    hits = [_gated(s.rlike(P.java_pattern(p, dotall=d)), gate, p, F.lit(False)) for p, d in zip(P.STAGED_UNLOCK, P.STAGED_UNLOCK_DOTALL)]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(False))


def unlock_notes(section, gate: Gate | None = None) -> Column:
    """First sentence per note pattern, whitespace collapsed, distinct,
    the first two joined by " | ", cut to 300 characters."""
    s = col_of(section)
    notes = [_gated(F.nullif(F.regexp_replace(py_strip(F.regexp_extract(s, P.java_pattern(p, dotall=False), 0)),
                                              rf"[{PY_WS}]+", " "), F.lit("")), gate, p)
             for p in P.UNLOCK_NOTES]
    kept = F.slice(F.array_distinct(F.filter(F.array(*notes), lambda x: x.isNotNull())),
                   1, P.UNLOCK_NOTES_MAX_NOTES)
    joined = F.substring(F.array_join(kept, P.UNLOCK_NOTES_JOIN), 1, P.UNLOCK_NOTES_MAX_CHARS)
    return F.when(F.size(kept) > 0, joined)


def lockup_confidence(days, staged) -> Column:
    """Low without days; high for a standard count without staging."""
    d, s = col_of(days), col_of(staged)
    return (F.when(d.isNull(), F.lit("low"))
            .when(d.isin(*P.STANDARD_LOCKUP_DAYS) & ~F.coalesce(s, F.lit(False)), F.lit("high"))
            .otherwise(F.lit("medium")))


# ── Staged extraction over a text table ───────────────────────────────────────
# Each field's regex output is projected first and parsed in a second
# projection, so an expensive match is evaluated once per document even when
# its value is read several times (Catalyst keeps such projections apart
# rather than inlining a costly expression into many uses).  Before them, the
# words that the wanted patterns cannot match without are looked up, and a
# pattern runs only where its words occur (see ``literals``).

OFFERING_FIELDS = ["offer_price", "price_range_low", "price_range_high", "shares_offered_direct",
                   "shares_primary", "shares_secondary", "greenshoe_shares", "bookrunners",
                   "shares_outstanding_post_ipo", "shares_outstanding_pre_ipo", "fully_diluted_shares"]
LOCKUP_FIELDS = ["lockup_days", "is_staged_unlock", "unlock_notes", "confidence"]


_FIRST = {"offer_price": P.OFFER_PRICE, "shares_offered_direct": P.SHARES_OFFERED_TOTAL, "shares_primary": P.SHARES_PRIMARY,
          "shares_secondary": P.SHARES_SECONDARY, "greenshoe_shares": P.GREENSHOE,
          "shares_outstanding_pre_ipo": P.PRE_IPO, "fully_diluted_shares": P.FULLY_DILUTED}


def with_offering_fields(df, text: str = "text", fields: list[str] | None = None):
    """Add X1-X9 columns (``shares_offered_direct`` is X3 before D12)."""
    want = set(fields or OFFERING_FIELDS)
    prices = bool(want & {"price_range_low", "price_range_high"})
    post = "shares_outstanding_post_ipo" in want
    gate = Gate(*[p for f in _FIRST if f in want for p in _FIRST[f]], *(P.PRICE_RANGE if prices else []),
                *(P.POST_IPO_TIER1 + P.POST_IPO_TIER2 if post else []),
                *([P.BOOKRUNNER_BLOCK, P.BOOKRUNNER_FALLBACK] if "bookrunners" in want else []))
    t = F.col(text)
    stage1 = [first_match(t, _FIRST[f], gate=gate).alias(f"_raw_{f}") for f in _FIRST if f in want]
    if prices:
        for i, p in enumerate(P.PRICE_RANGE):
            jpat = P.java_pattern(p, dotall=False)
            stage1 += [_gated(F.regexp_extract(t, jpat, k), gate, p).alias(f"_pr{i}_{k}") for k in (1, 2)]
    if post:
        stage1 += [first_match(t, P.POST_IPO_TIER1, gate=gate).alias("_post1"),
                   F.concat(*[all_numbers(t, p, gate=gate) for p in P.POST_IPO_TIER2]).alias("_post2")]
    if "bookrunners" in want:
        stage1.append(bookrunners(t, gate).alias("bookrunners"))
    s1 = gate.add(df, text).select(*df.columns, *stage1)
    out = [parse_number(F.col(f"_raw_{f}")).alias(f) for f in _FIRST if f in want]
    if prices:
        low = high = None
        for i in range(len(P.PRICE_RANGE)):
            g1, g2 = F.col(f"_pr{i}_1"), F.col(f"_pr{i}_2")
            low = (F.when if low is None else low.when)(g1 != "", g1)
            high = (F.when if high is None else high.when)(g1 != "", g2)
        out += [parse_number(low).alias("price_range_low"), parse_number(high).alias("price_range_high")]
    if post:
        out.append(F.when(F.col("_post1").isNotNull(), parse_number(F.col("_post1")))
                   .otherwise(F.array_max("_post2")).alias("shares_outstanding_post_ipo"))
    helpers = [c for c in s1.columns if c.startswith(("_raw_", "_pr", "_post"))]
    return s1.select(*[c for c in s1.columns if c not in helpers], *out)


def with_lockup_fields(df, text: str = "text", fields: list[str] | None = None):
    """Add X10-X13 columns: lockup_days, is_staged_unlock, unlock_notes, confidence."""
    want = set(fields or LOCKUP_FIELDS)
    t = F.col(text)
    days, stages = bool(want & {"lockup_days", "confidence"}), bool(want & {"is_staged_unlock", "confidence"})
    gate = Gate(*(P.LOCKUP_DAYS if days else []), *(P.STAGED_UNLOCK if stages else []),
                *(P.UNLOCK_NOTES if "unlock_notes" in want else []))
    s1 = df.select("*", F.lower(t).alias("_lower")).select(*df.columns, lockup_section_start(t, F.col("_lower")).alias("_start"))
    # Words are looked up in the section, which is the whole text where it has no title.
    s2 = gate.add(s1.select("*", lockup_section(t, F.col("_start")).alias("_section")), "_section")
    sec = F.col("_section")
    stage3 = []
    if days:
        stage3.append(lockup_day_votes(sec, gate).alias("_vs"))
    if stages:
        stage3.append(staged_unlock(sec, gate).alias("is_staged_unlock"))
    if "unlock_notes" in want:
        stage3.append(unlock_notes(sec, gate).alias("unlock_notes"))
    s3 = s2.select("*", *stage3)
    if days:
        votes = (F.when(F.size("_vs") > 0, F.col("_vs"))
                 .when(F.col("_start").isNotNull(), lockup_day_votes(t)).otherwise(F.col("_vs")))
        s4 = s3.select("*", votes.alias("_v"))
        s3 = s4.select("*", mode_first(F.col("_v")).alias("lockup_days"))
    if "confidence" in want:
        s3 = s3.select("*", lockup_confidence("lockup_days", "is_staged_unlock").alias("confidence"))
    keep = [c for c in s3.columns if c not in ("_start", "_section", "_vs", "_v", gate.COLUMN)]
    out = s3.select(*keep)
    extra = {"is_staged_unlock", "lockup_days"} - want
    return out.drop(*[c for c in extra if c in out.columns and c not in df.columns])
