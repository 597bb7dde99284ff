"""DuckDB statements computing the same rows as each registered query.

This is the correctness gate: the driver runs ``queries()`` in Spark and
these statements in DuckDB over the same parquet tables and compares the
results.  The fixture views are CTEs rendered from the same SQL text the
Spark side uses; the extraction rules come from the same fixed pattern
values (in their RE2 form).  Expression builders below take SQL operand
text and return SQL text.
"""

from __future__ import annotations

import re
from html.entities import html5

from floatline.functions import patterns as P
from floatline.functions.scalars import DATE_FORMATS, MAX_VALID_EPOCH_MS, PY_WS, PY_WS_NO_NL
from floatline.functions.text import BARE_NAMES, C1_REMAP, CHAR_REF, DROPPED_ELEMENTS, NON_CONTENT, TAG_RUN
from floatline.operators.filings import FILING_FORMS, FORM_TIERS, TARGET_FORMS
from floatline.plans import catalog as CAT
from floatline.plans import reports as R
from floatline.sources.fixtures import AS_OF, duck_ctes

AS_OF_SQL = f"date '{AS_OF}'"
NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


# ── Scalar builders ───────────────────────────────────────────────────────────

def strip(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'^[{PY_WS}]+|[{PY_WS}]+\\z')}, '', 'g')"


def blank_null(e: str) -> str:
    return f"nullif({strip(e)}, '')"


def parse_number(e: str) -> str:
    s = strip(e)
    low = f"lower({s})"
    body = (f"case when contains({low}, 'billion') then regexp_replace({s}, '\\s*billion', '', 'gi') "
            f"when contains({low}, 'million') then regexp_replace({s}, '\\s*million', '', 'gi') else {s} end")
    value = f"try_cast({strip(f'replace({body}, {lit(',')}, {lit('')})')} as double)"
    mult = (f"case when contains({low}, 'billion') then cast(1000000000 as double) "
            f"when contains({low}, 'million') then cast(1000000 as double) else cast(1 as double) end")
    return f"case when {e} is null or {e} = '' then cast(null as double) else {value} * {mult} end"


def normalize_cik(e: str) -> str:
    n = f"try_cast({strip(e)} as bigint)"
    digits = f"cast(abs({n}) as varchar)"
    pad = lambda w: f"case when length({digits}) >= {w} then {digits} else lpad({digits}, {w}, '0') end"
    return (f"case when {n} is null then cast(null as varchar) when {n} < 0 then '-' || {pad(9)} "
            f"else {pad(10)} end")


def primary_url(cik: str, acc: str, doc: str) -> str:
    from floatline.functions.scalars import ARCHIVE_BASE
    cik_int = f"cast(try_cast({strip(cik)} as bigint) as varchar)"
    return (f"case when coalesce({acc}, '') <> '' and coalesce({doc}, '') <> '' then "
            f"{lit(ARCHIVE_BASE + '/')} || {cik_int} || '/' || replace({acc}, '-', '') || '/' || {doc} end")


def index_url(cik: str, acc: str) -> str:
    from floatline.functions.scalars import ARCHIVE_BASE
    cik_int = f"cast(try_cast({strip(cik)} as bigint) as varchar)"
    return (f"case when coalesce({acc}, '') <> '' then coalesce("
            f"{lit(ARCHIVE_BASE + '/')} || {cik_int} || '/' || replace({acc}, '-', '') || '/', '') else '' end")


def epoch_to_date(e: str) -> str:
    n = f"try_cast({strip(f'cast({e} as varchar)')} as bigint)"
    return f"case when {n} > 0 and {n} <= {MAX_VALID_EPOCH_MS} then cast(epoch_ms({n}) as date) end"


_DUCK_FORMATS = {"yyyy-MM-dd": "%Y-%m-%d", "MMMM d, yyyy": "%B %d, %Y", "MMM d, yyyy": "%b %d, %Y",
                 "d-MMM-yyyy": "%d-%b-%Y", "MM/dd/yyyy": "%m/%d/%Y"}


def parse_date(e: str) -> str:
    s = strip(e)
    return "coalesce(" + ", ".join(f"cast(try_strptime({s}, {lit(_DUCK_FORMATS[f])}) as date)"
                                  for f in DATE_FORMATS) + ")"


# ── Text builders ─────────────────────────────────────────────────────────────

def normalize_ws(e: str) -> str:
    return strip(f"regexp_replace({e}, {lit(f'[{PY_WS}]+')}, ' ', 'g')")


def html_to_text(e: str) -> str:
    x = f"coalesce({e}, '')"
    x = f"regexp_replace({x}, {lit(NON_CONTENT)}, '', 'g')"
    x = f"regexp_replace({x}, {lit(_element('head'))}, '', 'g')"
    x = f"regexp_replace({x}, {lit(TAG_RUN)}, {NL}, 'g')"
    x = decode_refs(x)
    x = f"regexp_replace({x}, '\\r\\n?', {NL}, 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', {NL} || {NL}, 'g')"
    x = f"regexp_replace({x}, {lit(f'(?m)[{PY_WS_NO_NL}]+$')}, '', 'g')"
    return strip(x)


def decode_refs(x: str) -> str:
    names = "map([" + ", ".join(lit(k) for k in html5) + "], [" + ", ".join(lit(v) for v in html5.values()) + "])"
    digits = "regexp_extract(c, '^#[xX]?0*([0-9a-fA-F]*);?$', 1)"
    raw = (f"case when length({digits}) > 8 then -1 when {digits} = '' then 0 "
           f"when lower(substring(c, 2, 1)) = 'x' then try_cast('0x' || {digits} as bigint) else try_cast({digits} as bigint) end")
    n = f"case ({raw}) " + " ".join(f"when {a} then {b}" for a, b in C1_REMAP.items()) + f" else ({raw}) end"
    numeric = (f"case when ({n}) between 1 and 1114111 and not ({n}) between 55296 and 57343 "
               f"then chr(cast(({n}) as integer)) else chr(65533) end")
    bare = f"regexp_extract(c, {lit(BARE_NAMES)}, 1)"
    named = f"coalesce({names}[c], {names}[{bare}] || substring(c, length({bare}) + 1), '&' || c)"
    chars = f"list_transform(regexp_extract_all({x}, {lit(CHAR_REF)}, 1), lambda c: case when c[1] = '#' then {numeric} else {named} end)"
    pieces = f"list_transform(list_zip(string_split_regex({x}, {lit(CHAR_REF)}), {chars}), lambda p: coalesce(p[1], '') || coalesce(p[2], ''))"
    return f"case when strpos({x}, '&') > 0 then array_to_string({pieces}, '') else {x} end"


def _element(name: str) -> str:
    assert name in DROPPED_ELEMENTS
    return rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|\z)"


LINE_SPLIT = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def find_section(t: str, titles: list[str], window: int = P.SECTION_WINDOW_CHARS) -> str:
    """Needs ``t`` to be a column name (used inside lambdas)."""
    found = [f"case when regexp_matches({t}, {lit('(?i)' + re.escape(x))}) then "
             f"length(regexp_extract({t}, {lit('(?is)^(.*?)' + re.escape(x))}, 1)) + 1 end" for x in titles]
    pos = "coalesce(" + ", ".join(found) + ")"
    lines = f"string_split_regex(substring({t}, {pos}, {window}), {lit(LINE_SPLIT)})"
    flags = (f"list_transform({lines}, lambda l, i: i - 1 >= {P.SECTION_BOUNDARY_FROM_LINE} "
             f"and regexp_matches({strip('l')}, {lit(P.SECTION_BOUNDARY)}))")
    cut = f"list_position({flags}, true)"
    kept = f"case when coalesce({cut}, 0) > 0 then {lines}[1:{cut}] else {lines} end"
    return f"case when {pos} is not null then {strip(f'array_to_string({kept}, {NL})')} end"


def lockup_start(t: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(strpos(lower({t}), {lit(x)}), 0)"
                                   for x in P.LOCKUP_SECTION_TITLES) + ")"


def lockup_section(t: str) -> str:
    s = lockup_start(t)
    return f"case when {s} is not null then substring({t}, {s}, {P.LOCKUP_SECTION_CHARS}) else {t} end"


# ── Extraction builders ───────────────────────────────────────────────────────

def rx(p: str) -> str:
    return lit(P.re2_pattern(p))


def first_match(t: str, patterns, opts: str = "is") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {rx(p)}, 1, '{opts}'), '')"
                                   for p in patterns) + ")"


def all_numbers(t: str, p: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({t}, {rx(p)}, 1, 'i'), "
            f"lambda s: {parse_number('s')}), lambda v: v is not null)")


def price_range_raw(t: str) -> tuple[str, str]:
    g1 = [f"regexp_extract({t}, {rx(p)}, 1, 'i')" for p in P.PRICE_RANGE]
    g2 = [f"regexp_extract({t}, {rx(p)}, 2, 'i')" for p in P.PRICE_RANGE]
    low = "case " + " ".join(f"when {a} <> '' then {a}" for a in g1) + " end"
    high = "case " + " ".join(f"when {a} <> '' then {b}" for a, b in zip(g1, g2)) + " end"
    return low, high


def bookrunners(t: str) -> str:
    block = (f"coalesce(nullif(regexp_extract({t}, {rx(P.BOOKRUNNER_BLOCK)}, 1, 'i'), ''), "
             f"nullif(regexp_extract({t}, {rx(P.BOOKRUNNER_FALLBACK)}, 1, 'i'), ''))")
    split = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    lines = f"string_split_regex({block}, {lit(split)})"
    no_stars = f"regexp_replace({strip('s')}, {lit(r'\*+\z')}, '', 'g')"
    cleaned = f"list_transform({lines}, lambda s: {strip(no_stars)})"
    names = (f"list_filter({cleaned}, lambda s: s <> '' and not regexp_matches(s, {rx(P.BOOKRUNNER_SKIP_LINE)}, 'i') "
             f"and length(s) >= {P.BOOKRUNNER_MIN_LEN} and not regexp_matches(s, '^[0-9]'))")
    return f"case when len({names}) > 0 then array_to_string({names}, {lit(P.BOOKRUNNER_SEPARATOR)}) end"


def votes_in(h: str) -> str:
    parts = [f"regexp_extract_all({h}, {rx(p)}, 1, '{'is' if d else 'i'}')"
             for p, d in zip(P.LOCKUP_DAYS, P.LOCKUP_DAYS_DOTALL)]
    return (f"list_filter(list_transform(flatten([{', '.join(parts)}]), lambda s: try_cast(s as integer)), "
            f"lambda d: d between {P.LOCKUP_DAYS_MIN} and {P.LOCKUP_DAYS_MAX})")


def votes(t: str) -> str:
    sec = votes_in(lockup_section(t))
    return (f"case when len({sec}) > 0 then {sec} when {lockup_start(t)} is not null "
            f"then {votes_in(t)} else {sec} end")


def mode_first(v: str) -> str:
    """``v`` must be a column name."""
    cnt = f"len(list_filter({v}, lambda y: y = x))"
    return (f"list_filter({v}, lambda x: {cnt} = list_max(list_transform({v}, lambda x: {cnt})))[1]")


def staged(sec: str) -> str:
    hits = [f"regexp_matches({sec}, {rx(p)}, '{'is' if d else 'i'}')"
            for p, d in zip(P.STAGED_UNLOCK, P.STAGED_UNLOCK_DOTALL)]
    return f"coalesce({' or '.join(hits)}, false)"


def unlock_notes(sec: str) -> str:
    n = [f"nullif(regexp_replace({strip(f'regexp_extract({sec}, {rx(p)}, 0, {lit(chr(105))})')}, "
         f"{lit(f'[{PY_WS}]+')}, ' ', 'g'), '')" for p in P.UNLOCK_NOTES]
    arr = (f"list_filter([{n[0]}, case when {n[1]} is distinct from {n[0]} then {n[1]} end, "
           f"case when {n[2]} is distinct from {n[0]} and {n[2]} is distinct from {n[1]} then {n[2]} end], "
           f"lambda x: x is not null)[1:{P.UNLOCK_NOTES_MAX_NOTES}]")
    return (f"case when len({arr}) > 0 then substring(array_to_string({arr}, {lit(P.UNLOCK_NOTES_JOIN)}), 1, "
            f"{P.UNLOCK_NOTES_MAX_CHARS}) end")


def confidence(days: str, stg: str) -> str:
    return (f"case when {days} is null then 'low' when {days} in {inlist(P.STANDARD_LOCKUP_DAYS)} "
            f"and not coalesce({stg}, false) then 'high' else 'medium' end")


def offering_select(t: str) -> str:
    """Raw fields of X1-X9 over text column ``t`` (D12 applied on top)."""
    low, high = price_range_raw(t)
    tier1 = first_match(t, P.POST_IPO_TIER1)
    tier2 = f"list_concat({all_numbers(t, P.POST_IPO_TIER2[0])}, {all_numbers(t, P.POST_IPO_TIER2[1])})"
    return f"""{parse_number(first_match(t, P.OFFER_PRICE))} as offer_price,
      {parse_number(low)} as price_range_low, {parse_number(high)} as price_range_high,
      {parse_number(first_match(t, P.SHARES_OFFERED_TOTAL))} as _total,
      {parse_number(first_match(t, P.SHARES_PRIMARY))} as shares_primary,
      {parse_number(first_match(t, P.SHARES_SECONDARY))} as shares_secondary,
      {parse_number(first_match(t, P.GREENSHOE))} as greenshoe_shares,
      {bookrunners(t)} as bookrunners,
      case when {tier1} is not null then {parse_number(tier1)} else list_max({tier2}) end as shares_outstanding_post_ipo,
      {parse_number(first_match(t, P.PRE_IPO))} as shares_outstanding_pre_ipo,
      {parse_number(first_match(t, P.FULLY_DILUTED))} as fully_diluted_shares"""


DERIVED = """case when shares_primary is not null and shares_secondary is not null then shares_primary + shares_secondary
      when _total is not null then _total else coalesce(shares_primary, shares_secondary) end"""


def tier_case(col: str) -> str:
    return "case " + " ".join(f"when {col} in {inlist(forms)} then {i}"
                              for i, forms in enumerate(FORM_TIERS, start=1)) + " end"


# ── Shared CTE blocks ─────────────────────────────────────────────────────────

BEST = f"""best as (
  select * exclude (_tier, _rn) from (
    select *, row_number() over (partition by issuer_id order by _tier, filing_date desc nulls last, id) as _rn
    from (select *, {tier_case('form_type')} as _tier from fx_filings) where _tier is not null) where _rn = 1)"""


def worklist(force: bool, existing: str | None) -> str:
    done = "false" if force else (
        f"exists (select 1 from {existing} e where e.issuer_id = w.issuer_id and e.filing_id = w.filing_id)"
        if existing else "coalesce(w.is_parsed, false)")
    return f"""{BEST},
work0 as (
  select i.id as issuer_id, b.id as filing_id, b.form_type, b.filing_date, b.primary_doc_url, b.is_parsed,
    d.url as _url, d.html, cast(length(d.html) as bigint) as doc_chars
  from fx_issuers i left join best b on b.issuer_id = i.id
  left join raw_documents d on d.url = b.primary_doc_url),
work1 as (
  select w.*, case when filing_id is null then 'no_best_filing'
    when coalesce(primary_doc_url, '') = '' then 'no_url'
    when {done} then 'already_parsed'
    when _url is null then 'document_missing'
    when doc_chars = 0 then 'empty_document' end as reason
  from work0 w),
work as (select *, case when reason is null then 'parse' when reason = 'document_missing' then 'failed'
  else 'skipped' end as outcome from work1),
texts as (select issuer_id, filing_id, form_type, filing_date, {html_to_text('html')} as text
  from work where outcome = 'parse')"""


def offering_fields_ctes(force: bool = False) -> str:
    return f"""{worklist(force, None)},
raw as (select issuer_id, filing_id, form_type, {offering_select('text')} from texts),
fields as (select * exclude (_total), {DERIVED} as shares_offered_total from raw),
fields2 as (select *,
    case when offer_price is not null and offer_price <> 0 and shares_offered_total is not null
      and shares_offered_total <> 0 then offer_price * shares_offered_total end as gross_proceeds,
    case when shares_offered_total is not null and shares_offered_total <> 0
      and shares_outstanding_post_ipo is not null and shares_outstanding_post_ipo > 0
      then shares_offered_total / shares_outstanding_post_ipo end as float_ratio
  from fields)"""


def lockup_fields_ctes(force: bool = False) -> str:
    return f"""{worklist(force, 'fx_lockups')},
lraw as (select issuer_id, filing_id, filing_date, {votes('text')} as v,
    {staged(lockup_section('text'))} as is_staged_unlock, {unlock_notes(lockup_section('text'))} as unlock_notes
  from texts),
lfields as (select issuer_id, filing_id, {mode_first('v')} as lockup_days, filing_date as lockup_start_date,
    is_staged_unlock, unlock_notes from lraw),
lfields2 as (select issuer_id, filing_id, lockup_days, lockup_start_date,
    case when lockup_start_date is not null and lockup_days is not null
      then cast(lockup_start_date + lockup_days as date) end as lockup_end_date,
    is_staged_unlock, unlock_notes, {confidence('lockup_days', 'is_staged_unlock')} as confidence
  from lfields)"""


def upsert_sql(stored: str, fresh: str, cols: list[str], set_cols: list[str], keep_nulls: bool,
               insert_from: str | None = None) -> str:
    """Stored rows updated on (issuer_id, filing_id) + new rows numbered."""
    def merged(c):
        if c == "parsed_at":
            return f"case when n._hit then {AS_OF_SQL} else o.parsed_at end as parsed_at"
        if c in set_cols:
            new = f"n.{c}" if keep_nulls else f"coalesce(n.{c}, o.{c})"
            return f"case when n._hit then {new} else o.{c} end as {c}"
        return f"o.{c}"
    fresh_cols = set_cols
    ins_src = insert_from or fresh
    ins_cols = []
    for c in cols:
        if c == "id":
            ins_cols.append(f"(select coalesce(max(id), 0) from {stored}) + row_number() over (order by n.issuer_id, n.filing_id) as id")
        elif c in ("issuer_id", "filing_id") or c in fresh_cols:
            ins_cols.append(f"n.{c}")
        elif c == "parsed_at":
            ins_cols.append(f"{AS_OF_SQL} as parsed_at")
        else:
            ins_cols.append(f"null as {c}")
    return f"""
select {', '.join(merged(c) for c in cols)}
from {stored} o left join (select *, true as _hit from {fresh}) n
  on n.issuer_id = o.issuer_id and n.filing_id = o.filing_id
union all
select {', '.join(ins_cols)}
from {ins_src} n
where not exists (select 1 from {stored} s where s.issuer_id = n.issuer_id and s.filing_id = n.filing_id)"""


def top1(table: str, part: str, order: str, where: str = "true") -> str:
    return (f"(select * exclude (_rn) from (select *, row_number() over (partition by {part} order by {order}) as _rn "
            f"from {table} where {where}) where _rn = 1)")


def latest(table: str) -> str:
    return top1(table, "issuer_id", "parsed_at desc nulls last, id")


# ── Source CTEs ───────────────────────────────────────────────────────────────

NASDAQ = f"""nq as (
  select *, row_number() over (partition by month, page, section order by row_key) - 1 as pos,
    case section when 'priced' then 0 when 'upcoming' then 1 when 'filed' then 2 end as section_rank
  from nasdaq_rows
  where not (cast(substring(month, 6, 2) as integer) + page * 3) % 5 = 1 and month between strftime(cast(date_trunc('month', {AS_OF_SQL}) - interval 1 month as date), '%Y-%m')
    and strftime(cast(date_trunc('month', {AS_OF_SQL}) + interval 2 month as date), '%Y-%m')),
nq1 as ({top1("(select * from nq where section <> 'withdrawn')", "coalesce(dealID, '')", 'month, section_rank, page, pos')[1:-1]}),
nasdaq_c as (
  select 0 as source_rank,
    month || '/' || cast(section_rank as varchar) || '/' || lpad(cast(page as varchar), 19, '0') || '/' || lpad(cast(pos as varchar), 19, '0') as ord,
    {strip("coalesce(companyName, '')")} as company_name, {blank_null('proposedTickerSymbol')} as ticker,
    {blank_null('proposedExchange')} as exchange, {lit("https://www.nasdaq.com/market-activity/ipos")} as source_url,
    nullif(dateText, '') as raw_date_text
  from nq1)"""

NYSE = f"""ny as (select *, row_number() over (partition by page order by row_key) - 1 as pos from nyse_rows where page % 3 <> 1),
nyse_c as (
  select 1 as source_rank, lpad(cast(page as varchar), 19, '0') || '/' || lpad(cast(pos as varchar), 19, '0') as ord, {strip("coalesce(issuer_nm, '')")} as company_name,
    {blank_null('symbol')} as ticker, {blank_null('custom_group_exchange_nm')} as exchange,
    {lit("https://www.nyse.com/ipo-center")} as source_url,
    cast(coalesce({epoch_to_date('price_dt')}, {epoch_to_date('init_file_dt')}) as varchar) as raw_date_text
  from ny where deal_status_flg is distinct from 'W')"""

# The landed submissions documents that cannot be read (sources/landing.py).
UNREADABLE_SUBMISSION = "((try_cast(cik as bigint) * 7 + page * 3) % 61 = 5)"

SUBMISSIONS = f"""sr as (
  select *, row_number() over (partition by cik, page order by row_key) - 1 as pos,
    row_number() over (partition by cik, page order by row_key desc) as _rev
  from sec_filing_rows),
unread as (select distinct cik, page from sec_filing_rows where {UNREADABLE_SUBMISSION}),
target as (
  select {normalize_cik('cik')} as cik10, page, pos, accession_no, form as form_type, filingDate as filing_date,
    case when page % 5 = 0 and _rev = 1 then null else nullif(primaryDocument, '') end as primary_doc,
    cik as doc_cik
  from sr where form in {inlist(TARGET_FORMS)} and not {UNREADABLE_SUBMISSION}),
target2 as (
  select cik10, page, pos, accession_no, form_type, filing_date, primary_doc,
    {primary_url('doc_cik', 'accession_no', 'primary_doc')} as primary_doc_url,
    {index_url('doc_cik', 'accession_no')} as filing_index_url
  from target)"""

SYNC = f"""{SUBMISSIONS},
stored as (select * from fx_filings where filing_date < date '{CAT.SYNC_STORED_BEFORE}'),
keyed as (select id as issuer_id, {normalize_cik('cik')} as cik10 from fx_issuers where cik is not null),
found as (select k.issuer_id, t.* exclude (cik10) from target2 t join keyed k on k.cik10 = t.cik10),
valid as (select * from found where coalesce(accession_no, '') <> '' and coalesce(form_type, '') <> ''),
firsts as ({top1('valid', 'issuer_id, accession_no, form_type', "coalesce(filing_date, '') desc, page, pos")[1:-1]}),
newf as (select * from firsts f where not exists (select 1 from stored s where s.issuer_id = f.issuer_id
    and s.accession_no = f.accession_no and s.form_type = f.form_type)),
new_rows as (
  select (select coalesce(max(id), 0) from stored)
      + row_number() over (order by issuer_id, coalesce(filing_date, '') desc, page, pos) as id,
    issuer_id, accession_no, form_type, try_cast(filing_date as date) as filing_date,
    primary_doc_url, filing_index_url, false as is_parsed
  from newf),
trans as (
  select i.id as issuer_id, i.status as old_status,
    case when bool_or(v.form_type = 'RW') then 'withdrawn'
      when coalesce(nullif(i.status, ''), 'candidate') in ('priced', 'trading') then coalesce(nullif(i.status, ''), 'candidate')
      when bool_or(v.form_type in {inlist(FILING_FORMS)}) and coalesce(nullif(i.status, ''), 'candidate') <> 'withdrawn' then 'filed'
      else coalesce(nullif(i.status, ''), 'candidate') end as new_status
  from fx_issuers i join found f on f.issuer_id = i.id
  left join valid v on v.issuer_id = f.issuer_id and v.page = f.page and v.pos = f.pos
  where i.cik is not null
  group by i.id, i.status)"""

def candidates_block(source: str) -> str:
    return CANDIDATES.replace("from fx_candidates where", f"from {source} where")


CANDIDATES = f"""dd as (
  select * from (select *, row_number() over (
      partition by upper({strip("coalesce(ticker, '')")}), lower({strip("coalesce(company_name, '')")})
      order by source_rank, ord) as _rn
    from fx_candidates where lower({strip("coalesce(company_name, '')")}) <> '') where _rn = 1),
prep as (select source_rank, ord, {strip("coalesce(company_name, '')")} as company_name,
    {blank_null('ticker')} as ticker, case when exchange <> '' then exchange end as exchange,
    case when source_url <> '' then source_url end as source_url from dd),
bt as (select ticker as _t, min(id) as _tid from fx_issuers where ticker is not null group by ticker),
bn as (select lower(company_name) as _n, min(id) as _nid from fx_issuers group by lower(company_name)),
matched as (select p.*, coalesce(_tid, _nid) as issuer_id,
    case when _tid is not null then 'ticker' when _nid is not null then 'name' end as match_kind
  from prep p left join bt on p.ticker = bt._t left join bn on lower(p.company_name) = bn._n),
hit as (select * from matched where issuer_id is not null),
fill as (
  select h.issuer_id,
    {', '.join(f"min(struct_pack(a := h.source_rank, b := h.ord)) filter (where h.{f} is not null) as o_{f}, arg_min(h.{f}, struct_pack(a := h.source_rank, b := h.ord)) filter (where h.{f} is not null) as v_{f}" for f in ['exchange', 'ticker', 'source_url'])}
  from hit h group by h.issuer_id),
fill2 as (select f.issuer_id,
    {', '.join(f"case when coalesce(i.{c}, '') = '' and f.v_{c} is not null then f.o_{c} end as fo_{c}, case when coalesce(i.{c}, '') = '' and f.v_{c} is not null then f.v_{c} end as fv_{c}" for c in ['exchange', 'ticker', 'source_url'])}
  from fill f join fx_issuers i on i.id = f.issuer_id),
acts as (
  select h.source_rank, h.ord, h.issuer_id,
    case when {' or '.join(f"coalesce(f.fo_{c} = struct_pack(a := h.source_rank, b := h.ord), false)" for c in ['exchange', 'ticker', 'source_url'])}
      then 'updated' else 'skipped' end as action
  from hit h left join fill2 f on f.issuer_id = h.issuer_id
  union all
  select source_rank, ord, (select max(id) from fx_issuers) + row_number() over (order by source_rank, ord), 'inserted'
  from matched where issuer_id is null),
new_issuers as (
  select i.id, i.company_name, i.cik, coalesce(f.fv_ticker, i.ticker) as ticker,
    coalesce(f.fv_exchange, i.exchange) as exchange, i.status, coalesce(f.fv_source_url, i.source_url) as source_url,
    i.country, i.is_foreign_issuer, i.created_at,
    case when f.fo_exchange is not null or f.fo_ticker is not null or f.fo_source_url is not null then {AS_OF_SQL} else i.updated_at end as updated_at
  from fx_issuers i left join fill2 f on f.issuer_id = i.id
  union all
  select (select max(id) from fx_issuers) + row_number() over (order by source_rank, ord), company_name,
    cast(null as varchar), ticker, exchange, 'candidate', source_url, cast(null as varchar), false, {AS_OF_SQL}, {AS_OF_SQL}
  from matched where issuer_id is null)"""


def with_(*blocks: str) -> str:
    """Fixture CTEs followed by query CTEs."""
    head = duck_ctes()
    return head + "".join(",\n" + b for b in blocks) + "\n"


# ── Statements ────────────────────────────────────────────────────────────────

def _build() -> dict[str, str]:
    q: dict[str, str] = {}
    W = with_

    q["normalize_cik"] = W() + f"""
select id, raw, {normalize_cik('raw')} as cik10 from (
  select c_custkey as id,
    case when c_custkey % 7 = 0 then 'abc' || cast(c_custkey as varchar)
      when c_custkey % 7 = 1 then ' 00' || cast(c_custkey as varchar) || ' '
      when c_custkey % 7 = 2 then cast(c_custkey * 100000000 as varchar)
      when c_custkey % 7 = 3 then '-' || cast(c_custkey as varchar)
      else cast(c_custkey + 320000 as varchar) end as raw
  from customer)"""

    q["parse_number"] = W() + f"""
select id, raw, {parse_number('raw')} as value from (
  select o_orderkey as id,
    case when o_orderkey % 6 = 0 then format('{{:,}}', o_orderkey * 1013)
      when o_orderkey % 6 = 1 then cast(o_orderkey % 900 as varchar) || '.' || lpad(cast(o_orderkey % 100 as varchar), 2, '0') || ' million'
      when o_orderkey % 6 = 2 then cast(1 + o_orderkey % 9 as varchar) || '.5 Billion'
      when o_orderkey % 6 = 3 then ' ' || format('{{:,}}', o_orderkey) || ' '
      when o_orderkey % 6 = 4 then ['n/a', '12d', '0x1p3', '3e2'][o_orderkey % 4 + 1] else '' end as raw
  from orders)"""

    month = "case month(d) " + " ".join(f"when {i} then {lit(m)}" for i, m in enumerate(CAT.MONTHS, 1)) + " end"
    mon3 = "case month(d) " + " ".join(f"when {i} then {lit(m[:3])}" for i, m in enumerate(CAT.MONTHS, 1)) + " end"
    q["parse_date"] = W() + f"""
select id, raw, {parse_date('raw')} as parsed from (
  select id, case when id % 6 = 0 then cast(d as varchar)
      when id % 6 = 1 then {month} || ' ' || cast(day(d) as varchar) || ', ' || cast(year(d) as varchar)
      when id % 6 = 2 then {mon3} || ' ' || cast(day(d) as varchar) || ', ' || cast(year(d) as varchar)
      when id % 6 = 3 then lpad(cast(day(d) as varchar), 2, '0') || '-' || {mon3} || '-' || cast(year(d) as varchar)
      when id % 6 = 4 then lpad(cast(month(d) as varchar), 2, '0') || '/' || lpad(cast(day(d) as varchar), 2, '0') || '/' || cast(year(d) as varchar)
      else 'not a date' end as raw
  from (select o_orderkey as id, cast(o_orderdate as date) as d from orders))"""

    q["add_days"] = W() + f"""
select id, filing_date, days, raw, cast(filing_date + days as date) as shifted,
  cast({parse_date('raw')} + days as date) as shifted_text from (
  select id, filing_date, case id % 4 when 0 then 90 when 1 then 180 when 2 then -30 end as days,
    case when id % 7 = 0 then 'to come' else cast(filing_date as varchar) end as raw from fx_filings)"""

    q["epoch_ms_to_date"] = W() + f"""
select event_id, raw, {epoch_to_date('raw')} as d from (
  select event_id, case when event_id % 9 = 0 then 'TBA'
      when event_id % 9 = 1 then cast(-ms as varchar)
      when event_id % 9 = 2 then cast(ms * 1000 as varchar)
      else cast(ms as varchar) end as raw
  from (select *, cast(floor(epoch_us(ts) / 1000) as bigint) as ms from events))"""

    q["filing_urls"] = W() + f"""
select row_key, {primary_url('cik', 'acc', "nullif(primaryDocument, '')")} as primary_doc_url,
  {index_url('cik', 'acc')} as filing_index_url
from (select row_key, cik, case when row_key % 23 = 0 then '' else accession_no end as acc, primaryDocument
      from sec_filing_rows)"""

    q["normalize_whitespace"] = W() + f"select doc_id, {normalize_ws('text')} as text from documents"
    q["html_to_text"] = W() + f"select page_id, {html_to_text('html')} as text from pages"
    q["find_section"] = W() + f"select doc_id, {find_section('text', CAT.FIND_SECTION_TITLES)} as section from documents"
    q["lockup_section"] = W() + f"select filing_id, {lockup_section('text')} as section from fx_texts"

    x = "from fx_texts"
    q["offer_price"] = W() + f"select filing_id, {parse_number(first_match('text', P.OFFER_PRICE))} as offer_price {x}"
    lo, hi = price_range_raw("text")
    q["price_range"] = W() + f"select filing_id, {parse_number(lo)} as price_range_low, {parse_number(hi)} as price_range_high {x}"
    q["shares_offered_total"] = W() + f"select filing_id, {parse_number(first_match('text', P.SHARES_OFFERED_TOTAL))} as shares_offered_total {x}"
    q["shares_primary_secondary"] = W() + (f"select filing_id, {parse_number(first_match('text', P.SHARES_PRIMARY))} as shares_primary, "
                                            f"{parse_number(first_match('text', P.SHARES_SECONDARY))} as shares_secondary {x}")
    q["greenshoe_shares"] = W() + f"select filing_id, {parse_number(first_match('text', P.GREENSHOE))} as greenshoe_shares {x}"
    q["bookrunners"] = W() + f"select filing_id, {bookrunners('text')} as bookrunners {x}"
    q["shares_post_ipo"] = W() + f"select filing_id, shares_outstanding_post_ipo from (select filing_id, {offering_select('text')} {x})"
    q["shares_pre_ipo"] = W() + f"select filing_id, {parse_number(first_match('text', P.PRE_IPO))} as shares_outstanding_pre_ipo {x}"
    q["fully_diluted"] = W() + f"select filing_id, {parse_number(first_match('text', P.FULLY_DILUTED))} as fully_diluted_shares {x}"
    q["lockup_days"] = W() + f"select filing_id, {mode_first('v')} as lockup_days from (select filing_id, {votes('text')} as v {x})"
    q["staged_unlock"] = W() + f"select filing_id, {staged(lockup_section('text'))} as is_staged_unlock {x}"
    q["unlock_notes"] = W() + f"select filing_id, {unlock_notes(lockup_section('text'))} as unlock_notes {x}"
    q["lockup_confidence"] = W() + f"""
select filing_id, lockup_days, is_staged_unlock, {confidence('lockup_days', 'is_staged_unlock')} as confidence from (
  select filing_id, {mode_first('v')} as lockup_days, is_staged_unlock from (
    select filing_id, {votes('text')} as v, {staged(lockup_section('text'))} as is_staged_unlock {x}))"""

    # Sources
    q["nasdaq_candidates"] = W(NASDAQ) + "select * from nasdaq_c"
    q["nyse_candidates"] = W(NYSE) + "select * from nyse_c"
    cand_cols = "source_rank, ord, company_name, ticker, exchange, source_url"
    q["candidates_union"] = W(NASDAQ, NYSE) + f"select {cand_cols} from nasdaq_c union all select {cand_cols} from nyse_c"
    q["target_filings"] = W(SUBMISSIONS) + "select * from target2"
    def company_search(queries: str, most: int) -> str:
        return f"""
select query_id, rank, {normalize_cik("coalesce(cik, '0')")} as cik, name, ticker, exchange from (
  select q.query_id, c.*, row_number() over (partition by q.query_id order by c.page, c.pos) as rank
  from (select *, row_number() over (partition by page order by row_key) - 1 as pos from company_rows) c
  join (select query_id, lower({strip("coalesce(query, '')")}) as q from {queries}) q
    on contains(lower(coalesce(c.name, '')), q.q) or lower(coalesce(c.ticker, '')) = q.q)
where rank <= {most}"""

    q["company_search"] = W() + company_search("company_queries", 10)
    q["company_search_many"] = W() + company_search("search_workload", 20)
    q["document_join"] = W(BEST) + """
select b.issuer_id, b.id as filing_id, b.primary_doc_url, d.html is not null as has_document, cast(length(d.html) as bigint) as html_chars,
  sha256(d.html) as html_sha256
from best b left join raw_documents d on d.url = b.primary_doc_url"""
    q["fetch_worklist"] = W(BEST) + """
select url, substring(sha256(url), 1, 24) as cache_key from (
  select distinct primary_doc_url as url from best where not is_parsed and primary_doc_url is not null) u
where not exists (select 1 from raw_documents d where d.url = u.url)"""

    # Candidates
    q["candidate_dedup"] = W(CANDIDATES) + f"select {cand_cols} from dd"
    q["issuer_match"] = W(CANDIDATES) + "select source_rank, ord, company_name, ticker, issuer_id, match_kind from matched"
    wildcard = CANDIDATES[:CANDIDATES.index("bn as (")].replace("fx_candidates", "wildcard_candidates")
    q["issuer_match_patterns"] = W(wildcard + """bn as (
  select p.source_rank as _r, p.ord as _o, min(i.id) as _nid from prep p
  join fx_issuers i on lower(i.company_name) like lower(p.company_name) group by all)""") + """
select p.source_rank, p.ord, p.company_name, p.ticker, coalesce(_tid, _nid) as issuer_id,
  case when _tid is not null then 'ticker' when _nid is not null then 'name' end as match_kind
from prep p left join bt on p.ticker = bt._t left join bn on bn._r = p.source_rank and bn._o = p.ord"""
    q["issuer_upsert"] = W(CANDIDATES) + "select * from new_issuers"
    q["discover_from_calendars"] = W(NASDAQ, NYSE, f"cal as (select {cand_cols} from nasdaq_c union all select {cand_cols} from nyse_c)",
                                     candidates_block("cal")) + "select * from new_issuers"
    q["discover_stats"] = W(CANDIDATES) + """
select count(*) as total_fetched, count(*) filter (where action = 'inserted') as inserted,
  count(*) filter (where action = 'updated') as updated, count(*) filter (where action = 'skipped') as skipped
from acts"""

    # Filings
    q["best_filing"] = W(BEST) + "select issuer_id, id as filing_id, form_type, filing_date, primary_doc_url from best"
    q["filing_sync"] = W(SYNC) + "select * from new_rows"
    q["filing_sync_incremental"] = W(SYNC) + """
select issuer_id, accession_no, form_type, filing_date, primary_doc_url, filing_index_url, is_parsed from new_rows"""
    q["status_transition"] = W(SYNC) + """
select issuer_id, old_status, new_status, old_status is distinct from new_status as changed from trans"""
    q["status_transition_incremental"] = q["status_transition"]
    q["sync_failures"] = W(SYNC) + f"""
select issuer_id, cik10, case when cik10 is null then 'invalid_cik' else 'no_document' end as reason from keyed k
where k.cik10 is null or k.cik10 not in (select distinct {normalize_cik('cik')} from sec_filing_rows)
union all
select distinct k.issuer_id, k.cik10, 'unreadable_document' from keyed k
join (select {normalize_cik('cik')} as cik10 from unread) u on u.cik10 = k.cik10"""
    q["sync_failures_incremental"] = W(SYNC) + f"""
select k.issuer_id, k.cik10, u.page, 'unreadable_document' as reason from keyed k
join (select {normalize_cik('cik')} as cik10, page from unread) u on u.cik10 = k.cik10"""
    q["sync_quarantine"] = W(SYNC) + f"""
select 'submissions' as source, {normalize_cik('cik')} || '/' || cast(page as varchar) as document, 'unreadable_document' as reason from unread"""
    q["calendar_quarantine"] = W() + """
select distinct 'nasdaq' as source, month || '/' || cast(page as varchar) as document, 'unreadable_document' as reason
from nasdaq_rows where (cast(substring(month, 6, 2) as integer) + page * 3) % 5 = 1
union all
select distinct 'nyse', cast(page as varchar), 'unreadable_document' from nyse_rows where page % 3 = 1"""
    q["sync_stats"] = W(SYNC) + f"""
select (select count(*) from fx_issuers where cik is not null) as issuer_count,
  (select count(*) from new_rows) as filings_inserted,
  (select count(*) from valid) - (select count(*) from new_rows) as filings_skipped,
  (select count(*) from keyed k where k.cik10 is null
     or k.cik10 not in (select distinct {normalize_cik('cik')} from sec_filing_rows)
     or k.cik10 in (select {normalize_cik('cik')} from unread)) as filings_failed"""

    # Parse jobs
    q["parse_worklist"] = W(worklist(False, None)) + """
select issuer_id, filing_id, form_type, filing_date, primary_doc_url, doc_chars, outcome, reason from work"""
    q["run_stats"] = W(worklist(False, None)) + """
select count(*) as issuer_count, count(*) filter (where outcome = 'parse') as parsed,
  count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'failed') as failed
from work"""
    q["derived_measures"] = W(offering_fields_ctes()) + """
select issuer_id, filing_id, shares_offered_total, gross_proceeds, float_ratio from fields2"""
    from floatline.operators.upserts import (CAP_COLS, CAP_SET, LOCKUP_COLS, LOCKUP_SET,
                                             OFFERING_COLS, OFFERING_SET)
    fresh_off = """fresh_off as (select f.issuer_id, f.filing_id, f.form_type as source_form_type, f.offer_price,
    f.price_range_low, f.price_range_high, f.shares_offered_total, f.shares_primary, f.shares_secondary,
    f.greenshoe_shares, f.gross_proceeds, f.bookrunners, i.exchange
  from fields2 f left join fx_issuers i on i.id = f.issuer_id)"""
    q["offering_upsert"] = W(offering_fields_ctes(), fresh_off) + upsert_sql(
        "fx_offerings", "fresh_off", OFFERING_COLS, OFFERING_SET, keep_nulls=False)
    fresh_cap = """fresh_cap as (select issuer_id, filing_id, shares_outstanding_post_ipo, shares_outstanding_pre_ipo,
    fully_diluted_shares, shares_offered_total as free_float_at_ipo, float_ratio from fields2)"""
    q["capitalization_upsert"] = W(offering_fields_ctes(), fresh_cap) + upsert_sql(
        "fx_capitalization", "fresh_cap", CAP_COLS, CAP_SET, keep_nulls=False)
    q["mark_parsed"] = W(worklist(False, None)) + """
select f.id, f.is_parsed or exists (select 1 from work w where w.outcome = 'parse' and w.filing_id = f.id) as is_parsed
from fx_filings f"""
    fresh_lk = """fresh_lk as (select * from lfields2 n where not exists (select 1 from fx_lockups s
    where s.issuer_id = n.issuer_id and s.filing_id = n.filing_id))"""
    q["lockup_upsert"] = W(lockup_fields_ctes(), fresh_lk) + upsert_sql(
        "fx_lockups", "fresh_lk", LOCKUP_COLS, LOCKUP_SET, keep_nulls=True)
    q["lockup_upsert_force"] = W(lockup_fields_ctes(force=True)) + upsert_sql(
        "fx_lockups", "lfields2", LOCKUP_COLS, LOCKUP_SET, keep_nulls=True)
    q["lockup_run_stats"] = W(worklist(False, "fx_lockups")) + """
select count(*) as issuer_count, count(*) filter (where outcome = 'parse') as parsed,
  count(*) filter (where outcome = 'skipped') as skipped, count(*) filter (where outcome = 'failed') as failed
from work"""
    q["lockup_dates"] = W(lockup_fields_ctes()) + """
select issuer_id, filing_id, lockup_days, lockup_start_date, lockup_end_date from lfields2"""

    q["constraint_violations"] = W() + _constraints_sql()

    # Reports
    def upcoming_ipos(off: str) -> str:
        return f"""
select i.company_name, i.cik, i.ticker, i.exchange, i.status as filing_status, o.price_range_low, o.price_range_high,
  o.offer_price, o.pricing_date, o.expected_trade_date, o.shares_offered_total, o.shares_primary, o.shares_secondary,
  o.greenshoe_shares, o.bookrunners, f.primary_doc_url as latest_prospectus_url
from fx_issuers i
join {top1('fx_filings', 'issuer_id', 'filing_date desc, id', f"filing_date >= cast({AS_OF_SQL} - {R.UPCOMING_IPO_FILING_LOOKBACK_DAYS} as date)")} f
  on f.issuer_id = i.id
left join {latest(off)} o on o.issuer_id = i.id
where i.status in {inlist(R.UPCOMING_STATUSES)}"""

    def upcoming_unlocks(lk: str) -> str:
        return f"""
select i.company_name, i.ticker, o.offer_price, o.expected_trade_date as trade_date, l.lockup_days,
  l.lockup_end_date, l.is_staged_unlock, l.unlock_notes, l.unlock_shares_estimate,
  f.primary_doc_url as source_filing_url
from {lk} l join fx_issuers i on i.id = l.issuer_id
left join {latest('fx_offerings')} o on o.issuer_id = l.issuer_id
left join fx_filings f on f.id = l.filing_id
where l.lockup_end_date between {AS_OF_SQL} and cast({AS_OF_SQL} + {R.UPCOMING_UNLOCK_LOOKAHEAD_DAYS} as date)"""

    q["upcoming_ipos"] = W() + upcoming_ipos("fx_offerings")
    q["recent_ipos"] = W() + f"""
select i.company_name, i.ticker, i.exchange, o.offer_price, o.pricing_date, o.expected_trade_date as trade_date,
  o.shares_offered_total, c.shares_outstanding_post_ipo, c.free_float_at_ipo, c.float_ratio,
  l.lockup_days, l.lockup_end_date
from fx_offerings o join fx_issuers i on i.id = o.issuer_id
left join {latest('fx_capitalization')} c on c.issuer_id = o.issuer_id
left join {latest('fx_lockups')} l on l.issuer_id = o.issuer_id
where o.offer_price is not null and o.pricing_date >= cast({AS_OF_SQL} - {R.RECENT_IPO_PRICING_LOOKBACK_DAYS} as date)"""
    q["report_csv"] = W() + """select company_name || ', "the" Inc.' as company_name, * exclude (company_name) from (""" + q["recent_ipos"][len(W()):] + ")"
    q["upcoming_unlocks"] = W() + upcoming_unlocks("fx_lockups")
    q["report_counts"] = W() + "select 'upcoming_ipos.csv' as report, count(*) as rows from (" + upcoming_ipos("fx_offerings") + """)
union all select 'recent_ipos.csv', count(*) from (""" + q["recent_ipos"][len(W()):] + """)
union all select 'upcoming_unlocks.csv', count(*) from (""" + upcoming_unlocks("fx_lockups") + ")"
    q["issuer_state_merged"] = W(BEST, f"""forms as (
  select issuer_id, bool_or(form_type = 'RW') as rw, bool_or(form_type in {inlist(FILING_FORMS)}) as filed
  from fx_filings group by issuer_id),
lf as (select issuer_id, id from (select *, row_number() over (partition by issuer_id order by filing_date desc nulls last, id) as _n
  from fx_filings) where _n = 1),
lo as (select * from {latest('fx_offerings')} _l)""") + """
select f.issuer_id, case when i.id is null then null when rw then 'withdrawn'
    when i.status in ('priced', 'trading') then i.status
    when filed and coalesce(i.status, 'candidate') <> 'withdrawn' then 'filed' else coalesce(i.status, 'candidate') end as new_status,
  b.id as best_id, b.form_type as best_form, b.filing_date as best_date, lf.id as latest_filing_id,
  lo.id as latest_offering_id, lo.offer_price as latest_offer_price
from forms f left join fx_issuers i on i.id = f.issuer_id left join best b on b.issuer_id = f.issuer_id
left join lf on lf.issuer_id = f.issuer_id left join lo on lo.issuer_id = f.issuer_id"""
    q["latest_per_issuer"] = W() + f"select issuer_id, id as offering_id, parsed_at, offer_price from {latest('fx_offerings')}"
    q["daily_unlocks"] = W(lockup_fields_ctes(), fresh_lk, "new_lockups as (" + upsert_sql(
        "fx_lockups", "fresh_lk", LOCKUP_COLS, LOCKUP_SET, keep_nulls=True) + ")") + upcoming_unlocks("new_lockups")
    q["daily_shared_unlocks"] = q["daily_unlocks"]
    q["daily_upcoming_ipos"] = W(offering_fields_ctes(), fresh_off, "new_offerings as (" + upsert_sql(
        "fx_offerings", "fresh_off", OFFERING_COLS, OFFERING_SET, keep_nulls=False) + ")") + upcoming_ipos("new_offerings")
    return q


def _constraints_sql() -> str:
    from floatline.operators.constraints import CONFIDENCES
    from floatline.operators.filings import STATUSES

    def rows(t, check, where):
        return f"select '{t}' as table_name, '{check}' as check_name, cast(id as bigint) as row_id from {t} where {where}"

    def dup(t, key, check):
        k = ", ".join(key)
        nn = " and ".join(f"{c} is not null" for c in key)
        return rows(t, check, f"{nn} and ({k}) in (select ({k}) from {t} where {nn} group by {k} having count(*) > 1)")

    def orphan(t, col, parent):
        return rows(t, f"fk_{'issuer' if parent == 'bad_issuers' else 'filing'}",
                    f"{col} is not null and {col} not in (select id from {parent})")

    def nulls(t, cols):
        return [rows(t, f"not_null_{c}", f"{c} is null") for c in cols]

    def enum(t, col, values):
        return rows(t, f"enum_{col}", f"{col} is not null and {col} not in {inlist(values)}")

    parts = [dup("bad_issuers", ["id"], "primary_key"), dup("bad_issuers", ["cik"], "unique_cik"),
             *nulls("bad_issuers", ["company_name"]), enum("bad_issuers", "status", STATUSES),
             dup("bad_filings", ["id"], "primary_key"),
             dup("bad_filings", ["issuer_id", "accession_no", "form_type"], "unique_filing"),
             orphan("bad_filings", "issuer_id", "bad_issuers"),
             *nulls("bad_filings", ["issuer_id", "accession_no", "form_type", "filing_date"]),
             enum("bad_filings", "form_type", TARGET_FORMS)]
    for t in ["bad_offerings", "bad_capitalization", "bad_lockups"]:
        parts += [dup(t, ["id"], "primary_key"), orphan(t, "issuer_id", "bad_issuers"),
                  orphan(t, "filing_id", "bad_filings"), *nulls(t, ["issuer_id"])]
    parts.append(enum("bad_lockups", "confidence", CONFIDENCES))
    names = {"bad_issuers": "issuers", "bad_filings": "filings", "bad_offerings": "offerings",
             "bad_capitalization": "capitalization", "bad_lockups": "lockups"}
    body = "\nunion all\n".join(parts)
    for k, v in names.items():
        body = body.replace(f"select '{k}' as table_name", f"select '{v}' as table_name")
    return body


ORACLE = _build()
