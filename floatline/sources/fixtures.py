"""Listing-domain fixtures derived by plain SQL from the TPC-H-like tables.

The driver tables hold no filings, so the jobs run on views derived from
``customer`` (issuers, candidates, calendars) and ``orders`` (filings and
their prospectus text).  Each view is written once and rendered for two
dialects: Spark SQL (the views feed the jobs) and DuckDB (the views become
CTEs of the oracle).  The modulo rules below assign attributes (form types,
nulls, ties) and decide domain state: which filings already have stored
offering / capitalization / lock-up rows, which documents are not landed yet,
which customers appear in which calendar.  None exists to make a check
cheaper; every view grows with its source table and every query reads whole
views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from floatline.session import parallelism

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations"]

# Report date used by every registered query (inside the orders date range).
AS_OF = "2001-06-15"


class Dialect:
    name = "spark"

    def t(self, name: str) -> str:
        """Reference to a table or an earlier view."""
        return "{" + name + "}" if self.name == "spark" else name

    def num(self, expr: str) -> str:
        """Thousands-separated integer text."""
        if self.name == "spark":
            return f"format_number({expr}, 0)"
        return f"format('{{:,}}', cast({expr} as bigint))"

    def add_days(self, d: str, n: str) -> str:
        if self.name == "spark":
            return f"date_add({d}, {n})"
        return f"cast({d} + ({n}) as date)"

    def idiv(self, a: str, b: str) -> str:
        return f"cast(floor(({a}) / {b}) as bigint)"


class DuckDialect(Dialect):
    name = "duckdb"


SPARK = Dialect()
DUCK = DuckDialect()

NL = "chr(10)"


# Sentences of which each makes one extraction rule decide (numbered like the
# rules in functions/patterns.py); every eleventh filing's text is one of them.
RULE_SENTENCES = {
    "offer_price_0": "The offering price per share has been set at $21.75. ",
    "offer_price_1": "Price to public: $13.40. ",
    "offer_price_2": "Shares were sold at $9.25 per share. ",
    "offer_price_3": "We assume a per share price of $17.10. ",
    "price_range_0": "Estimates run from $11.00 to $13.50 per share. ",
    "price_range_1": "Bids came in between $7.50 and $8.25 each. ",
    "price_range_2": "Our price range is $30.00 - $33.00 today. ",
    "offered_0": "A block of 4,100,200 shares is offered by this prospectus. ",
    "offered_1": "The deal has a total of 5,300,100 shares in this offering. ",
    "offered_2": "This is an initial offering of 6,200,300 shares of stock. ",
    "offered_3": "Vale, Corp. is offering 2,345,678 shares of its stock. ",
    "offered_4": "The company is offering 3,456,789 shares now. ",
    "primary_2": "In all, 1,234,500 shares of our common stock are being offered by us. ",
    "secondary_0": "The selling stockholder may be offering 777,000 shares. ",
    "secondary_1": "A further 888,100 shares belong to selling stockholders named below. ",
    "secondary_2": "The selling shareholders are offering 999,200 shares. ",
    "greenshoe_0": "They may buy 410,000 additional shares from us to cover over-allotments. ",
    "greenshoe_1": "The over-allotment option is for 420,000 shares. ",
    "greenshoe_2": "Buyers could purchase up to 430,000 additional shares under the over-allotment clause. ",
    "greenshoe_3": "We granted the underwriters an option to purchase up to 440,057 shares. ",
    "post_tier1_0": "Class A and Class B common stock to be outstanding after this offering\n61,200,300 shares\n",
    "post_tier1_1": "There will be a total of 71,300,400 shares outstanding after this offering. ",
    "post_tier2_0": "Then 81,400,500 shares will be outstanding after this offering. ",
    "post_tier2_1": "Stock outstanding after this offering\n 91,500,600\n",
    "pre_0": "We had 15,600,700 shares of common stock outstanding as of June 30. ",
    "pre_1": "We had 16,700,800 shares of preferred outstanding as of June 30, prior to the closing. ",
    "pre_2": "Some 17,800,900 shares of the old class were outstanding on June 30. ",
    "diluted_0": "We count 101,900,100 shares on a fully-diluted basis. ",
    "diluted_1": "On a fully diluted basis we would have 112,000,238 shares. ",
    "diluted_2": "Total shares outstanding came to 123,100,349 in the end. ",
    "days_0": "Lock-Up Agreements. They hold for a period of 150 days following closing. ",
    "days_1": "Lock-up. They hold for 160 days from closing. ",
    "days_2": "Lockup agreements. Sales may start beginning 170 days following closing. ",
    "days_3": "Lockup terms. A 185 day restricted period applies. ",
    "days_4": "Market standoff. There is a lock-up period of 190 days here. ",
    "days_5": "Market standoff. Holders agree not to dispose of stock in any way for 195 days. ",
    "staged_0": "Lock-up. Some 20% of the shares released early. ",
    "staged_1": "Lock-up. Sales open at the beginning of each 60-day period. ",
    "staged_2": "Lock-up. The rest is released in stages. ",
    "staged_3": "Lock-up. Holders sell ratably over the year. ",
    "staged_4": "Lock-up. There is a quarterly unlock for staff. ",
    "staged_5": "Lock-up. An earnings-related release applies. ",
    "staged_6": "Lock-up. A performance-based vesting applies. ",
    "staged_7": "Lock-up. This is a multi-stage unlock. ",
    "staged_8": "Lock-up. Subject to certain exceptions, stock may be released early. ",
    "staged_9": "Lock-up. In the first 30 days none and in the next 60 days some may sell. ",
    "note_1": "Lock-up. The 200-day lock-up period ends then. ",
    "note_2": "Lock-up. Then 30% released at once. ",
    "far_days": "Lock-Up Agreements. " + "Plain words follow here. " * 260 + "They hold for 210 days after closing. ",
}
LONG_FILLER = "Risk factors are many and are set out at length on the pages that follow. "


def _literal(text: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def _rule_text(d: Dialect) -> str:
    cases = " ".join(f"when {k} then {_literal(t)}" for k, t in enumerate(RULE_SENTENCES.values()))
    return f"case {d.idiv('id', '11')} % {len(RULE_SENTENCES)} {cases} end"


# ── Views ─────────────────────────────────────────────────────────────────────

def fx_issuers(d: Dialect) -> str:
    return f"""
select c_custkey as id, c_name as company_name,
  case when c_custkey % 50 = 49 then 'pending' when c_custkey % 10 <> 0 then cast(320000 + c_custkey as string) end as cik,
  case when c_custkey % 4 <> 0 then 'T' || cast(c_custkey as string) end as ticker,
  case when c_custkey % 3 <> 0 then c_mktsegment end as exchange,
  case c_custkey % 6 when 0 then 'candidate' when 1 then 'filed' when 2 then 'priced'
    when 3 then 'trading' when 4 then 'withdrawn' end as status,
  case when c_custkey % 5 <> 0 then 'https://example.test/s/old' end as source_url,
  cast(c_nationkey as string) as country, c_custkey % 8 = 0 as is_foreign_issuer,
  date '2001-01-02' as created_at, date '2001-02-03' as updated_at
from {d.t('customer')}"""


def fx_filings(d: Dialect) -> str:
    return f"""
select o_orderkey as id, o_custkey as issuer_id,
  '0001234567-24-' || lpad(cast(o_orderkey as string), 8, '0') as accession_no,
  case when o_orderkey % 97 = 0 then 'RW'
    when o_orderpriority = '5-LOW' then '10-K'
    when o_custkey % 4 = 0 then case o_orderpriority when '1-URGENT' then '424B4'
      when '2-HIGH' then '424B1' when '3-MEDIUM' then 'S-1/A' else 'F-1' end
    when o_custkey % 4 = 1 then case o_orderpriority when '1-URGENT' then '424B1'
      when '2-HIGH' then 'S-1/A' when '3-MEDIUM' then 'F-1/A' else 'S-1' end
    when o_custkey % 4 = 2 then case o_orderpriority when '1-URGENT' then 'S-1/A'
      when '2-HIGH' then 'F-1/A' when '3-MEDIUM' then 'S-1' else 'F-1' end
    else case o_orderpriority when '1-URGENT' then 'S-1' when '2-HIGH' then 'F-1'
      else '10-K' end end as form_type,
  case when o_orderkey % 5 = 0 then cast(date_trunc('month', o_orderdate) as date)
    else cast(o_orderdate as date) end as filing_date,
  case when o_orderkey % 11 <> 0 then 'https://example.test/d/' || cast(o_orderkey as string)
    || '.htm' end as primary_doc_url,
  o_orderkey % 7 = 0 as is_parsed
from {d.t('orders')}"""


def _cover(d: Dialect) -> str:
    """Cover-page bookrunner block (prefix of the prospectus text)."""
    return f"""case id % 6
    when 0 then 'The underwriters expect to deliver the shares against payment on or about June 1, 2001.' || {NL}
      || 'MORGAN STANLEY' || {NL} || 'GOLDMAN SACHS & CO. LLC*' || {NL} || '*' || {NL}
      || 'J.P. MORGAN' || {NL} || 'Prospectus dated ' || cast(id as string) || {NL}
    when 1 then 'We will deliver the shares against payment in New York.' || {NL}
      || 'In alphabetical order' || {NL} || 'BOFA SECURITIES' || {NL} || '12' || {NL}
      || 'AB' || {NL} || '  CITIGROUP  ' || {NL} || '______' || {NL}
    else '' end"""


def _managers(d: Dialect) -> str:
    """Managers heading closing the text (the fallback block runs to the end)."""
    return f"""case id % 6
    when 2 then {NL} || 'Joint Book-Running Managers' || {NL} || 'BARCLAYS' || {NL}
      || 'UBS INVESTMENT BANK' || {NL} || '---' || {NL}
    when 3 then {NL} || 'Book Running Manager' || {NL} || 'Prospectus supplement' || {NL}
    else '' end"""


def fx_texts(d: Dialect) -> str:
    n = d.num
    return f"""
select id as filing_id, issuer_id, primary_doc_url,
  case when id % 11 = 5 then {_rule_text(d)} else {_cover(d)}
  || case id % 4
    when 0 then 'The initial public offering price per share of our common stock is $' || cast(10 + id % 40 as string) || '.50. '
    when 1 then 'Price to the public $' || cast(5 + id % 30 as string) || ' per share. '
    when 2 then 'We expect a price between $' || cast(10 + id % 9 as string) || '.00 and $' || cast(20 + id % 9 as string) || '.00. '
    else 'No price here. ' end
  || case id % 3
    when 0 then 'Acme, Inc. is offering ' || {n('1000000 + id * 37')} || ' shares of its Class A common stock and the selling stockholders identified in this prospectus are offering an aggregate of ' || {n('500000 + issuer_id * 11')} || ' shares. '
    when 1 then 'We are offering ' || {n('2000000 + id')} || ' shares. '
    else 'Nothing on the shares. ' end
  || case id % 5
    when 0 then 'The underwriters have an over-allotment option to purchase up to ' || {n('150000 + id')} || ' additional shares at the offering price. '
    when 1 then 'We have granted the underwriters an option to purchase ' || {n('330000 + id')} || ' shares of our common stock from us to cover over-allotment options. '
    else '' end
  || case id % 6
    when 0 then 'We will have ' || {n('50000000 + id * 101')} || ' shares of our common stock outstanding immediately after this offering. '
    when 1 then 'The number is based on ' || {n('14000000 + id')} || ' shares of our common stock outstanding as of December 31, 2023. '
    when 2 then 'We will have ' || {n('70000000 + id')} || ' shares of our common stock outstanding on a fully diluted basis after closing. '
    else '' end
  || case id % 7
    when 0 then 'Lock-Up Agreements. We agreed not to sell for a period of 180 days after the date of this prospectus. '
    when 1 then 'Lock-Up Agreements. Officers will not sell for 180 days after closing. Holders will not sell for 90 days after closing. '
    when 2 then 'Shares Eligible for Future Sale. Beginning 181 days after closing holders may sell. '
    when 3 then 'Lock-Up Agreements. 25% of the shares will be released in tranches. A 365-day lock-up period applies to others. '
    when 4 then 'We agreed not to sell for 5 days after closing. '
    when 5 then 'Holders wait for 90 days after closing. Underwriting. Nothing more. '
    else '' end
  || {_managers(d)} end
  || case when id % 499 = 7 then repeat('{LONG_FILLER}', 1500) else '' end as text
from {d.t('fx_filings')}"""


def fx_offerings(d: Dialect) -> str:
    a = d.add_days
    return f"""
select id, issuer_id, id as filing_id, form_type as source_form_type,
  case when id % 3 <> 0 then cast(10 + id % 40 as double) end as offer_price,
  case when id % 4 <> 0 then {a('filing_date', '1')} end as pricing_date,
  case when id % 2 = 0 then {a('filing_date', '2')} end as expected_trade_date,
  case when id % 3 = 0 then cast(10 + id % 9 as double) end as price_range_low,
  case when id % 3 = 0 then cast(20 + id % 9 as double) end as price_range_high,
  cast(1000000 + id as double) as shares_offered_total,
  cast(600000 + id as double) as shares_primary, cast(400000 as double) as shares_secondary,
  case when id % 5 = 0 then cast(150000 + id as double) end as greenshoe_shares,
  case when id % 3 <> 0 then cast(10 + id % 40 as double) * cast(1000000 + id as double) end as gross_proceeds,
  case when id % 7 <> 0 then 'BANK A; BANK B' end as bookrunners,
  cast(null as string) as exchange,
  filing_date as parsed_at
from {d.t('fx_filings')} where form_type <> '10-K' and id % 2 = 0"""


def fx_capitalization(d: Dialect) -> str:
    return f"""
select id, issuer_id, filing_id,
  case when id % 5 = 0 then cast(30000000 + id as double) end as shares_outstanding_pre_ipo,
  cast(40000000 + id as double) as shares_outstanding_post_ipo,
  shares_offered_total as free_float_at_ipo,
  shares_offered_total / cast(40000000 + id as double) as float_ratio,
  cast(null as double) as fully_diluted_shares, parsed_at
from {d.t('fx_offerings')} where id % 3 <> 1"""


def fx_lockups(d: Dialect) -> str:
    a = d.add_days
    days = "case id % 4 when 0 then 180 when 1 then 90 when 2 then 365 end"
    return f"""
select id, issuer_id, case when id % 9 <> 0 then id end as filing_id,
  {days} as lockup_days,
  filing_date as lockup_start_date,
  {a('filing_date', days)} as lockup_end_date,
  id % 8 = 0 as is_staged_unlock,
  case when id % 8 = 0 then 'note ' || cast(id as string) end as unlock_notes,
  cast(null as double) as unlock_shares_estimate,
  case when id % 4 = 3 then 'low' when id % 8 = 0 or id % 4 = 2 then 'medium' else 'high' end as confidence,
  filing_date as parsed_at
from {d.t('fx_filings')} where form_type in ('424B4', '424B1', 'S-1/A', 'F-1/A')"""


def fx_candidates(d: Dialect) -> str:
    c = d.t("customer")
    return f"""
select source_rank, ord, company_name, ticker, exchange, source_url from (
  select 0 as source_rank, c_custkey as ord, ' ' || upper(c_name) || ' ' as company_name,
    case when c_custkey % 3 <> 0 then 'T' || cast(c_custkey as string) end as ticker,
    case when c_custkey % 2 = 0 then 'Nasdaq' end as exchange,
    'https://example.test/s/a' as source_url
  from {c} where c_custkey % 2 = 0
  union all
  select 1, c_custkey, case when c_custkey % 50 = 0 then '' else c_name end,
    case when c_custkey % 3 <> 0 then 't' || cast(c_custkey as string) end,
    'NYSE', 'https://example.test/s/b'
  from {c} where c_custkey % 3 <> 2
  union all
  select 2, c_custkey, 'New ' || cast({d.idiv('c_custkey', '50')} as string), null, null, null
  from {c} where c_custkey % 25 = 0
) u"""


def wildcard_candidates(d: Dialect) -> str:
    """Candidates whose names are written with wildcards, one per customer, the
    kind of pattern by market segment; every seventh has a known ticker too."""
    return f"""
select 0 as source_rank, c_custkey as ord,
  case c_mktsegment
    when 'BUILDING' then '%' || substring(c_name, 10)
    when 'AUTOMOBILE' then upper(substring(c_name, 1, 15)) || '%'
    when 'MACHINERY' then replace(c_name, '0', '_')
    when 'HOUSEHOLD' then 'CUST%' || substring(c_name, 16) || case when c_custkey % 2 = 0 then '' else '%' end
    else case c_custkey % 6 when 0 then '%' || substring(c_name, 17) || '%' when 1 then repeat('_', 18)
      when 2 then repeat('_', c_custkey % 40) || '%' when 3 then c_name || '!_' when 4 then c_name else '_' || substring(c_name, 2, 8) || '%9' end
  end as company_name,
  case when c_custkey % 7 = 0 then 'T' || cast(c_custkey as string) end as ticker,
  'NYSE' as exchange, 'https://example.test/s/w' as source_url
from {d.t('customer')}"""


def raw_documents(d: Dialect) -> str:
    """Landed filing documents: one HTML page per filing URL (some missing),
    with its size recorded at landing so sizing work never reads the HTML."""
    return f"""
select url, html, cast(length(html) as bigint) as n_chars from (
  select primary_doc_url as url,
    '<html><head><title>t</title></head><body><p>' || text || '</p>'
      || case when filing_id % 401 = 3 then '<table>' || repeat('<td></td>', 5000) || '</table>' else '' end
      || '</body></html>' as html
  from {d.t('fx_texts')}
  where primary_doc_url is not null and filing_id % 13 <> 0) docs"""


# Calendar rows: one per customer.  Months 2001-01..2001-08, four sections.
def nasdaq_rows(d: Dialect) -> str:
    mon = f"1 + {d.idiv('c_custkey', '3')} % 8"
    return f"""
select c_custkey as row_key,
  '2001-' || lpad(cast({mon} as string), 2, '0') as month,
  {d.idiv('c_custkey', '1000')} as page,
  case c_custkey % 4 when 0 then 'priced' when 1 then 'upcoming' when 2 then 'filed' else 'withdrawn' end as section,
  case when c_custkey % 23 = 0 then null else 'D' || cast({d.idiv('c_custkey', '3')} as string) end as dealID,
  case when c_custkey % 29 = 0 then null when c_custkey % 7 = 3 then 'Newcomer ' || cast(c_custkey as string)
    else '  ' || c_name || ' ' end as companyName,
  case when c_custkey % 5 = 0 then ' ' else 'N' || cast(c_custkey as string) end as proposedTickerSymbol,
  case c_custkey % 3 when 0 then 'NASDAQ Global' when 1 then null else '' end as proposedExchange,
  lpad(cast({mon} as string), 2, '0') || '/' || lpad(cast(1 + c_custkey % 28 as string), 2, '0') || '/2001' as dateText
from {d.t('customer')}"""


def nyse_rows(d: Dialect) -> str:
    day_ms = "(11323 + c_custkey % 200) * 86400000"
    return f"""
select c_custkey as row_key, {d.idiv('c_custkey', '1000')} as page,
  case when c_custkey % 31 = 0 then null else ' ' || c_name end as issuer_nm,
  case when c_custkey % 4 = 0 then null else 'Y' || cast(c_custkey as string) || ' ' end as symbol,
  case when c_custkey % 3 = 0 then 'New York Stock Exchange' when c_custkey % 3 = 1 then '  ' end as custom_group_exchange_nm,
  case c_custkey % 5 when 0 then 'W' when 1 then 'P' when 2 then 'F' when 3 then 'E' end as deal_status_flg,
  case when c_custkey % 13 = 0 then null
    when c_custkey % 9 = 0 then '4102444800001'
    when c_custkey % 11 = 0 then '-1'
    when c_custkey % 17 = 0 then 'TBA'
    else cast({day_ms} as string) end as price_dt,
  cast({day_ms} - 3456000000 as string) as init_file_dt
from {d.t('customer')}"""


def sec_filing_rows(d: Dialect) -> str:
    """Per filing, the fields an SEC submissions document lists for it."""
    return f"""
select f.id as row_key, i.cik, {d.idiv('f.id', '4096')} as page,
  f.accession_no,
  case when f.id % 19 = 0 then '' else f.form_type end as form,
  cast(f.filing_date as string) as filingDate,
  case when f.primary_doc_url is null then '' else 'd' || cast(f.id as string) || '.htm' end as primaryDocument
from {d.t('fx_filings')} f join {d.t('fx_issuers')} i on i.id = f.issuer_id
where i.cik <> 'pending'"""


def company_rows(d: Dialect) -> str:
    """SEC company list rows (cik, name, ticker, exchange)."""
    return f"""
select c.c_custkey as row_key, {d.idiv('c.c_custkey', '1000')} as page,
  cast(320000 + c.c_custkey as string) as cik,
  c.c_name || ' ' || n.n_name || ' Holdings' as name,
  case when c.c_custkey % 6 <> 0 then 'T' || cast(c.c_custkey as string) end as ticker,
  case when c.c_custkey % 2 = 0 then 'Nasdaq' else 'NYSE' end as exchange
from {d.t('customer')} c join {d.t('nation')} n on n.n_nationkey = c.c_nationkey"""


def company_queries(d: Dialect) -> str:
    """Search workload: a name fragment and a ticker per nation."""
    return f"""
select 'q' || cast(n_nationkey as string) || 'n' as query_id, lower(n_name) as query from {d.t('nation')}
union all
select 'q' || cast(n_nationkey as string) || 't', 't' || cast(n_nationkey * 7 + 1 as string) from {d.t('nation')}"""


def search_workload(d: Dialect) -> str:
    """A query per customer (its number) and nation, and empty, one- and two-letter ones."""
    short = " union all ".join(f"select 's{k}' as query_id, '{t}' as query" for k, t in enumerate(["", "c", "1", "0 ", "ho", " "]))
    return f"""
select 'c' || cast(c_custkey as string) as query_id, cast(c_custkey as string) as query from {d.t('customer')}
union all
select 'n' || cast(n_nationkey as string), lower(n_name) || ' h' from {d.t('nation')}
union all {short}"""


# Tables with rows added that break every rule (operators/constraints.py).
def bad_issuers(d: Dialect) -> str:
    i = d.t("fx_issuers")
    return f"""
select id, company_name, cik, status from {i}
union all select id, null, cik, 'unknown' from {i} where id % 40 = 1
union all select -id, company_name, cik, status from {i} where id % 40 = 2"""


def bad_filings(d: Dialect) -> str:
    f = d.t("fx_filings")
    return f"""
select id, issuer_id, accession_no, form_type, filing_date from {f}
union all select id, -issuer_id, accession_no, form_type, null from {f} where id % 60 = 1
union all select -id, issuer_id, accession_no, form_type, filing_date from {f} where id % 60 = 2
union all select -id, null, null, null, filing_date from {f} where id % 60 = 3"""


def _bad_child(d: Dialect, view: str, extra: str = "") -> str:
    t = d.t(view)
    more = ", confidence" if extra else ""
    return f"""
select id, issuer_id, filing_id{more} from {t}
union all select id, issuer_id, -filing_id{more} from {t} where id % 30 = 0
union all select -id, null, filing_id{extra} from {t} where id % 30 = 6
union all select -id, -issuer_id, filing_id{more} from {t} where id % 30 = 12"""


def bad_offerings(d: Dialect) -> str:
    return _bad_child(d, "fx_offerings")


def bad_capitalization(d: Dialect) -> str:
    return _bad_child(d, "fx_capitalization")


def bad_lockups(d: Dialect) -> str:
    return _bad_child(d, "fx_lockups", ", 'sure'")


# Dependency order matters: each view may use those above it.
VIEWS = {
    "fx_issuers": fx_issuers,
    "fx_filings": fx_filings,
    "fx_texts": fx_texts,
    "fx_offerings": fx_offerings,
    "fx_capitalization": fx_capitalization,
    "fx_lockups": fx_lockups,
    "fx_candidates": fx_candidates,
    "wildcard_candidates": wildcard_candidates,
    "raw_documents": raw_documents,
    "nasdaq_rows": nasdaq_rows,
    "nyse_rows": nyse_rows,
    "sec_filing_rows": sec_filing_rows,
    "company_rows": company_rows,
    "company_queries": company_queries,
    "search_workload": search_workload,
    "bad_issuers": bad_issuers,
    "bad_filings": bad_filings,
    "bad_offerings": bad_offerings,
    "bad_capitalization": bad_capitalization,
    "bad_lockups": bad_lockups,
}


def duck_ctes() -> str:
    """All views as one DuckDB ``WITH`` prefix (unused CTEs cost nothing)."""
    parts = [f"{name} AS ({fn(DUCK)})" for name, fn in VIEWS.items()]
    return "WITH " + ",\n".join(parts) + "\n"


class Fixtures:
    """Lazily built Spark views over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in VIEWS:
                sql = VIEWS[name](SPARK)
                deps = {k: self.table(k) for k in _referenced(sql)}
                if name == "fx_texts":
                    # The texts are made from narrow rows of one small file:
                    # those are dealt out, so that no text has to be.
                    deps["fx_filings"] = deps["fx_filings"].repartition(2 * parallelism(self.spark), "id")
                self._frames[name] = self.spark.sql(sql, **deps)
            else:
                self._frames[name] = self.spark.read.parquet(
                    f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    __getitem__ = table


def _referenced(sql: str) -> list[str]:
    names = BASE_TABLES + list(VIEWS)
    return [n for n in names if "{" + n + "}" in sql]
