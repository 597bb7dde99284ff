"""Exact-semantics decisions and the Java pattern adaptations."""

import random
import re

import pytest
from pyspark.sql import functions as F

from floatline.functions import extract as X
from floatline.functions import patterns as P
from floatline.functions import scalars as S
from tests.conftest import one_column


def test_greedy_gap_takes_last_dollar(spark):
    assert one_column(spark, ["The offering price per share is $10 or $12 in total."], X.offer_price) == [12.0]


def test_inc_offering_takes_last_phrase_in_run(spark):
    text = ("Acme Inc. is offering 10,000 shares of its stock and Beta Inc. is offering "
            "20,000 shares of its stock.")
    assert one_column(spark, [text], X.shares_primary) == [20000.0]


def test_parse_number(spark):
    raw = ["15,276,527", "34.00", "20.2 million", "1.5 Billion", " 7 ", "", None, "n/a", "2 million billion"]
    assert one_column(spark, raw, S.parse_number) == [
        15276527.0, 34.0, 20200000.0, 1.5e9, 7.0, None, None, None, None]


def test_normalize_cik(spark):
    raw = ["320193", " 0001713445 ", "abc", "-5", "123456789012"]
    assert one_column(spark, raw, S.normalize_cik) == [
        "0000320193", "0001713445", None, "-000000005", "123456789012"]


def test_epoch_ms_bounds(spark):
    raw = ["1710460800000", "0", "-1", "4102444800001", "TBA", None, "4102444800000"]
    got = [d.isoformat() if d else None for d in one_column(spark, raw, S.epoch_ms_to_date)]
    assert got == ["2024-03-15", None, None, None, None, None, "2100-01-01"]


def test_parse_date_formats(spark):
    raw = ["2024-03-15", "March 15, 2024", "Mar 5, 2024", "15-Mar-2024", "03/15/2024", "soon"]
    got = [d.isoformat() if d else None for d in one_column(spark, raw, S.parse_date)]
    assert got == ["2024-03-15", "2024-03-15", "2024-03-05", "2024-03-15", "2024-03-15", None]


def test_filing_urls(spark):
    df = spark.createDataFrame([("0000320193", "0000320193-24-000001", "s-1.htm"),
                                ("320193", "", "s-1.htm"), ("320193", "0000320193-24-000002", None)],
                               "cik string, acc string, doc string")
    rows = df.select(S.filing_primary_doc_url("cik", "acc", "doc").alias("p"),
                     S.filing_index_url("cik", "acc").alias("i")).collect()
    base = "https://www.sec.gov/Archives/edgar/data/320193/000032019324000001/"
    assert (rows[0].p, rows[0].i) == (base + "s-1.htm", base)
    assert (rows[1].p, rows[1].i) == (None, "")
    assert rows[2].p is None and rows[2].i.endswith("000032019324000002/")


def test_whitespace_and_html(spark):
    from floatline.functions.text import html_to_text, normalize_whitespace
    assert one_column(spark, ["  a  \t b\n\nc  "], normalize_whitespace) == ["a b c"]
    html = ("<html><head><title>x</title><script>var t='</p>';</script></head><body><!-- c -->"
            "<p>Price &amp; terms</p>   <p>Line&nbsp;two</p></body></html>")
    assert one_column(spark, [html, None], html_to_text) == ["Price & terms\n\nLine two", ""]


# ── Pattern adaptations agree with Python's re on generated texts ─────────────

TOKENS = ["Acme", "Inc.", "Corp.", "LLC", "is", "offering", "of", "its", "shares", "we", "are",
          "the", "company", "1,000", "25", "180", "90", "12,345,678", ",", ".", "$", "aggregate",
          "total", "offered", "by", "this", "prospectus", "selling", "stockholders", "days",
          "after", "for", "a", "period", "not", "to", "sell", "lock-up", "180-day", "%", "\n",
          "over-allotment", "option", "purchase", "up", "additional", "cover", "outstanding",
          "immediately", "as", "fully", "diluted", "basis", "on", "price", "public", "per", "share"]


def _texts(n=300, seed=7):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(TOKENS) for _ in range(rnd.randint(5, 60))) for _ in range(n)]


def _py_first(patterns, text):
    for p in patterns:
        m = re.search(p, text, re.IGNORECASE | re.DOTALL)
        if m:
            return m.group(1).strip()
    return None


@pytest.mark.parametrize("name", ["OFFER_PRICE", "SHARES_OFFERED_TOTAL", "SHARES_PRIMARY",
                                  "SHARES_SECONDARY", "GREENSHOE", "PRE_IPO", "FULLY_DILUTED",
                                  "POST_IPO_TIER1"])
def test_first_match_equals_python_re(spark, name):
    patterns = getattr(P, name)
    texts = _texts()
    got = one_column(spark, texts, lambda c: X.first_match(c, patterns))
    assert got == [_py_first(patterns, t) for t in texts]


def test_lockup_votes_equal_python_re(spark):
    texts = _texts(seed=11)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r[0] for r in df.orderBy("i").select(X.lockup_day_votes(F.col("text"))).collect()]
    want = []
    for t in texts:
        votes = []
        for p, dotall in zip(P.LOCKUP_DAYS, P.LOCKUP_DAYS_DOTALL):
            flags = re.IGNORECASE | (re.DOTALL if dotall else 0)
            votes += [int(m.group(1)) for m in re.finditer(p, t, flags) if 30 <= int(m.group(1)) <= 730]
        want.append(votes)
    assert got == want


def test_company_search_equals_a_scan(spark):
    """Queries of every length, empty and blank ones, against a plain search."""
    from floatline.sources import sec
    rows = [("Acme Holdings", "ACM"), ("Beta Acme", "BTA"), ("Gamma", "AC"), ("Delta", None), ("ac", "Z"), (None, "ACME")]
    rows += [(f"Common name {i}", f"C{i}") for i in range(44)]
    comps = spark.createDataFrame([(i // 7, i % 7, str(100 + i), n, t, "X") for i, (n, t) in enumerate(rows)],
                                  "page long, pos long, cik string, name string, ticker string, exchange string")
    queries = [("q1", "acme"), ("q2", " AC "), ("q3", "a"), ("q4", ""), ("q5", "zz"), ("q6", "Delta"), ("q7", "name 1"),
               ("q8", "m"), ("q9", "mm"), ("q10", None), ("q11", "c12"), ("q12", "common name")]
    df = spark.createDataFrame(queries, "query_id string, query string")
    for most in (3, 20, 100):
        want = {}
        for qid, q in queries:
            q = (q or "").strip().lower()
            hits = [n for n, t in rows if q in (n or "").lower() or (t or "").lower() == q][:most]
            if hits:
                want[qid] = hits
        got = {}
        for r in sec.search_companies(comps, df, max_results=most).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["name"])
            assert r["rank"] == len(got[r["query_id"]])
        assert got == want


def test_company_search_has_no_nested_loop(spark):
    from floatline.sources import landing, sec
    from floatline.sources.fixtures import Fixtures
    from tests.conftest import SF001
    fx = Fixtures(spark, SF001)
    comps = sec.company_list_rows(landing.land_company_list(fx["company_rows"]))
    found = sec.search_companies(comps, fx["search_workload"], max_results=20)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_html_non_content_leftmost_first(spark):
    from floatline.functions.text import html_to_text
    html = ("<body><script>var c = '<!-- not a comment';</script><p>one</p>"
            "<!-- <script> not a script --><p>two</p><style>p{}</style><p>three</p></body>")
    assert one_column(spark, [html], html_to_text) == ["one\ntwo\nthree"]


def test_html_numeric_references(spark):
    from floatline.functions.text import html_to_text
    html = ("<p>offering&#160;price &#8220;IPO&#x201D; A&#X2019;s &#0; &#55296; &#38;amp; &amp;#160; "
            "&#128512;</p>")
    assert one_column(spark, [html], html_to_text) == [
        "offering price “IPO” A’s � � &amp; &#160; \U0001F600"]


def test_numbers_as_python_reads_them(spark):
    texts = ["12d", "12f", "0x1p3", "3e2", "1.5", ".5", "5.", "+7", "-2,000", "1e", "e5", "", "1.2.3", "nan", "inf"]
    def want(t):
        try:
            return float(t.replace(",", ""))
        except ValueError:
            return None
    got = one_column(spark, texts, S.parse_number)
    assert [str(g) for g in got] == [str(want(t)) for t in texts]


def test_add_days_reads_text(spark):
    from floatline.functions.scalars import add_days
    df = spark.createDataFrame([("2024-02-28", "2"), ("March 1, 2024", "-1"), ("soon", "3"), ("2024-02-28", "x"), (None, "1")], "d string, n string")
    assert [str(r[0]) for r in df.select(add_days("d", "n")).collect()] == ["2024-03-01", "2024-02-29", "None", "None", "None"]


def test_sections_are_read_one_after_the_other(spark):
    """A priced row of a later page comes before a filed row of an earlier one."""
    import json

    from floatline.sources import calendars as CAL
    page = lambda section, name: json.dumps({"data": {section: {"rows": [{"dealID": "d", "companyName": name}]}}})
    docs = spark.createDataFrame([("2001-06", 0, page("filed", "late")), ("2001-06", 1, page("priced", "first"))], "month string, page long, json string")
    [r] = CAL.nasdaq_candidates(docs, F.lit("2001-06-15").cast("date")).collect()
    assert r["company_name"] == "first"


def test_lazy_tables_resolve_everywhere(spark):
    from floatline.plans.jobs import LazyTables
    built = []
    t = LazyTables({"a": lambda: built.append("a") or spark.range(1), "b": spark.range(2)})
    assert list(t) == ["a", "b"] and not built
    assert t.get("a").count() == 1 and {k: v.count() for k, v in t.items()} == {"a": 1, "b": 2}
    assert [v.count() for v in t.values()] == [1, 2] and built == ["a"] and dict(t)["a"] is t["a"]


def test_issuer_columns_pass_through(spark):
    from floatline.operators import candidates as C
    issuers = spark.createDataFrame([(1, "Acme", None, None, None, "filed", None, "US", True, "keep")],
                                    "id long, company_name string, cik string, ticker string, exchange string, status string, "
                                    "source_url string, country string, is_foreign_issuer boolean, remark string") \
        .withColumn("updated_at", F.lit("2000-01-01").cast("date")).withColumn("created_at", F.lit("2000-01-01").cast("date"))
    cands = spark.createDataFrame([(0, 1, "ACME", "AC", None, None), (0, 2, "Other", None, None, None)],
                                  "source_rank int, ord long, company_name string, ticker string, exchange string, source_url string")
    day = F.lit("2001-06-15").cast("date")
    out, _ = C.upsert_issuers(C.match_issuers(cands, issuers), issuers, as_of=day)
    assert out.columns == issuers.columns
    old, new = out.orderBy("id").collect()
    assert (old.ticker, old.country, old.remark, str(old.updated_at), str(old.created_at)) == ("AC", "US", "keep", "2001-06-15", "2000-01-01")
    assert (new.company_name, new.country, new.is_foreign_issuer, str(new.updated_at), str(new.created_at)) == ("Other", None, False, "2001-06-15", "2001-06-15")
