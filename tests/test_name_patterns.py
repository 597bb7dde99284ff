"""Wildcard names (D3) against a plain LIKE over all pairs."""

import random
import re

from pyspark.sql import functions as F

from floatline.operators import candidates as C
from floatline.operators.name_patterns import least_match


def like(name: str, pattern: str) -> bool:
    spelled = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in re.sub("%+", "%", pattern))
    return re.fullmatch(spelled, name, re.S) is not None


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    names = [(i, word(rng.randint(0, 9), "ab c%_!\\")) for i in range(300)] + [(300, None), (301, "ab\ncd"), (302, "x" * 5000), (303, "zürich 株式")]
    patterns = [word(rng.randint(0, 7), "ab %_!\\") for _ in range(300)]
    patterns += ["", "%", "_", "%%", "_%_", "____", "%x", "x%", "%_株%", "z_rich%", "ab_cd", "\\%", "!_", None, "_" * 5000, "%" + "_" * 5001, "nowhere%", "\x02%"]
    got = {r["_p"]: r["_id"] for r in least_match(spark.createDataFrame([(p,) for p in patterns + patterns[:50]], "_p string"),
                                                  spark.createDataFrame(names, "_id long, _name string")).collect()}
    want = {}
    for p in {p for p in patterns if p is not None}:
        hit = [i for i, n in names if n is not None and like(n, p)]
        if hit:
            want[p] = min(hit)
    assert got == want and len(want) > 80


def test_a_gram_of_all_names(spark):
    names = spark.range(20000).select(F.col("id").alias("_id"), F.concat(F.lit("holding "), F.col("id").cast("string")).alias("_name"))
    asked = spark.createDataFrame([("hol%",), ("%ing 1999_",), ("%g%",), ("hol%9999",)], "_p string")
    assert {r["_p"]: r["_id"] for r in least_match(asked, names).collect()} == {"hol%": 0, "%ing 1999_": 19990, "%g%": 0, "hol%9999": 9999}


def test_no_nested_loop(spark):
    df = least_match(spark.createDataFrame([("a%",)], "_p string"), spark.createDataFrame([(1, "ab")], "_id long, _name string"))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_match_issuers(spark):
    issuers = spark.createDataFrame([(1, "Acme Corp", "ACM"), (2, "Acme Holdings", "ACH"), (3, "100% Foods", None), (4, None, None), (5, "acme corp", "X")],
                                    "id long, company_name string, ticker string")
    rows = [(0, 1, "ACME%", None), (0, 2, "acme h_ldings", "NONE"), (0, 3, "acme%", "ACH"), (0, 4, "100% foods", None),
            (0, 5, "100_ foods", None), (0, 6, "zz%", None), (0, 7, "Acme Corp", None), (0, 8, None, None)]
    cands = spark.createDataFrame([(*r, None, None) for r in rows], "source_rank int, ord long, company_name string, ticker string, exchange string, source_url string")
    got = lambda **k: {r["ord"]: (r["issuer_id"], r["match_kind"]) for r in C.match_issuers(cands, issuers, **k).collect()}
    none = (None, None)
    assert got(patterns=True) == {1: (1, "name"), 2: (2, "name"), 3: (2, "ticker"), 4: (3, "name"), 5: (3, "name"), 6: none, 7: (1, "name"), 8: none}
    assert got() == {1: none, 2: none, 3: (2, "ticker"), 4: (3, "name"), 5: none, 6: none, 7: (1, "name"), 8: none}


def test_empty_tables(spark):
    nothing, one = spark.createDataFrame([], "_p string"), spark.createDataFrame([], "_id long, _name string")
    assert least_match(nothing, one).count() == 0
    assert least_match(spark.createDataFrame([("%",), ("a%",)], "_p string"), one).count() == 0


def test_names_do_not_go_through_the_driver(spark):
    from floatline.operators.candidates import match_issuers
    issuers = spark.sql("SELECT id, concat('Name ', id) company_name, concat('T', id) ticker FROM range(30)")
    cands = spark.sql("SELECT 0 source_rank, id ord, concat('%e ', id) company_name, string(null) ticker, 'X' exchange, 'u' source_url FROM range(30)")
    m = match_issuers(cands, issuers, patterns=True)
    assert "Broadcast" not in m._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ord, r.issuer_id) for r in m.collect()) == [(i, i) for i in range(30)]


def test_anchored_patterns_do_not_ask_like(spark, monkeypatch):
    """Thousands of patterns, each with a gram that many names hold: LIKE is not asked name by name."""
    from floatline.operators import name_patterns
    real = name_patterns.like
    monkeypatch.setattr(name_patterns, "like", lambda name, pattern: F.when(pattern.contains("%"), F.raise_error(F.lit("asked")).cast("boolean")).otherwise(real(name, pattern)))
    names = spark.sql("SELECT id _id, concat('Customer#', lpad(id, 6, '0')) _name FROM range(4000)")
    asked = spark.sql("""SELECT explode(array(concat('%', lpad(id, 6, '0')), concat('Customer#', lpad(id, 6, '0'), '%'), concat('Customer#', replace(lpad(id, 6, '0'), '0', '_')),
                         concat('Cust%', lpad(id % 1000, 3, '0')), concat('Customer#', lpad(id % 100, 5, '0'), '_'), concat('Customer#', lpad(id, 6, '0'), '%0'))) _p FROM range(4000)""")
    got = {r["_p"]: r["_id"] for r in least_match(asked, names).collect()}
    all_names = {f"Customer#{i:06d}": i for i in range(4000)}
    assert all(got[f"%{i:06d}"] == got[f"Customer#{i:06d}%"] == i for i in range(4000))
    assert all(got[f"Cust%{i:03d}"] == i for i in range(1000)) and all(got[f"Customer#{i:05d}_"] == 10 * i for i in range(100))
    rng = random.Random(6)
    for i in rng.sample(range(4000), 40):
        p = f"Customer#{i:06d}".replace("0", "_")
        assert got[p] == min(v for k, v in all_names.items() if like(k, p))
    assert len(got) == 4000 * 3 + 1000 + 100
