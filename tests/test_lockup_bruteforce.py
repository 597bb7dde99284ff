"""X10 mode, X11 and X12 against direct Python implementations of their
definitions on generated inputs."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from floatline.functions import extract as X
from floatline.functions import patterns as P
from tests.test_quirks import TOKENS


def test_mode_first_equals_counter(spark):
    rnd = random.Random(13)
    votes = [[rnd.choice([90, 180, 181, 360, 365]) for _ in range(rnd.randint(0, 9))] for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(votes)], "i int, v array<int>")
    got = [r[0] for r in df.orderBy("i").select(X.mode_first(F.col("v"))).collect()]
    assert got == [Counter(v).most_common(1)[0][0] if v else None for v in votes]


def _section(text):
    low = text.lower()
    for title in P.LOCKUP_SECTION_TITLES:
        i = low.find(title)
        if i != -1:
            return text[i:i + P.LOCKUP_SECTION_CHARS]
    return text


def py_staged(text):
    sec = _section(text)
    return any(re.search(p, sec, re.IGNORECASE | (re.DOTALL if d else 0))
               for p, d in zip(P.STAGED_UNLOCK, P.STAGED_UNLOCK_DOTALL))


def py_notes(text):
    sec, notes = _section(text), []
    for p in P.UNLOCK_NOTES:
        m = re.search(p, sec, re.IGNORECASE)
        if m:
            snippet = re.sub(r"\s+", " ", m.group(0).strip())
            if snippet and snippet not in notes:
                notes.append(snippet)
        if len(notes) >= P.UNLOCK_NOTES_MAX_NOTES:
            break
    return P.UNLOCK_NOTES_JOIN.join(notes)[:P.UNLOCK_NOTES_MAX_CHARS] if notes else None


def test_staged_and_notes_equal_python(spark):
    extra = ["25%", "released", "release", "in", "tranches", "pro-rata", "over", "quarterly", "vest",
             "Lock-Up", "Underwriting", "each", "beginning", "first", "next", "subject", "certain",
             "exceptions", "restricted", "lock-up period"]
    rnd = random.Random(17)
    texts = [" ".join(rnd.choice(TOKENS + extra) for _ in range(rnd.randint(5, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = X.with_lockup_fields(df, fields=["is_staged_unlock", "unlock_notes"]).orderBy("i").collect()
    assert [r.is_staged_unlock for r in rows] == [py_staged(t) for t in texts]
    assert [r.unlock_notes for r in rows] == [py_notes(t) for t in texts]


def py_bookrunners(text):
    m = re.search(P.BOOKRUNNER_BLOCK, text, re.IGNORECASE)
    if m:
        block = m.group(1)
    else:
        m2 = re.search(P.BOOKRUNNER_FALLBACK, text, re.IGNORECASE)
        if not m2:
            return None
        block = m2.group(1)
    names = []
    for line in block.splitlines():
        line = line.strip().rstrip("*").strip()
        if not line or re.match(P.BOOKRUNNER_SKIP_LINE, line, re.IGNORECASE):
            continue
        if len(line) < P.BOOKRUNNER_MIN_LEN or re.match(r"^\d", line):
            continue
        names.append(line)
    return P.BOOKRUNNER_SEPARATOR.join(names) if names else None


def test_bookrunners_equal_python(spark):
    lines = ["The underwriters expect to deliver the shares on May 1.", "deliver the shares against payment",
             "MORGAN STANLEY", "J.P. MORGAN*", "*", "12", "AB", "In alphabetical order", "____",
             "Prospectus dated May 2", "Table of Contents", "Joint Book-Running Managers", "Book Running Manager",
             "  UBS  ", "", "---", "Citigroup Global Markets Inc."]
    rnd = random.Random(23)
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 14))) + rnd.choice(["", "\n", "\n\n\n"])
             for _ in range(400)]
    got = [r.bookrunners for r in X.with_offering_fields(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"),
        fields=["bookrunners"]).orderBy("i").collect()]
    want = [py_bookrunners(t) for t in texts]
    assert got == want
    assert sum(w is not None for w in want) > 20


def test_post_ipo_equals_python(spark):
    from tests.test_scalars_property import py_parse_number

    def py_post(text):
        for p in P.POST_IPO_TIER1:
            m = re.search(p, text, re.IGNORECASE | re.DOTALL)
            if m:
                return py_parse_number(m.group(1).strip())
        vals = [v for p in P.POST_IPO_TIER2 for m in re.finditer(p, text, re.IGNORECASE)
                if (v := py_parse_number(m.group(1))) is not None]
        return max(vals) if vals else None

    words = TOKENS + ["Class A, Class B, and Class C common stock to be outstanding after this offering\n",
                      "outstanding immediately after this offering\n 7,000", "50,000,000 shares",
                      "outstanding after offering", "total of 3,000 shares", "1,2", ",,", "12 share"]
    rnd = random.Random(29)
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(5, 70))) for _ in range(400)]
    got = [r.shares_outstanding_post_ipo for r in X.with_offering_fields(
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"),
        fields=["shares_outstanding_post_ipo"]).orderBy("i").collect()]
    want = [py_post(t) for t in texts]
    assert got == want
    assert sum(w is not None for w in want) > 20
