"""Personal data against the plain patterns in Python, on the smallest table and on odd rows."""

import hashlib
import re

from conftest import SMALL
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from hostwatch.llm import pii, queries

EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(EMAIL, text)]
    out += [("ip", m) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(CARD, text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(PHONE, text) if 8 <= len(digits(m)) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def check(spark, texts):
    df = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, spans string, clean int").repartition(2)
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(rows) == len(texts)
    for n, t in enumerate(texts):
        want = base(t or "")
        assert rows[n].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, rows[n].spans)
        assert [rows[n][f"n_{k}"] for k in pii.BASE] == [sum(w.startswith(k + ":") for w in want) for k in pii.BASE]
        assert set(want) <= set(rows[n].spans.split(",")) or not want
    return rows


def test_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.op10_pii(spark, SMALL).collect()}
    for r in docs:
        assert rows[r.doc_id].base_sha256 == hashlib.sha256(",".join(base(r.text)).encode()).hexdigest()
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values()) > 0


def test_odd(spark):
    long = "a" * 200_000 + " 4111 1111 1111 1111 " + "1" * 100_000 + " x@y.zz " + "1-" * 50_000 + "+1 " + "(" * 50_000
    texts = [None, "", "a@b.c_d@e.f", "a@b@c.d", "x@y.", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0001.2.3.000255", "1.2.3.99999999999999999999", "4111-1111 1111-1111",
             "4111111111111111 2", "4111  1111 1111 1111", "é😀 4111111111111111 😀 a@b.cc", "+1 (017) 555-7713", "+12", "+1", "+12345678901234567", "+1+1 234 567 89",
             f"{pii.MARK}a@b.cc{pii.MARK}", "5" * 19, "a@b.cc,a@b.cc a@b.cc", long, long[::-1], "%@-.-"]
    rows = check(spark, texts)
    assert rows[12].spans.startswith("email:22:28,card:3:19")


def test_added_kinds(spark):
    texts = ["IBAN DE89370400440532013000", "iban GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "ssn 123-45-6789", "123-45-6789", "xDE89370400440532013000"]
    rows = check(spark, texts)
    assert [rows[n].spans for n in range(6)] == ["iban:5:27", "iban:5:32", "", "ssn:4:15", "", ""]
    assert rows[0].scores == [1.0]


def test_account_numbers_end_at_their_length(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 Please", "GB82WEST12345698765432 BIC ABC", "NO93 8601 1117 947 7 DE89370400440532013000 OK",
             "XX12 3456 7890 1234 DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432X", "GB83 WEST 1234 5698 7654 32 Please"]
    rows = check(spark, texts)
    assert [rows[n].spans for n in range(6)] == ["iban:5:32", "iban:0:22", "iban:0:18,iban:21:43", "iban:20:47", "", ""]


def test_empty_table_and_redaction(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, found_ip string"
    assert pii.report(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "x a@b.cc y 10.0.0.1", None, None, 5, "", ""), (2, None, "en", "s", None, "", ""), (2, "😀 4111 1111 1111 1111", "en", "s", 3, "", ""), (3, "plain", "en", "s", 99, "", "")]
    got = sorted(map(tuple, pii.redact(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, "x [EMAIL] y [IP]", None, None, 16), (2, None, "en", "s", None), (2, "😀 [CARD]", "en", "s", 8), (3, "plain", "en", "s", 99)], key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="a@.-+_% ()1234567890é\n", max_size=60), min_size=30, max_size=60))
def test_any(spark, texts):
    check(spark, texts)
