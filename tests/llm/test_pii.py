import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        x = int(c) * (2 if n % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and plain_luhn(digits or "0"), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), list(PATTERNS).index(kind), kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def base(text):
    return [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.@%+-_ 0123456789()é\n")), max_size=60))
def test_base_spans_are_those_of_the_plain_expressions(text):
    assert base(text) == brute(text)


def test_base_spans_of_mixtures():
    r = random.Random(4)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.256", "192.168.1.1", "1.2.3.4.5.6.7.8", "a.b@c.d", "x@y@z.com", "+1 (555) 123-4567", "+49 30 1234567", "00012.1.1.1", "é", "DE89 3704 0044 0532 0130 00", "078-05-1120", "ssn", " ", ".", "-"]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(6))
        assert base(text) == brute(text)


def test_further_kinds_need_a_checksum_or_context():
    assert [s[0] for s in pii.spans_of("IBAN DE89 3704 0044 0532 0130 00 here")] == ["iban"]
    assert pii.spans_of("IBAN DE88 3704 0044 0532 0130 00 here") == []
    assert [s[0] for s in pii.spans_of("his ssn is 123-45-6789 now")] == ["ssn"]
    assert pii.spans_of("part 123-45-6789 now") == []


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "1." * 100_000, "a" * 300_000, "a@" * 100_000, "+1(" * 100_000, "+1" + "(" * 300_000, "AA11" * 50_000, "1 " * 100_000):
        pii.spans_of(text)


def test_digest_and_redaction(spark):
    rows = [(1, "mail é a@b.com or 10.0.0.1", 5, "x"), (2, None, None, "y"), (3, "", 0, None), (None, "no data", 7, "z"), (1, "mail é a@b.com or 10.0.0.1", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    out = sorted(pii.pii_digest(df).collect(), key=str)
    joined = "email:7:14,ip:18:26"
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, out), key=str) == sorted([(1, 1, 1, 0, 0, hashlib.sha256(joined.encode()).hexdigest(), joined)] * 2 + [(k, 0, 0, 0, 0, empty, "") for k in (2, 3, None)], key=str)
    red = sorted(map(tuple, pii.redact(df).collect()), key=str)
    assert red == sorted([(1, "mail é [EMAIL] or [IP]", 22, "x")] * 2 + [rows[1], rows[2], rows[3]], key=str)
    assert pii.pii_digest(df.limit(0)).collect() == []
