import hashlib
import random
import re

from brute import ODD, docs, write

from plexspark.llm import pii
from plexspark.llm.queries import op8_pii
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    """Every second digit from the right, from the last but one on, counts double, by its digit sum."""
    return sum(sum(divmod(int(d) * (2 if i % 2 else 1), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def iban(text):
    """The remainder is taken of one large number here."""
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def added(text):
    """What the method finds beside the base: IBANs and cards of 13 to 15 digits after a context word."""
    out, free = [], 0
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 15 and luhn(digits) and re.search("card|visa|master|amex|credit|debit|payment|karte|carte|tarjeta", text[max(0, m.start() - 48) : m.start()], re.I):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+))", text):
        if m.start() < free:
            continue
        ends = [e for e in range(m.end(1), m.start(), -1) if (e == len(text) or not re.match("[A-Za-z0-9]", text[e])) and iban(text[m.start() : e].replace(" ", "")) and text[e - 1] != " "]
        if ends:
            out.append(("iban", m.start(), ends[0]))
            free = ends[0]
    small = re.finditer(r"(?<![A-Za-z0-9])[a-z]{2}[0-9]{2}[a-z0-9]+(?![A-Za-z0-9])", text)
    return out + [("iban", m.start(), m.end()) for m in small if iban(m[0])]


def base(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    counts = [sum(k == x for k, _ in out) for x in ("email", "ip", "card", "phone")]
    return (*counts, hashlib.sha256(",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out).encode()).hexdigest())


TRICKY = [
    "a@b.c@d.e x@y.z_foo@bar.com @x.y a@b c@d.e. .@-.- a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.4 0001.002.3.4 00000000000000001.1.1.1 1.2.3", "1234.1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111 4111  1111 1111 1111", "+1 (736) 555-2678 +12 +1+2345678901 +49 30 1234567.. +1()()()2", "ünï 4111111111111111 é a.b@c.de",
    "5" * 70_000, "a" * 70_000, "1.1.1.1" * 5000, "@" * 1000, "+1" * 1000, "1-" * 40_000,
]


def test_query_equals_brute_force(spark):
    got = sorted((r.doc_id, *r[1:6]) for r in op8_pii(spark, SF).collect())
    assert got == sorted((r.doc_id, *base(r.text)) for r in table(spark, SF, "documents").collect())


def test_odd_texts(spark, tmp_path):
    rows = [r for r in ODD if len(r[1] or "") < 100_000] + [(100 + i, t) for i, t in enumerate(TRICKY[:6])]
    got = op8_pii(spark, write(spark, tmp_path, documents=docs(spark, rows))).collect()
    assert sorted(((r.doc_id, *r[1:6]) for r in got), key=str) == sorted(((i, *base(t)) for i, t in rows), key=str)


def test_long_runs_take_linear_time():
    for text in TRICKY[6:]:
        pii.spans(text)


def test_checks_context_and_redaction():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    text = "My bank account is GB82 WEST 1234 5698 7654 32, card 378282246310005, order 378282246310005."
    found = pii.spans(text)
    assert [(s.kind, s.base) for s in found] == [("card", False), ("iban", False)] or [(s.kind, s.base) for s in found][-1] == ("iban", False)
    assert found[-1].score > pii.spans("GB82 WEST 1234 5698 7654 32")[-1].score
    assert pii.redact("mail a@b.cd now", pii.spans("mail a@b.cd now")) == "mail [email] now"


def test_empty_table_and_clashing_column(spark):
    df = docs(spark, []).selectExpr("*", "1 AS pii", "2 AS spans")
    out = pii.find_pii(df)
    assert out.count() == 0 and "spans" in out.columns and out.columns[-1] == "pii"


def test_ibans_before_other_words():
    iban, whole = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for text in (f"{iban} AB 12", f"{iban} IS MINE", f"{iban} 2024", f"AB12 {iban} AB 12", f"TO {iban} {whole} END", f"{whole} {iban} 7", f"XX00 1111 2222 {iban}, {whole}", f"{iban} {'ABC ' * 20}"):
        found = [text[s.start : s.end] for s in pii.spans(text) if s.kind == "iban"]
        assert found == sorted((x for x in (iban, whole) if x in text), key=text.index), text
    assert not [s for s in pii.spans("DE89 3704 0044 0532 0130 01 AB 12 " + whole + "X") if s.kind == "iban"]
    pii.spans("AB12 " * 40_000), pii.spans("AB12" * 40_000)


def test_added_spans_equal_brute_force(spark, tmp_path):
    rng = random.Random(6)
    pieces = ["IBAN GB82 WEST 1234 5698 7654 32 BIC NWBKGB2L", "DE89370400440532013000 BIC COBADEFF", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", "card 378282246310005", "378282246310005", "visa: 4222 2222 2222 2", "FR14 2004 1010 0505 0001 3M02 606", "AB12 CD34", "some words", "XX00", "gb82west12345698765432", "gb82west12345698765433", "gb82 west 1234 5698 7654 32", "4111 1111 1111 1111", "a@b.cd", "mail", "+49 30 1234567"]
    rows = [(i, rng.choice(["", ". ", ", "]).join(rng.choice([" ", ", ", "\n"]) + x for x in rng.choices(pieces, k=rng.randint(1, 8)))) for i in range(300)]
    got = {r.doc_id: r.spans for r in op8_pii(spark, write(spark, tmp_path, documents=docs(spark, rows))).collect()}
    for i, t in rows:
        own = [x for x in got[i].split(",") if x]
        want = {f"{k}:{a}:{b}" for k, a, b in added(t)}
        assert want <= set(own) and {x for x in own if x.startswith("iban")} == {x for x in want if x.startswith("iban")}, t
        order = [(pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])) for x in own]
        assert order == sorted(order)


def test_scores_follow_checks_and_context():
    score = lambda t, kind: next(s.score for s in pii.spans(t) if s.kind == kind)
    assert score("pay by card 4111111111111111", "card") == 1.0 and score("4111111111111111", "card") == 0.8 and score("serial 4111111111111111", "card") == 0.6
    assert score("call +49 30 1234567", "phone") == 0.7 and score("+49 30 1234567", "phone") == 0.5 and score("write to a@b.cd", "email") == 0.9


def test_results_in_long_texts(spark, tmp_path):
    t = "é " * 100_000 + "a@b.cd " + "1" * 3000 + ", 4111 1111 1111 1111 " + "x " * 50_000 + " 10.0.0.1"
    (r,) = op8_pii(spark, write(spark, tmp_path, documents=docs(spark, [(1, t)]))).collect()
    assert tuple(r)[1:6] == base(t) and r.spans.startswith(f"email:200000:200006,ip:{len(t) - 8}:{len(t)},card:")
