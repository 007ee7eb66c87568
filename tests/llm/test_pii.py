"""op7: spans against Python's regular expressions."""
import random
import re

from llm.conftest import clash

from churnlens.llm import pii


def brute(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))))
        if 14 <= len(d) <= 19 and luhn % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


FRAGMENTS = ["a@b.c", "x.y@d-e.fr_d@e.f", "@", "a@b..c", "1.2.3.4", "256.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111",
             "4111111111111111", "4000-0000-0000-0002 ", "79927398713", "+1 (269) 555-3296", "+33 1 23 45 67 89", "+", "é😀",
             "word", " ", "\n", "-", "..", "5", "0" * 16, "+1+2", "9", "GB82 WEST 1234 5698 7654 32"]


def test_base_spans(spark):
    rng = random.Random(3)
    texts = [None, "", "a" * 3000, "a@b" + ".c" * 3000, "1 " * 5000, "9" * 20_000, "a@b.cc " * 3000] + [
        "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 25))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find_pii(df).selectExpr("doc_id", pii.span_list("pii", "s.kind_no < 4") + " AS spans").collect()
    assert [(r.doc_id, r.spans) for r in sorted(got)] == [(i, brute(t)) for i, t in enumerate(texts)]


def test_added_spans_need_checksum_or_context(spark):
    texts = ["my iban is GB82 WEST 1234 5698 7654 32.", "DE89370400440532013000 x", "DE89370400440532013001 x",
             "ssn 123-45-6789", "it is 123-45-6789 here", "social security: 000-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(df).selectExpr(
        "doc_id", "transform(filter(pii, s -> s.kind_no >= 4), s -> concat(s.kind, s.start, ':', s.end)) AS s").collect()}
    assert got == {0: ["iban11:38"], 1: ["iban0:22"], 2: [], 3: ["ssn4:15"], 4: [], 5: []}


def test_scores_move_with_context(spark):
    df = spark.createDataFrame([(0, "call +1 (269) 555-3296"), (1, "x +1 (269) 555-3296")], "doc_id long, text string")
    got = {r.doc_id: r.pii[0].score for r in pii.find_pii(df).collect()}
    assert got[0] > got[1]


def test_tricky_rows(spark, tricky):
    out = pii.find_pii(clash(tricky, "pii", "t", "row", "m", "found_email", "starts_ip"))
    assert out.count() == tricky.count() and all(r.pii == [] and r.m == "mine" for r in out.collect())
    assert pii.find_pii(tricky.limit(0)).count() == 0
