"""Personal data against Python's own matcher."""

import hashlib
import random
import re

import pytest
from edge import ROWS, edge_docs, no_docs

from textloom.llm.pii import find_pii, pii_digest, redact
from textloom.session import table

SF = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
]


def expected(text):
    spans = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text or "") if ok(m.group())]
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return [sum(k == n for k, _, _ in spans) for n, _, _ in BASE], hashlib.sha256(said.encode()).hexdigest(), said


PARTS = [
    "a@b.co", "x.y+z@mail-1.example.com", "@", "a@b", ".", "..", "1.2.3.4", "255.255.255.256", "010.0.0.1", "1.2.3", ".5", "4111111111111111",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (274) 555-9629", "+49", "+", " ", "  ", "-", "\n", "é", "😀", "中", "7", "12", "(", ")", "_", "%",
    "378282246310005", "GB82 WEST 1234 5698 7654 32", "078-05-1120", "iban ", "credit card ", "ssn ", "version ",
]


@pytest.fixture(scope="module")
def random_docs(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choices(PARTS, k=rng.randint(0, 14)))) for k in range(1500)]
    rows.append((5000, " ".join(f"a{k}@b{k}.example.org 10.0.0.{k % 300}" for k in range(700))))
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def same(got, docs):
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append(expected(r["text"]))
    for r in got.collect():
        counts, sha, said = next(w for w in want[r["doc_id"]] if w[1] == r["base_sha256"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, r["doc_id"]
        assert r["spans"].startswith(said), r["doc_id"]


def test_base_spans(spark, random_docs):
    same(pii_digest(random_docs), random_docs)
    docs = table(spark, SF, "documents")
    same(pii_digest(docs), docs)
    same(pii_digest(edge_docs(spark)), edge_docs(spark))


def test_added_spans_need_checks_and_context(spark):
    docs = spark.createDataFrame(
        [
            (1, "pay to GB82 WEST 1234 5698 7654 32 now"), (2, "pay to GB82 WEST 1234 5698 7654 33 now"),
            (3, "my social security number is 078-05-1120"), (4, "part 078-05-1120"), (5, "amex card 378282246310005"), (6, "order 378282246310005"),
            (7, "ssn 000-05-1120"),
        ], "doc_id bigint, text string",
    )
    got = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in find_pii(docs).collect()}
    assert got == {
        1: [("iban", "GB82 WEST 1234 5698 7654 32")], 2: [], 3: [("ssn", "078-05-1120")], 4: [], 5: [("account", "378282246310005")], 6: [], 7: [],
    }


def test_redaction_replaces_all_spans(spark, random_docs):
    spans = {r["doc_id"]: (r["text"], r["spans"]) for r in find_pii(random_docs).collect()}
    for r in redact(random_docs).collect():
        text, found = spans[r["doc_id"]]
        out, at = [], 0
        joined = []
        for s in sorted((s["start"], s["end"], s["kind"]) for s in found):
            if joined and joined[-1][1] > s[0]:
                joined[-1] = (joined[-1][0], max(joined[-1][1], s[1]), joined[-1][2])
            else:
                joined.append(s)
        for s, e, k in joined:
            out.append(text[at:s] + f"[{k.upper()}]")
            at = e
        assert r["text"] == "".join(out) + text[at:]


def test_redaction_of_many_spans(spark):
    text = "é😀 a@b.cc +49 30 1234567 x 10.0.0.1@x.yz " * 5000 + "end"  # an address begins as an ip and goes on as an email
    docs = spark.createDataFrame([(1, text), (2, "a@b.cc"), (3, "x" * 4096 + "a@b.cc" + "y" * 4090)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    assert got[1] == "é😀 [EMAIL] [PHONE] x [IP] " * 5000 + "end"
    assert got[2] == "[EMAIL]"
    assert got[3] == "[EMAIL]"


def test_edges(spark):
    assert pii_digest(no_docs(spark)).count() == 0
    got = redact(edge_docs(spark))
    assert got.columns == edge_docs(spark).columns and got.count() == len(ROWS)
    assert got.where("text is null").count() == sum(t is None for _, t in ROWS)
