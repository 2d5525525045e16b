"""The combined automaton against regular expressions."""

import random
import re

from sparkclean.llm import secret_scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PARTS = ["token", "passwd", "secret", "api_key", "APIKEY", "Password", "=", ":", " ", '"', "'", "a", "ab1", "AKIA", "AKI", "0123456789abcdef", "deadbeef",
         "\n", "é", "😀", ".", "_", "-", "ghp_", "A" * 10, "xoxb-", "eyJ", "eyJa.", "AIza", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "z", "9" * 12]


def plain(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for k, rule in enumerate(secret_scan.RULES[3:], 3):
        found += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(rule.pattern, text) if len(m[0]) >= rule.least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def test_spans_of_random_texts():
    random.seed(11)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(20_000)]
    scanner, found = secret_scan._scanner(secret_scan.RULES), []
    for i in range(0, len(texts), 1000):
        found += scanner.scan([t.encode() for t in texts[i : i + 1000]])
    assert found == [plain(t) for t in texts]
    assert sum(map(len, found)) > 1000


def test_a_long_text_without_a_place_to_cut():
    scanner = secret_scan._scanner(secret_scan.RULES)
    text = "ab12" * 20_000
    assert scanner.scan([b"x", text.encode(), b""]) == [[], [("hex", 0, 80_000)], []]


def test_minimal_automaton():
    auto = secret_scan.compile_patterns(["(a|b)*c", "(a*b*)*c"], False)
    assert len(auto.accepts) == 3  # before c, behind c, and none


def test_table_and_masks(spark, odd_documents):
    rows = {(r.doc_id, r.text) for r in odd_documents.collect()}
    found = secret_scan.scan_secrets(odd_documents).collect()
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in found}
    assert len(found) == odd_documents.count() and got == {(k, tuple(plain(t or ""))) for k, t in rows}
    masked = secret_scan.redact_secrets(odd_documents)
    assert masked.schema == odd_documents.schema
    clean = {r.doc_id: r.text for r in masked.collect()}
    assert clean[0] is None and clean[10] == '[SECRET]" and [SECRET] x' and clean[12] == "é" * 500 + " 漢字 😀"
    assert secret_scan.masked("token=0123456789abcdef0123456789abcdef!", plain("token=0123456789abcdef0123456789abcdef!"), "#") == "#!"
    assert secret_scan.scan_secrets(spark.createDataFrame([], odd_documents.schema)).count() == 0
