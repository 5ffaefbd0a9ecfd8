import random
import re

import pytest

from doccluster.llm.automaton import Rule, Scanner
from doccluster.llm.secrets import MASK, RULES, find_secrets, redact, scanner_of, text_spans

PLAIN = (
    (
        "assign",
        re.compile(
            r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        ),
        lambda m: len(m[2]) >= 6,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)
BITS = (
    "password passwd SeCret token api_key apikey api key pass ' \" : = AKIA AKI A é . - secrettoken"
    " 0123456789abcdef deadbeef01 ABCDEF0123 xyz"
).split() + [" ", "  "]


def brute_force(text):
    found = [
        (m.start(), n, m.end(), kind)
        for n, (kind, pattern, good) in enumerate(PLAIN)
        for m in pattern.finditer(text or "")
        if good(m)
    ]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def random_texts(count):
    rng = random.Random(5)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(count)]


def test_scanner_equals_regular_expressions():
    scanner = scanner_of(RULES)
    for text in random_texts(4000):
        assert text_spans(scanner, text) == brute_force(text)


def test_minimised_automaton_is_smaller_than_its_rules_product():
    assert len(Scanner((Rule("a", "ab+"), Rule("b", "cb+"))).mask) <= 9


@pytest.mark.parametrize("pattern", ["a*", "ab(?:cd)?", "é+", "a{1,2}b|[ab]{1,3}"])
def test_rules_that_cannot_be_scanned_in_one_pass_are_refused(pattern):
    with pytest.raises(ValueError):
        Scanner((Rule("x", pattern),))


def test_find_and_redact(spark):
    texts = [None, "", "x" * 200_000 + " token=abcdef1", "é password: hunter22!", "secret=abc", "plain"]
    rows = [(n, t, "clash") for n, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "token: 123456", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    found = find_secrets(docs).collect()
    expected = sorted((repr((r[0], brute_force(r[1]))) for r in rows))
    assert sorted(repr((r.doc_id, [tuple(s) for s in r.spans])) for r in found) == expected
    clean = {r.doc_id: r for r in redact(docs).collect()}
    assert redact(docs).columns == docs.columns
    assert clean[3].text == f"é {MASK}!" and clean[0].text is None and clean[5].text == "plain"
    assert clean[2].text.endswith(f" {MASK}") and clean[None].text == MASK


def test_redact_counts_characters(spark):
    docs = spark.createDataFrame([(1, "token=abcdef", 12)], "doc_id bigint, text string, n_chars bigint")
    assert redact(docs).first().n_chars == len(MASK)
    assert redact(docs.limit(0)).count() == 0 and find_secrets(docs.limit(0)).count() == 0
