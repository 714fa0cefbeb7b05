import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from newsloom.llm.license_scan import BASE, SIGNATURES, Scanner, license_scan

SCANNER = Scanner()
PIECES = st.sampled_from(["under", "the", "MIT", "License", "license", "Apache", "version", "2", "cc", "by", "NC", "4.0", "é", "-", "\n", "©", " ", ",", "CC-BY-NC", "licensed"])


def brute(text):
    """Base columns straight from the contract."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25).map(" ".join))
def test_base_columns_match_brute_force(text):
    got = SCANNER.scan(text.encode())
    assert got[:5] == brute(text)
    assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))
    assert 0 <= got[6] <= 1


def test_containment_and_priority():
    labels = lambda t: SCANNER.scan(t.encode())[5]
    assert len(SCANNER.rules) > 200
    assert labels("GNU Lesser General Public License, version 3") == "lgpl-3.0"
    assert labels("GNU General Public License") == "gpl"
    assert labels("licensed under the Mozilla Public License 2.0") == "mpl-2.0"
    assert labels("SPDX-License-Identifier: BSD-3-Clause") == "bsd-3-clause"
    assert labels("mit dem Zug, cc an alle") == ""
    for rule in SCANNER.rules:  # the gate never hides a rule from what it matches
        assert rule.keywords


def test_rows(spark):
    text = "filler " * 200_000 + "Under the MIT license."
    docs = spark.createDataFrame([Row(doc_id=1, text=text, labels=1), Row(doc_id=1, text=text, labels=2), Row(doc_id=2, text=None, labels=0), Row(doc_id=None, text="", labels=0)], "doc_id long, text string, labels int")
    got = sorted(license_scan(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    assert [(r.n_words, r.n_base, r.first_word, r.labels, r.score) for r in got] == [(0, 0, None, "", 0.0), (200004, 1, 200000, "mit", 0.95), (200004, 1, 200000, "mit", 0.95), (0, 0, None, "", 0.0)]
    assert license_scan(docs.limit(0)).count() == 0


def brute_labels(text):
    """All rules over all texts, each detection against all that were accepted before."""
    joined = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))) + " "
    joined = joined.encode().decode("latin-1")
    found = sorted((r.priority, m.start(), -m.end(), i) for i, r in enumerate(SCANNER.rules) for m in r.pattern.finditer(joined))
    taken = []
    for _, start, end, i in found:
        if not any(a <= start and -end <= b for a, b, _ in taken):
            taken.append((start, -end, SCANNER.rules[i].label))
    return {x[2] for x in taken} | set(filter(None, brute(text)[4].split(",")))


RULE_WORDS = sorted({w for r in SCANNER.rules for w in r.pattern.pattern.split() if re.fullmatch("[a-z0-9]+", w)})


def wording(pattern):
    """One text that a signature stands for."""
    pattern = pattern.replace("(?:[^ ]+ ){1,12}?", "acme ").replace("[0-9]+", "7")
    return re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", pattern).replace("?", "")


TEXTS = [wording(t) for _, t in SIGNATURES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(RULE_WORDS), st.sampled_from(TEXTS), st.sampled_from(["GNU General Public License version 3", "Apache License 2.0", "CC BY-SA 4.0", "creative commons attribution 4.0", "gnu lesser general public license"]), PIECES), max_size=30).map(" ".join))
def test_labels_match_a_scan_of_all_rules(text):
    assert set(filter(None, SCANNER.scan(text.encode())[5].split(","))) == brute_labels(text)


def test_signatures_are_found():
    for (label, _), text in zip(SIGNATURES, TEXTS, strict=True):
        assert brute_labels(text), (label, text)
    labels = lambda t: SCANNER.scan(t.encode())[5]
    assert labels("OpenRAIL license") == labels("OpenRAIL-M license") == "openrail"
    assert labels("Tous droits réservés.") == "all-rights-reserved"
    assert labels("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.") == "apache-2,apache-2.0"


def test_overlaps_and_many_detections():
    begin = time.time()
    n_words, *_, labels, _ = SCANNER.scan(b"All rights reserved. " * 100_000)
    assert (n_words, labels) == (300_000, "all-rights-reserved") and time.time() - begin < 10
    assert SCANNER.scan(b"gnu general public license gnu general public license version 2")[5] == "gpl,gpl-2.0"


def matching(tree, draw):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += "x"
        elif name == "IN":
            kind, value = arg[0]
            out += "x" if str(kind) == "NEGATE" else chr(draw.randint(*value)) if str(kind) == "RANGE" else chr(draw.choice([v for _, v in arg]))
        elif name == "SUBPATTERN":
            out += matching(arg[-1], draw)
        elif name == "BRANCH":
            out += matching(draw.choice(arg[1]), draw)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            out += "".join(matching(inner, draw) for _ in range(draw.randint(low, min(int(high), low + 1))))
        else:
            assert name == "ASSERT", name  # the spaces around
    return out


def test_no_gate_hides_a_rule():
    import random

    draw = random.Random(1)
    for r in SCANNER.rules:
        tree = re._parser.parse(r.pattern.pattern)
        for _ in range(12):
            text = matching(tree, draw)
            assert r.pattern.search(f" {text} ") and r.keywords <= set(text.encode("latin-1").split()), (r.pattern.pattern, text)
    assert SCANNER.scan(b"CockroachDB community license")[5] == SCANNER.scan(b"cockroach community license")[5] == "cockroach"
