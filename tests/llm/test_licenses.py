"""Licence scans against a plain version, on hard small tables."""

import random
import re

import pytest

from tracklore.llm import licenses
from tracklore.llm.license_table import SENTENCES, rule_table, sentence_table
from tracklore.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_sentences(text, table):
    text = lower(text)
    found = list(WORD.finditer(text))
    edge = [True] * (len(found) + 1)
    for i in range(1, len(found)):
        gap = text[found[i - 1].end() : found[i].start()]
        edge[i] = bool(re.search("[\n\r\x0b\x0c<>|]", gap) or (re.search("[.;:!?]", gap) and re.search(r"[ \t\n\r\x0b\x0c]", gap)))
    w = [m[0] for m in found]
    known = {tuple(WORD.findall(lower(s))): name for name, s in table}
    most = max(map(len, known))
    out, i = [], 0
    while i < len(w):
        ends = [j for j in range(min(len(w), i + most), i, -1) if edge[i] and edge[j] and tuple(w[i:j]) in known] if edge[i] else []
        if ends:
            out.append((known[tuple(w[i : ends[0]])], i, ends[0]))
        i = ends[0] if ends else i + 1
    return len(w), out


def plain_matches(sentences, rules, gap):
    found = set()
    for licence, rule in rules:
        chain = None
        for name, a, b in [s for s in sentences if s[0] in rule]:
            step = rule.index(name)
            if chain and a - chain[2] <= gap and (step == chain[1] + 1 or step == chain[1] > 0):
                chain = (chain[0], step, b)
            else:
                chain = (a, 0, b) if step == 0 else None
            if chain and chain[1] == len(rule) - 1:
                found = {m for m in found if (m[0], m[1]) != (licence, chain[0])} | {(licence, chain[0], b, len(rule))}
    inside = lambda m: any(
        o[1] <= m[1] and m[2] <= o[2] and (o[1:3] != m[1:3] or o[3] > m[3]) for o in found
    )
    return sorted((m[1], m[2], m[0]) for m in found if not inside(m))


def comment(text, sign, width):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line += " " + w
    return "\n".join(sign + x for x in [*lines, line])


def hard_rows():
    draw = random.Random(2)
    full = lambda licence: " ".join(SENTENCES.get(s, s) for s in dict(rule_table()[::-1])[licence])
    by_name = {name: text for name, text in sentence_table()}
    rules = rule_table()
    texts = [None, "", " \n ", "one", "Released under the MIT License", "not Released under the MIT License."]
    texts += ["A title\nLicensed under the Apache License, Version 2.0.\nmore text", "<p>Released under the MIT License.</p>"]
    texts += ["Licensed under CC BY-NC 4.0. " * 3, "SPDX-License-Identifier: GPL-2.0-or-later\n", "x " * 30_000 + ".\nAll rights reserved."]
    for _, rule in rules:
        whole = " ".join(by_name[s] for s in rule)
        texts += [whole, comment(whole, draw.choice(["# ", " * ", "// ", ""]), draw.choice([30, 60, 79])), whole[: len(whole) * 2 // 3]]
        texts.append(" ".join(by_name[s] for s in reversed(rule)))
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(5)):
            parts += [by_name[s] for s in draw.choice(rules)[1] if draw.random() < 0.9]
            parts += [" ".join(draw.choice(["the", "this", "permission", "is", "é"]) for _ in range(draw.choice([3, 9, 59, 70]))) + "."]
        texts.append(draw.choice(["\n", " ", "\n\n# "]).join(parts))
    assert full("MIT")
    return [*enumerate(texts), (3, "one"), (None, "Released under the MIT License."), (None, None)]


def test_scan(spark):
    rows, table, rules = hard_rows(), sentence_table(), rule_table()
    schema = "doc_id long, text string, row int, licence string, start double"  # names the operator uses
    docs = spark.createDataFrame([(*r, 1, "l", 0.5) for r in rows], schema).repartition(3)
    for gap in (licenses.MAX_GAP, 8):
        want = []
        for i, text in rows:
            n, sentences = plain_sentences(text, table)
            want.append((i, n, sentences, plain_matches(sentences, rules, gap)))
        got = [
            (r.doc_id, r.n_words, [tuple(s) for s in r.sentences], [(m.start, m.stop, m.licence) for m in r.matches])
            for r in licenses.scan(docs, max_gap=gap).collect()
        ]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    found = {m.licence for r in licenses.scan(docs).collect() for m in r.matches}
    assert found == {licence for licence, _ in rules}
    assert licenses.scan(docs.filter("doc_id < 0")).count() == 0


def test_own_tables(spark):
    docs = spark.createDataFrame([(1, "Be kind, always!\nAsk first?\n"), (2, "ask first. be kind always")], "doc_id long, text string")
    found = licenses.scan(docs, [("kind", "be kind, always"), ("ask", "Ask first")], [("house", ["kind", "ask"])]).collect()
    assert {r.doc_id: [tuple(m) for m in r.matches] for r in found} == {1: [("house", 0, 5)], 2: []}
    with pytest.raises(ValueError):
        licenses.Sentences([("a", "one two"), ("b", "One, two.")])


def test_registered_query(spark):
    sf, table, rules = "/root/testdata/sf0.001", sentence_table(), rule_table()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in QUERIES["op2_license_scan"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        n, sentences = plain_sentences(text, table)
        matches = plain_matches(sentences, rules, licenses.MAX_GAP)
        assert (got[i].n_words, got[i].n_sentences, got[i].n_matches) == (n, len(sentences), len(matches))
        assert got[i].sentences == ",".join(f"{s}:{a}:{b}" for s, a, b in sentences)
        assert got[i].licences == ",".join(sorted({m[2] for m in matches}))
        assert got[i].spans == ",".join(f"{m[2]}:{m[0]}:{m[1]}" for m in matches)
    assert sum(r.n_matches for r in got.values()) > 0
