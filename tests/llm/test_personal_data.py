"""Personal data: base spans against plain patterns, reliabilities and classifier on planted truth, edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import personal_data as pd_
from pairloom.llm import weak_supervision as ws


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_by_hand(text):
    """The patterns as they are stated, kind by kind."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def garbled(rng, n):
    pieces = ["a", "Z9", "@", "@b.c", "x.y@z-1.co.", ".", "%", "+", "-", " ", "\n", "é", "𝄞", "1", "22", "255.", "256.", "1.2.3.4", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "()", "00"]
    return "".join(rng.choice(pieces) for _ in range(n))


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    for i in range(3000):
        text = garbled(rng, rng.choice((3, 10, 30)))
        got = [(pd_.KINDS[k], s, e) for k, s, e, ok in pd_.base_matches(text) if ok]
        assert got == base_by_hand(text), text
        for c in pd_.candidates_of(text):
            if not c.base and c.kind >= pd_.BASE:
                assert all(c.end <= s or e <= c.start for _, s, e in got)


def test_long_texts_in_linear_time():
    began = time.time()
    for piece in ("a", "1", "1.", "1 ", "+1 ", "a@", "@a", "a.a@", "A", "Ab ", "Aa-", "John ", "at ", "a dot ", "(", "123-", "aé"):
        pd_.candidates_of(piece * (400_000 // len(piece)))
    assert time.time() - began < 60


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(1)
    n, real = 20_000, np.array([0.9, 0.8, 0.6, 0.95])
    truth = rng.random(n) < 0.3
    kinds = rng.integers(0, 2, n)
    votes = np.where(rng.random((n, 4)) < real, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((n, 4)) < 0.4] = 0
    rel = ws.Reliabilities(kinds, votes, np.ones(n), 2, 4)
    accuracy = rel.votes[:, 1, 2] / (rel.votes[:, 1, 2] + rel.votes[:, 1, 0])
    assert np.abs(accuracy - real).max() < 0.03 and np.abs(rel.kinds[:, 1] - 0.3).max() < 0.03
    found = rel.truth(kinds, votes) > 0.5
    majority = votes.sum(axis=1) > 0
    assert (found == truth).mean() > (majority == truth).mean()
    # The same from counts of patterns.
    rows, counts = np.unique(np.column_stack([kinds, votes]), axis=0, return_counts=True)
    again = ws.Reliabilities(rows[:, 0], rows[:, 1:], counts, 2, 4)
    assert np.abs(again.votes - rel.votes).max() < 1e-6


def test_logistic_model_separates():
    rng = np.random.default_rng(2)
    truth = rng.random(2000) < 0.5
    features = np.column_stack([np.where(truth, 3, 5), rng.integers(6, 60, 2000), np.zeros(2000, dtype=int)])
    w = ws.logistic(features, truth.astype(float), 64)
    assert ((ws.predicted(w, features) > 0.5) == truth).all()
    assert ws.predicted(w, np.zeros((1, 3), dtype=int))[0] < 0.5 and w[0] == 0
    assert ws.predicted(ws.logistic(np.zeros((0, 3), dtype=int), np.zeros(0), 64), features).max() < 0.2


FIRST, LAST = sorted(pd_.GIVEN_NAMES), ["Miller", "Okafor", "Lindqvist", "Tanaka", "Weber", "Moreau", "Ruiz", "Novak"]


def planted(seed, n):
    """Texts with the spans of added kinds that are truly in them."""
    rng = random.Random(seed)
    filler = lambda: " ".join(rng.choice(("the", "report", "shows", "that", "rates", "of", "growth", "were", "low")) for _ in range(rng.randrange(4, 20)))
    number = lambda a, b: str(rng.randrange(a, b))
    texts, spans = [], []
    for _ in range(n):
        text, own = "", []

        def put(before, found, behind, kind=None):
            nonlocal text
            text += filler() + " " + before
            if kind:
                own.append((kind, len(text), len(text) + len(found)))
            text += found + behind + " "

        name, local = f"{rng.choice(FIRST)} {rng.choice(LAST)}", f"({number(200, 999)}) {number(200, 999)}-{number(1000, 9999)}"
        for choice in rng.sample(range(9), 3):
            if choice == 0:
                put("please contact ", name, " soon.", "name")
            elif choice == 1:
                put("Dr. ", name, " said so.", "name")
            elif choice == 2:
                put("call me, phone ", local, " or later.", "local_phone")
            elif choice == 3:
                put("my SSN ", f"{number(100, 600)}-{number(10, 99)}-{number(1000, 9999)}", " is private.", "national_id")
            elif choice == 4:
                put("write me, email ", f"{rng.choice(LAST).lower()} at mail dot com", ".", "written_email")
            elif choice == 5:
                put("order ", f"{number(100, 999)}-{number(100, 999)}-{number(1000, 9999)}", " items were sent.")
            elif choice == 6:
                put("section ", f"{number(900, 999)}-{number(10, 99)}-{number(1000, 9999)}", " pages long.")
            elif choice == 7:
                put("the ", f"{rng.choice(FIRST)} {rng.choice(['Street', 'University', 'Bank'])}", " is old.")
            else:
                put("write to, email ", f"x.{rng.choice(LAST).lower()}@mail.com", ", ip 10.1.2.3, call +1 (743) 555-3824")
        texts.append(text), spans.append(own)
    return texts, spans


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, kind string, score int")


def test_added_spans_on_held_out_texts(spark):
    texts, _ = planted(1, 600)
    model = pd_.fit(documents(spark, texts))
    texts, spans = planted(2, 400)
    right = wrong = missed = 0
    for r in pd_.find(documents(spark, texts), model).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.base]
        assert base == base_by_hand(texts[r.doc_id])
        added, want = {(s.kind, s.start, s.end) for s in r.spans if not s.base}, set(spans[r.doc_id])
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.9, (right, wrong, missed)
    # The clean ones are left alone.
    clean = [t for t, s in zip(texts, spans, strict=True) if not s and not base_by_hand(t)]
    assert clean and sum(len(r.spans) for r in pd_.find(documents(spark, clean), model).collect()) < 0.05 * len(clean)


EDGES = [None, "", " \n", "a@b.c", "é a@b.c é", "4111 1111 1111 1111", "1.2.3.4", "+1 (743) 555-3824", "a@b.c.@x.y", "mail a@b.c, a@b.c", "x" * 20_000, "1 " * 50_000]


def test_query_columns_and_edges(spark, tmp_path):
    rows = documents(spark, EDGES).unionByName(documents(spark, EDGES[:4]).withColumn("doc_id", F.lit(None).cast("long")))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = pd_.op12_personal_data(spark, str(tmp_path)).collect()
    assert len(got) == len(EDGES) + 4
    for r in got:
        if r.doc_id is not None:
            want = base_by_hand(EDGES[r.doc_id] or "")
            told = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
            assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans == told
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in pd_.KINDS[:4]]


def test_redaction(spark):
    docs = documents(spark, EDGES)
    d = pd_.redact(docs, pd_.fit(docs))
    assert d.columns == docs.columns
    got = {r.doc_id: r for r in d.collect()}
    assert got[0].text is None and got[4].text == "é [email] é" and got[9].text == "mail [email], [email]" and got[5].text == "[card]"
    assert all(r.spans == "x" and r.kind == "y" and r.score == 1 for r in got.values())


def test_overlaps():
    c = lambda kind, s, e, base=False: pd_.Candidate(kind, s, e, base, [], [])
    found = [c(0, 0, 5, True), c(1, 3, 9, True), c(2, 20, 30), c(4, 40, 50), c(5, 45, 60), c(5, 60, 70), c(7, 80, 90)]
    got = pd_.chosen(found, np.array([0.1, 0.1, 0.9, 0.8, 0.9, 0.7, 0.4]), 0.5)
    assert [(x.kind, x.start) for x, _ in got] == [(0, 0), (1, 3), (5, 45), (5, 60)]


@pytest.mark.parametrize("texts", [[], ["nothing here"]])
def test_without_candidates(spark, texts):
    docs = documents(spark, texts)
    model = pd_.fit(docs)
    assert [r.spans for r in pd_.find(docs, model).collect()] == [[]] * len(texts)
