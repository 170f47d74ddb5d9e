"""Added spans of personal data against plain trees and a plain selection, and hard negatives of the documents."""

import math
import random

from ledgerloom.llm import pii

DATA = "/root/testdata/sf0.01"


def plain_probability(model, x):
    """One row through the trees, node by node."""
    margin = 0.0
    for feature, threshold, left, right, value in model.trees:
        at = 0
        while feature[at] >= 0:
            at = int(left[at] if x[feature[at]] <= threshold[at] else right[at])
        margin += model.rate * float(value[at])
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, model.a * margin + model.b))))


def plain_spans(text, model, least):
    base = pii.base_spans(text)
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
    likely = []
    for c in pii.candidates(text):
        if not any(meets(c, b) for b in base):
            p = plain_probability(model, pii.features(text, *c))
            if p >= least[c[1]]:
                likely.append((c[0] - c[2], -p, *c))
    chosen = []
    for _, _, *c in sorted(likely):
        if not any(meets(c, o) for o in chosen):
            chosen.append(tuple(c))
    return sorted(base + chosen)


def test_spans_against_plain_trees(spark):
    rnd = random.Random(12)
    parts = ["call 555-123-4567", "password=ab12cd34ef56aa99", "jo.do (at) site (dot) com", "a@b.co", "+1 (234) 555-1234", "iban DE12 1234 1234 1234 1234 12", "19.5.2020", "order 12345678", "token: required", "secret=x1y2z3w4", "10.0.0.1", "978-1-2345-6789-0", "mail jo at site.org", "4111 1111 1111 1111 22", "words go on", "api_key = '0123456789abcdef0123'"]
    texts = [" ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(150)]
    model, least = pii.model()
    got = {r.doc_id: r.spans for r in pii.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: pii.joined(plain_spans(t, model, least)) for i, t in enumerate(texts)}
    assert sum(s.count("secret") + s.count("number") + s.count("address") + s.count("account") for s in got.values()) > 100


def test_hard_negatives_of_the_documents(spark):
    """Documents without any base span, of which only assigned tokens may be found; numbers of cards that fail their check are none."""
    model, least = pii.model()
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if r.text and not pii.base_spans(r.text)]
    found = [(pii.KINDS[k], t[s:e]) for t in texts for s, k, e in pii.all_spans(t, [], model, least)]
    assert len(texts) > 500 and all(kind == "secret" and len(value) == 40 for kind, value in found)
