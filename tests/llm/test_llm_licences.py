import math
import random
import re

import llm_rows
from relaylens.llm import licences as L


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def slow(text):
    w, starts, labels, best = words(text), [], set(), 0.0
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    base = sorted(labels)
    for line in (text or "").split("\n"):
        own = set(words(line))
        for label, template in L.TEMPLATES:
            t = set(template.split())
            if len(own & t) >= math.ceil(L.CONTAINMENT * len(t)):
                labels.add(label)
                best = max(best, len(own & t) / len(t))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(base), ",".join(sorted(labels)), 1.0 if starts else best)


def test_against_the_definition(spark):
    random.seed(1)
    texts = []
    for i in range(300):
        lines = []
        for _ in range(random.randint(0, 4)):
            w = random.choice(L.TEMPLATES)[1].split() + random.choice(list(L.PHRASES)).split()
            random.shuffle(w) if random.random() < 0.3 else None
            w = w[random.randint(0, 3):len(w) - random.randint(0, 6)]
            lines.append(random.choice([" ", ", ", "--"]).join(w).title())
        texts.append((i, random.choice(["\n", "\n\n", " "]).join(lines)))
    texts += [(400, "CC BY cc by; General\nPublic License"), (401, "all rights  reservedly"),
              (402, "All Rights Reserved. all rights reserved")]
    docs = llm_rows.documents(spark, texts).unionByName(llm_rows.awkward(spark))
    got = L.scanned_documents(docs)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(((r["doc_id"], *slow(r["text"])) for r in docs.collect()), key=repr)
    assert llm_rows.rows_of(got, "doc_id", *names) == want
    assert sum(bool(w[-2]) and not w[-3] for w in want) > 20
    assert L.scanned_documents(docs.limit(0)).count() == 0
