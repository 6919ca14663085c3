"""The whole retrieval against a plain Python computation on a small corpus."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

from strataloom.operators import retrieval as T


def _plain(questions, fields, container, edges, sizes, budget):
    tf = defaultdict(Counter)
    for doc, field, text in fields:
        tf[doc, field].update(T.stem_word(w) for w in text.split())
    docs = {d for d, _, _ in fields}
    length = {k: sum(c.values()) for k, c in tf.items()}
    mean = {f: max(1.0, sum(n for (_, g), n in length.items() if g == f) / len(docs)) for _, f, _ in fields}
    wtf = defaultdict(float)
    for (doc, f), c in tf.items():
        b = T.FIELD_NORM[f]
        for term, n in c.items():
            wtf[term, doc] += T.FIELD_WEIGHTS[f] * n / (1 - b + b * length[doc, f] / mean[f])
    df = Counter(term for term, _ in wtf)
    out = {}
    for q, text in questions:
        terms = list(dict.fromkeys(T.stem_word(w) for w in text.split()))
        hit = [t for t in terms if t in df]
        score = defaultdict(float)
        matched = Counter()
        for t in hit:
            idf = math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
            for doc in docs:
                if (t, doc) in wtf:
                    w = wtf[t, doc]
                    score[doc] += idf * w * (T.K1 + 1) / (w + T.K1)
                    matched[doc] += 1
        if len(hit) > 1:
            score = {d: s * (0.5 + 0.5 * matched[d] / len(hit)) for d, s in score.items()}
        near = defaultdict(list)
        for a, b in sorted(set(edges)):
            if a != b:
                near[a].append(b)
        lift = defaultdict(float)
        for d, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:30]:
            for o in near[d][:64]:
                lift[o] = max(lift[o], s * 0.9 / math.sqrt(min(64, len(near[d]))))
        both = {d: score.get(d, 0) + lift.get(d, 0) for d in {*score, *lift}}
        seen = Counter()
        final = []
        for d, s in sorted(both.items(), key=lambda x: (-x[1], x[0])):
            final.append((round(s * 0.95 ** seen[container[d]], 6), d))
            seen[container[d]] += 1
        final.sort(key=lambda x: (-x[0], x[1]))
        used, taken = 0, []
        for s, d in final:
            if len(taken) >= 40 or s <= 0 or s < final[0][0] * 0.06:
                break
            if used + sizes[d] > budget:
                if budget - used < 200:
                    break
                continue
            used += sizes[d]
            taken.append(d)
        out[q] = taken
    return out


def test_retrieval_equals_a_plain_computation(spark):
    rnd = random.Random(12)
    words = ["render", "scene", "graph", "parser", "token", "budget", "ledger", "camera", "window", "layout", "symbol", "import", "owner", "coverage"]
    fields = [(d, f, " ".join(rnd.choice(words) for _ in range(n))) for d in range(30) for f, n in (("name", 2), ("excerpt", 25))]
    container = {d: f"c{d % 4}" for d in range(30)}
    edges = [(d, (d * 7 + k) % 30) for d in range(30) for k in (1, 5)]
    sizes = {d: 300 + 137 * (d % 9) for d in range(30)}
    questions = [("q1", "render graph"), ("q2", "ledger"), ("q3", "camera window symbol owner")]
    got = defaultdict(list)
    df = T.retrieve(
        spark.createDataFrame(questions, "q string, text string"),
        spark.createDataFrame(fields, "doc long, field string, text string"),
        spark.createDataFrame(list(container.items()), "doc long, container string"),
        spark.createDataFrame(edges, "doc long, other long"),
        spark.createDataFrame(list(sizes.items()), "doc long, bytes long"),
        5000,
    )
    for r in df.orderBy("q", "position").collect():
        got[r.q].append(r.doc)
    assert got == _plain(questions, fields, container, edges, sizes, 5000)
    assert all(len(v) > 3 for v in got.values())
