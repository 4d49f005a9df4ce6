import random

from pagewright.llm import licenses as L


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def want(rows):
    out = []
    for d, t in rows:
        own, found = shingles(L.words_of(t or "")), []
        for name, text in L.TEMPLATES.items():
            template = shingles(L.words_of(text))
            if len(template & own) >= 0.8 * len(template):
                found.append((str(d), name, len(template), len(template & own)))
        out += found or [(str(d), "None", 0, 0)]
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), str(r.license_id), r.n_shingles, r.n_found) for r in L.scan(df).collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == want(rows) and any(x[1] != "None" for x in want(rows))


def test_changed_templates(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        name = rng.choice(sorted(L.TEMPLATES))
        words = L.TEMPLATES[name].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "zebra"
        filler = lambda: [rng.choice(["red", "license", "free", "software", "to", "the"]) for _ in range(rng.randrange(40))]
        rows.append((k, " ".join(filler() + words + filler())))
    rows += [(100, None), (101, ""), (102, "license"), (102, "license"), (None, "Released under the MIT License."), (103, "the license " * 3000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    assert got(docs) == want(rows)
    assert L.scan(docs.limit(0)).count() == 0


def test_anchors():
    chosen = set(L.anchors())
    for text in L.TEMPLATES.values():
        own = shingles(L.words_of(text))
        assert sum(not chosen & set(s) for s in own) < L.CONTAINED * len(own)
