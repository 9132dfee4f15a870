"""Licence scans against a plain scan of every place."""

import re

from marlstone.llm import licences

SCHEMA = "doc_id long, text string, word string, row string, found string"


def scan(spark, texts, **options):
    rows = [(i, t, "w", "r", "f") for i, t in texts]
    return licences.digest(licences.scan_licences(spark.createDataFrame(rows, SCHEMA), **options)).collect()


def plain(text):
    words = re.findall(licences.WORD, (text or "").translate(str.maketrans(licences.UPPER, licences.LOWER)))
    places = [(i, label) for p, label in licences.BASE_PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    labels = {label for _, label in places}
    for t, template in enumerate(licences.TEMPLATES):
        keys = [(place, word) for n, _, place, word, key in licences.postings() if n == t and key]
        if any(all(0 <= at + p < len(words) and words[at + p] == w for p, w in keys) for at in range(-80, len(words))):
            labels.add(template.label)
    base = {label for _, label in places}
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)))


def test_places_and_labels_equal_those_of_a_plain_scan(spark):
    mit, gpl, bsd = licences.TEMPLATES[0].text, licences.TEMPLATES[6].text, licences.TEMPLATES[9].text
    texts = [
        (0, None), (1, ""), (2, "...!"), (3, "MIT license mit-LICENSE, the mit  license"), (4, "license mit"), (5, f"x {mit} y"), (6, f"{gpl}. {bsd}"),
        (6, f"{gpl}. {bsd}"), (None, "Licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY 4.0, not NC"), (9, mit.replace("granted, free", "granted, quite free")),
        (10, "Licensed under the Apache License, Version 2.0 " * 4000), (11, "Apache\tLicense, version 3"), (12, "Kernel mİt license"),
        (13, "permission hereby granted free software without restriction"), (14, "under the GNU GENERAL PUBLIC LICENSE, version 3"), (15, "w" * 200_000)]
    got = sorted(scan(spark, texts), key=lambda r: (r["doc"] is None, r["doc"] or 0))
    want = [plain(t) for _, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))]
    assert [tuple(r)[1:7] for r in got] == want
    scores = {r["doc"]: r["score"] for r in got}
    assert scores[5] == scores[10] == scores[None] == 1.0 and scores[0] == scores[4] == scores[13] == 0.0 and scores[11] == 0.5 and 0.5 <= scores[14] < 1.0
    assert scan(spark, []) == []


def test_rarest_words_lose_no_template(spark):
    """However few postings a template has in the index, what is found stays the same."""
    texts = [(i, t.text + " license public version " * i) for i, t in enumerate(licences.TEMPLATES)]
    results = [sorted(map(tuple, scan(spark, texts, rare=n))) for n in (1, 2, 50)]
    assert results[0] == results[1] == results[2] and all(t.label in r[6].split(",") for t, r in zip(licences.TEMPLATES, results[0], strict=True))


def test_plan_has_no_python(spark):
    found = licences.scan_licences(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ExistingRDD", plan)
