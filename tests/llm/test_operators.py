"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import io

import numpy as np
import pytest

import corpus_pipeline
from marlstone.llm import components, decontaminate, embeddings, lines, minhash, quality, toxicity, warc

SCHEMA = "doc_id long, text string, source string, lang string, leak string, removed string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", "x", "y") for i, t, s in rows], SCHEMA)


def test_lines_keep_the_first_of_a_wide_line(spark):
    line = "Released under some license"
    rows = [(i, f"own text number {i}\n{line}", f"s{i}") for i in range(6)] + [(7, None, "s1"), (8, "", None), (9, line, "s1"), (None, line.upper(), "s2"), (10, "short\n" * 3000, "s1")]
    got = {r["doc_id"]: r["removed_"] for r in lines.mark_boilerplate(docs(spark, rows)).collect()}
    assert sum(len(v["positions"]) for v in got.values()) == 7 and got[None]["positions"] == []       # a null id is the smallest
    assert got[3]["clean_text"] == "own text number 3" and got[7]["clean_text"] is None and got[8]["clean_text"] == ""
    assert {r["doc_id"] for r in lines.drop_boilerplate(docs(spark, rows)).collect()} == {None, 0, 1, 2, 3, 4, 5, 7, 8, 10}
    assert lines.mark_boilerplate(docs(spark, [])).count() == 0


def test_short_wide_lines_go_and_blank_ones_stay(spark):
    rows = [(i, f"own text number {i}\nLog in\n\n \t\n.\nend", f"s{i}") for i in range(6)]
    got = {r["doc_id"]: r["removed_"] for r in lines.mark_boilerplate(docs(spark, rows)).collect()}
    assert got[0]["positions"] == [] and all(got[i]["positions"] == [1, 4, 5] for i in range(1, 6))
    assert got[3]["clean_text"] == "own text number 3\n\n \t"
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline._lines(spark, docs(spark, rows), "").collect()}
    assert kept[3] == "own text number 3\n\n \t" and kept[0] == rows[0][1]


def test_leaks_and_their_spans(spark):
    item = "One two, three four five SIX seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (None, "null id"), (2, "tiny item")], "item_id long, text string")
    text = "Ä start: one TWO three-four five six seven eight nine ten! eleven end"
    rows = [(0, text, "s"), (1, None, "s"), (2, "", "s"), (3, "a tiny ... item, a null id", "s"), (3, "a tiny ... item, a null id", "s"), (4, "tiny items " * 50_000, "s")]
    for shard in (1 << 20, 20):
        got = [r["leak_"] for r in decontaminate.find_leaks(docs(spark, rows), bench, shard_bytes=shard).orderBy("doc_id").collect()]
        assert [text[s["start"]:s["end"]] for s in got[0]["spans"]] == ["one TWO three-four five six seven eight nine ten! eleven"]
        assert got[0]["items"] == ["1"] and got[0]["hits"] == list(range(2, 13)) and got[1]["n_words"] == got[2]["n_words"] == 0
        assert got[3] == got[4] and got[3]["items"] == ["2"] and got[3]["hits"] == [1, 2, 4, 5] and got[5]["hits"] == []
    assert decontaminate.find_leaks(docs(spark, rows), bench.limit(0)).count() == 6 and decontaminate.find_leaks(docs(spark, []), bench).count() == 0


def test_near_duplicates_of_small_and_copied_texts(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 900, 120)]
    near = [" ".join([*base[:k], "edit", *base[k + 1:]]) for k in range(0, 120, 4)]
    rows = [(100 + i, t, "s") for i, t in enumerate(near)] + [(1, None, "s"), (2, "", "s"), (3, "a b", "s"), (4, "A  B", "s"), (5, "a b c", "s"), (None, "a b", "s"), (6, near[0], "s")]
    got = {r["doc"]: r for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert {got[100 + i]["component"] for i in range(len(near))} == {6} and got[6]["n_shingles"] == 116
    assert got[4]["component"] == 3 and got[None]["component"] == 3 and got[1]["n_shingles"] == 0 and got[2]["component"] == 2 and got[5]["n_shingles"] == 1
    kept = {r["doc_id"] for r in minhash.keep_one_of_each(docs(spark, rows)).collect()}
    assert kept == {None, 1, 2, 3, 5, 6}
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 3), (60, 50), (50, 60)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50}


@pytest.mark.parametrize("cell,block", [(8192, 8192), (10, 7)])
def test_vectors_against_all_pairs(spark, cell, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=8)).astype(float).tolist(), int(i % 2)) for i in range(90)]
    rows += [(200 + i, rows[3][1], rows[3][2]) for i in range(5)]
    odd = [(300, None, 1), (301, [0.0] * 8, 1), (302, [float("nan")] * 8, 1), (303, [None] * 8, 1), (304, rows[0][1], None), (305, [], 1)]
    got = {r["id"]: r for r in embeddings.link_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int"), cell_rows=cell, block_rows=block).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        root = {rows[i][0]: min(root[rows[j][0]] for j in np.flatnonzero(near[i])) for i in range(len(rows))}
    for i, (vec, _, _) in enumerate(rows):
        assert (got[vec]["n_links"], got[vec]["component"]) == (near[i].sum() - 1, root[vec]), vec
    assert all((got[v]["n_links"], got[v]["component"]) == (0, v) for v, _, _ in odd) and len(got) == len(rows) + len(odd)


def test_archives_round_trip_and_damage(spark):
    page = "<p>" + "long page " * 300
    rows = [(i, f"http://a/{i}\r\nX: y", page) for i in range(5)] + [(7, None, None), (8, "u", ""), (9, "u", "é" * 499), (10, "u", "é" * 499), (None, "u", page)]
    got = {r["target"].split(" ")[0]: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and [got[f"page:{i}"]["record_type"] for i in (3, 4, 9, 10)] == ["revisit", "response", "response", "response"]
    assert got["page:0"]["refers_to"].startswith("page:4 ") and got["page:0"]["payload_length"] == len(page) and got["page:null"]["record_type"] == "revisit"
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, warc.train([f"<p>{page[:90]}{i}".encode() * 20 for i in range(300)], 2048))
    data = warc.record("response", "u", b"abc", "a9993e364706816aba3e25717850c26c9cd0d89d", None, "2024-01-01T00:00:00Z")
    writer.add(data)
    writer.add(data)
    raw = out.getvalue()
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and list(warc.read_archive(io.BytesIO(raw))) == [data, data]
    for bad in (raw[:-3], raw[:9], raw[:-1] + bytes([raw[-1] ^ 1])):
        with pytest.raises(warc.DamagedRecord):
            list(warc.read_archive(io.BytesIO(bad)))
    for bad in (data[:-1], data.replace(b"abc", b"abd"), data.replace(b"WARC/1.1", b"WARC/9"), data.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(warc.DamagedRecord):
            warc.parse(bad)


def test_toxic_dictionary_learns_from_text_without_spaces():
    rng = np.random.default_rng(6)
    junk = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    toxic, ordinary = [junk(100) + b"zorkblat" + junk(100) for _ in range(60)], [junk(200) for _ in range(60)]
    part, base = toxicity.train_dictionaries(toxic, ordinary)
    assert b"zorkblat" in part and b"zorkblat" not in base


def test_toxicity_scores_all_and_learns(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"], rng.integers(1, 4)))
    rows = []
    for i in range(400):
        words = [word() for _ in range(80)]
        if i % 5 == 0:
            words[10::20] = ["stupidity"] * 4
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame([*rows, (900, None, None), (901, "", None)], "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 300"))
    got = {r["doc"]: r["score"] for r in toxicity.score(df, model).collect()}
    right = sum((got[i] >= 0.5) == bool(t) for i, _, t in rows if i >= 300)
    assert right >= 95 and got[900] == got[901] < 0.5 and len(got) == 402
    bare = toxicity.fit(df, df.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in toxicity.score(df, bare).collect()} == {0.0}


def test_quality_without_labels_and_odd_rows(spark):
    rows = [(i, "Some good words, in a line." if i % 3 else "BAD!! JUNK!! | | |", f"s{i % 2}") for i in range(60)] + [(70, None, None), (71, "", "s0"), (None, "Some good words.", "s1"), (1, "other text", "s1")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)] + [(None, 1), (41, None)], "doc_id long, quality int")
    got = quality.score_quality(docs(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(r["accepted"] == bool(r["doc"] % 3) for r in got if r["doc"] is not None and 1 < r["doc"] < 60)
    kept = {r["doc_id"] for r in quality.keep_accepted(docs(spark, rows), labels).collect()}
    assert 2 in kept and 3 not in kept
    assert quality.score_quality(docs(spark, rows), labels.limit(0)).where("accepted").count() == len(rows)
    assert quality.score_quality(docs(spark, []), labels).count() == 0


def test_pipeline_stages_chain(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line dedup", "near-dedup", "decontamination", "packing"]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < got.select("doc_id").distinct().count() < docs.count()


CLASHING = "doc_id long, text string, source string, lang string, _th string, gone string, gone_text string, rejected string, `a.b` string"


def test_filters_with_clashing_and_dotted_names(spark):
    near = "one two three four five six seven eight nine ten"
    rows = [(2, near), (1, near), (None, near), (None, near), (3, None), (4, ""), (5, "other words that stand alone in here")]
    df = spark.createDataFrame([(i, t, "s", "en", "x", "y", "z", "r", "d") for i, t in rows], CLASHING)
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (False, 0), (True, 1), (True, 3), (True, 4), (True, 5)]
    dotted = df.withColumnRenamed("doc_id", "doc.id").withColumnRenamed("text", "the.text")
    assert minhash.keep_one_of_each(dotted, "doc.id", "the.text").count() == 6
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    assert quality.keep_accepted(df, labels).columns == df.columns


def test_quality_posteriors_equal_the_closed_form(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "Some good words, in a line of text." if rng.random() < (0.9 if i % 4 else 0.3) else "BAD!! JUNK!! | | | ##", f"s{min(int(rng.geometric(0.3)), 6)}") for i in range(300)]
    df = spark.createDataFrame([(i, t, s, "en" if i % 3 else "de", "x", "y") for i, t, s in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(t.startswith("Some"))) for i, t, _ in rows[:120]], "doc_id long, quality int")
    got = {r["doc"]: r for r in quality.score_quality(df, labels).collect()}
    of = [(s, "en" if i % 3 else "de") for i, _, s in rows]
    p = np.array([got[i]["p_document"] for i in range(300)])
    inside = lambda x: np.clip(x, quality.CLOSE, 1 - quality.CLOSE)
    strength = lambda m, v: min(max(m * (1 - m) / max(v, 1e-9) - 1, 1.0), 1000.0)
    hosts, paths = sorted({h for h, _ in of}), sorted(set(of))
    hn, hs = {h: sum(o[0] == h for o in of) for h in hosts}, {h: sum(x for x, o in zip(p, of, strict=True) if o[0] == h) for h in hosts}
    pn, ps = {q: of.count(q) for q in paths}, {q: sum(x for x, o in zip(p, of, strict=True) if o == q) for q in paths}
    mean = inside(p.mean())
    noise = (p * p).mean() - mean * mean
    world = strength(mean, max(sum(hs[h] ** 2 / hn[h] for h in hosts) / 300 - mean * mean - noise * len(hosts) / 300, 0.0))
    spread = sum((ps[q] / pn[q] - hs[q[0]] / hn[q[0]]) ** 2 * pn[q] for q in paths) / 300
    below = strength(mean, max(spread - mean * (1 - mean) * len(paths) / 300 * 0.1, 0.0))
    logit = lambda x: np.log(x / (1 - x))
    for i, (h, q) in enumerate((o[0], o) for o in of):
        host = (mean * world + hs[h] - p[i]) / (world + hn[h] - 1)
        path = inside((host * below + ps[q] - p[i]) / (below + pn[q] - 1))
        z = logit(p[i]) + logit(path) - logit(mean)
        assert (got[i]["p_host"], got[i]["p_path"], got[i]["p_quality"]) == (pytest.approx(host), pytest.approx(path), pytest.approx(1 / (1 + np.exp(-z))))


def test_pipeline_with_odd_rows(spark, tmp_path):
    good = lambda i: "Told at length: " + " ".join(f"word{(i * 37 + 11 * k * k) % 9973}" for k in range(30)) + "."
    rows = [(i, good(i), f"s{i % 7}", "en") for i in range(60)] + [(60, None, None, None), (61, "", "s1", "en"), (None, good(99), "s1", None), (62, "long words " * 20_000, "s2", "en")]
    rows += [(63, good(3), "s3", "en")] * 2
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, source string, lang string, _th string, removed string, leak string")
    for name, keep in (("full", True), ("empty", False)):
        folder = f"{tmp_path}/{name}"
        (frame if keep else frame.limit(0)).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(40)] if keep else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, good(5)), (None, None)] if keep else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs_ = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, make in corpus_pipeline.STAGES[:-1]:
            docs_ = make(spark, docs_, folder)
            assert docs_.columns == frame.columns, stage
            docs_.write.parquet(f"{folder}/{stage}")
            docs_ = spark.read.parquet(f"{folder}/{stage}")
        packed = corpus_pipeline.STAGES[-1][1](spark, docs_, folder)
        kept = {r.doc_id for r in docs_.collect()}
        assert {r.doc_id for r in packed.collect()} == kept and (5 not in kept) and (len(kept) > 30) == keep
