"""Pseudonyms against a plain Feistel network, and their formats."""

import hashlib
import re

from pyspark.sql import functions as F

from marlstone.llm import pii


def plain_feistel(x, a, b, key):
    left, right = divmod(x, b)
    for i in range(pii.ROUNDS):
        half = right if i % 2 == 0 else left
        d = int(hashlib.sha256(f"{key}|{i}|{half}".encode()).hexdigest()[:14], 16)
        if i % 2 == 0:
            left = (left + d) % a
        else:
            right = (right + d) % b
    return left * b + right


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_feistel_is_the_plain_one_and_a_permutation(spark):
    got = [r[0] for r in spark.range(189 * 7).select(pii.feistel(F.col("id"), 189, 7, F.lit("k"))).collect()]
    assert got == [plain_feistel(x, 189, 7, "k") for x in range(189 * 7)] and sorted(got) == list(range(189 * 7))
    big = 10 ** 17 - 3
    one = spark.createDataFrame([(big,)], "x long").select(pii.feistel(F.col("x"), 10 ** 9, 10 ** 8, F.lit("k"))).first()[0]
    assert one == plain_feistel(big, 10 ** 9, 10 ** 8, "k")


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, private string")
    return [r["private_"] for r in pii.pseudonymise(df, key).orderBy("doc_id").collect()]


def test_formats_links_and_invalid_values(spark):
    card, bad = "4348649190265535", "4348649190265536"
    assert luhn(card)
    got = run(spark, [
        f"pay {card}, or {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}.", f"not {bad} nor 12345678901234567890123", "call +1 (953) 555-9811 now", "953-555-9811",
        "host 45.114.23.72 but 256.1.1.1 and 1.2.3.4.5", "born 1999-02-28, not 1999-02-30; 12/31/2020 28.02.1999", "ssn 123-45-6789 or 000-12-3456",
        "mail Joe.Doe@example.com.", None, "", "no numbers here", card])
    assert [f["kind"] for f in got[0]["found"]] == ["card", "card"] and [f["kind"] for f in got[2]["found"]] == ["phone"]
    one, two = (f["text"] for f in got[0]["found"])
    assert luhn(one) and one != card and one == two.replace("-", "") and re.fullmatch(r"\d{4}-\d{4}-\d{4}-\d{4}", two)
    assert got[11]["clean_text"] == one and got[0]["clean_text"] == f"pay {one}, or {two}."
    assert got[1]["found"] == [] and got[1]["clean_text"] == f"not {bad} nor 12345678901234567890123"
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} now", got[2]["clean_text"])
    assert re.sub(r"\D", "", got[2]["clean_text"])[1:] == re.sub(r"\D", "", got[3]["clean_text"])
    assert [f["original"] for f in got[4]["found"]] == ["45.114.23.72"] and all(0 <= int(x) <= 255 for x in got[4]["found"][0]["text"].split("."))
    assert [f["original"] for f in got[5]["found"]] == ["1999-02-28", "12/31/2020", "28.02.1999"]
    assert got[5]["found"][0]["text"].split("-") == got[5]["found"][2]["text"].split(".")[::-1]
    assert [f["original"] for f in got[6]["found"]] == ["123-45-6789"] and re.fullmatch(r"mail u[0-9a-f]{12}@example\.com\.", got[7]["clean_text"])
    assert got[8]["clean_text"] is None and got[8]["found"] == [] and got[9]["clean_text"] == "" and got[10]["clean_text"] == "no numbers here"


def test_neighbours_of_digits_hide_nothing(spark):
    card, amex, other = "4111111111111111", "3782 822463 10005", "4111 1111 1111 1111"
    loose = "41111 11111 111111"
    lines = {
        f"{card} 12": [card], f"{card} 12/25": [card], f"{other} 123": [other], f"7 {other}": [other], f"1234 {other}": [other], f"{amex} 1234": [amex],
        f"{other} 3056 930902 5904 99": [other, "3056 930902 5904"], f"{other} {card} 5": [other, card],
        "123-45-6789 2024-01-15": ["123-45-6789", "2024-01-15"], "2024-01-15 2024-02-15": ["2024-01-15", "2024-02-15"],
        "2024-01-15 555-223-4567": ["2024-01-15", "555-223-4567"], "123-45-6789 287-65-4321 5": ["123-45-6789", "287-65-4321"],
        f"{card} 123-45-6789": [card, "123-45-6789"], f"000-12-3456 {card}": [card], loose: [loose], f"x {loose} 2024-01-15.": [loose, "2024-01-15"],
        "4111111111111112 12": [], "12345678901234567890 1": []}
    for (text, wanted), got in zip(lines.items(), run(spark, list(lines)), strict=True):
        assert [f["original"] for f in got["found"]] == wanted, text
        rest = text
        for f in got["found"]:
            rest = rest.replace(f["original"], f["text"], 1)
        assert got["clean_text"] == rest and not any(w in got["clean_text"] for w in wanted), text


def test_no_two_values_share_a_pseudonym_and_keys_differ(spark):
    texts = [f"10.0.{i // 256}.{i % 256}" for i in range(600)] + [f"2001-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    a, b = (sum((x["found"] for x in run(spark, texts, k)), []) for k in "ab")
    assert len({f["text"] for f in a}) == len(a) == len(texts) and sum(x["text"] == y["text"] for x, y in zip(a, b, strict=True)) < 5


def test_long_text_and_no_rows(spark):
    got = run(spark, ["x 10.1.2.3 " * 3000])[0]
    assert len(got["found"]) == 3000 and len({f["text"] for f in got["found"]}) == 1
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0


def test_query_counts_by_kind(spark, tmp_path):
    from marlstone.llm.queries import op8_pii

    spark.createDataFrame([(1, "ip 10.1.2.3 and 10.1.2.4, mail a@b.org"), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op8_pii(spark, str(tmp_path)).collect()}
    assert (rows[1].n_ip, rows[1].n_email, rows[1].n_card) == (2, 1, 0)
    assert rows[2].clean_text is None and rows[2].n_ip == 0 and rows[3].clean_text == ""


def test_values_behind_marks_and_in_other_forms(spark):
    card = "4111111111111111"
    lines = {
        f"Card No.{card}": [card], f"Card-{card}": [card], "SSN-123-45-6789": ["123-45-6789"], "born.2024-01-15": ["2024-01-15"], "on 15.1.2024.": ["15.1.2024"],
        "on 2024/01/15, 1/5/2024": ["2024/01/15", "1/5/2024"], "at 2024-01-15T10:00:00Z": ["2024-01-15"], "call +12125551234": ["+12125551234"],
        "to ünï@b.co": ["ünï@b.co"], "tel.212-555-1234": ["212-555-1234"], "ip.10.1.2.3": ["10.1.2.3"],
        f"1.{card}": [], "1-123-45-6789": [], "9.1.2.3.4": [], "2024-01-15Tx": [], "31.2.2024": [], "2024/13/01": [], "1/2024-01-15": []}
    got = run(spark, list(lines))
    for (text, wanted), r in zip(lines.items(), got, strict=True):
        assert [f["original"] for f in r["found"]] == wanted, text
        rest = text
        for f in r["found"]:
            assert f["text"] != f["original"]
            rest = rest.replace(f["original"], f["text"], 1)
        assert r["clean_text"] == rest, text
    assert re.fullmatch(r"\+1[2-9]\d\d[2-9]\d{6}", got[7]["found"][0]["text"])
    day = lambda i, j, order: tuple(int(x) for x in [re.split(r"[./-]", got[i]["found"][j]["text"])[k] for k in order])
    assert day(3, 0, (0, 1, 2)) == day(4, 0, (2, 1, 0)) == day(5, 0, (0, 1, 2)) == day(6, 0, (0, 1, 2))


def test_finder_against_brute_force(spark):
    """Every place that is a printed card, SSN, address or ISO day by a plain scan is found, in texts of random neighbours."""
    import datetime
    import random

    rng = random.Random(8)

    def card():
        head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if luhn(head + c))

    values = [card, lambda: f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}",
              lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), lambda: str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(60_000)))]
    texts, wanted = [], []
    for _ in range(60):
        parts, own = [], []
        for _ in range(rng.randrange(1, 6)):
            value = rng.choice(values)()
            own.append(value)
            parts += [rng.choice(["a ", "No.", "(", "x: ", "born-", "..", "é ", "\n"]), value, rng.choice([" b ", ", ", ") ", ". ", "\n", "; "])]
        texts.append("".join(parts))
        wanted.append(own)
    for text, own, got in zip(texts, wanted, run(spark, texts), strict=True):
        assert [f["original"] for f in got["found"]] == own, text
