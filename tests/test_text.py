import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as t
from marlstone.functions.stemming import porter, resolve_stemmer, stem_tokens
from marlstone.functions.wordlists import ENGLISH_STOPWORDS, UNIMPORTANT_TAGS


def test_tokenize_example(column):
    got = column(["this is a test. this is a test", "this is another test"], lambda c: t.tokenize(c, pattern=r"\S+"))
    assert got == [["this", "is", "a", "test.", "this", "is", "a", "test"], ["this", "is", "another", "test"]]
    assert t.resolve_tokenizer("reg") == "regexp"
    with pytest.raises(ValueError):
        t.resolve_tokenizer("other")


def test_stopwords_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert sorted(ENGLISH_STOPWORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))
    assert len(UNIMPORTANT_TAGS) == 22


def test_punctuation_and_digits(column):
    assert column(["a-b, c@d! [x]^y\\z", ""], t.remove_punctuation) == ["ab cd xyz", ""]
    assert column(["a-b, c@d!"], lambda c: t.remove_punctuation(c, ignore="@-")) == ["a-b cd@"[:3] + " c@d"]
    assert column(["a-b"], lambda c: t.remove_punctuation(c, punctuation="")) == ["a-b"]
    assert column(["a1b22"], t.remove_numeric) == ["ab"]


def test_stopwords_keep_order_and_case(column):
    assert column(["The  Cat and\tTHE dog", "the", ""], t.remove_stopwords) == ["Cat dog", "", ""]


def _split_scan(words, stop):
    out, i = [], 0
    while i < len(words):
        if i + 1 < len(words) and words[i] + words[i + 1] in stop:
            i += 2
        else:
            out.append(words[i])
            i += 1
    return out


def test_split_stopwords_brute_force(spark):
    import random

    rng = random.Random(3)
    stop = {"ab", "ba", "aab", "abab", "bb"}
    rows = [[rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randrange(0, 14))] for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<string>")
    got = [r[0] for r in df.orderBy("i").select(t.drop_split_stopwords("w", stop)).collect()]
    assert got == [_split_scan(r, stop) for r in rows]


def test_short_tokens(column):
    assert column(["An ox, a cat; four!", "a"], t.remove_short_tokens) == ["cat four", ""]
    assert column(["An ox"], lambda c: t.remove_short_tokens(c, 1)) == ["an ox"]


def test_consolidate(column):
    assert column(["Colour of grey"], lambda c: t.consolidate_words(c, {"colour": "color", "grey": "gray"})) == ["color of gray"]


def test_split_substrings_example(column):
    assert set(column(["process"], lambda c: t.split_substrings(c, 4))[0]) == {
        "proc", "proce", "proces", "process", "cess", "ocess", "rocess"}
    assert column(["ab", "abc"], lambda c: t.split_substrings(c, 3)) == [[], ["abc"]]
    assert column(["ab"], lambda c: t.split_substrings(c, 0)) == [["ab", "b", "a"]]


def test_phrase_rules(column, tmp_path):
    rules = "# comment\n\nSTART ab X\nEND yz $1\nEQUAL q r\nALL . _"
    assert column(["ab.cyz", "q", "qq", "yz"], lambda c: t.clean_specific_phrases(c, rules)) == ["X_c$1", "r", "qq", "$1"]
    path = tmp_path / "rules.txt"
    path.write_text("EQUAL a b")
    assert t.parse_phrase_rules(str(path)) == [("EQUAL", "a", "b")]
    with pytest.raises(ValueError):
        t.parse_phrase_rules("START a\n")
    with pytest.raises(ValueError):
        t.parse_phrase_rules("EQUALS a b\n")


def test_clean_text_order(column):
    # The apostrophe goes before stop-words are looked up, so "dont" stays.
    assert column(["I DON'T like 3 Cats!"], t.clean_text) == ["dont like cats"]
    assert column(["It is 5 o'clock"], lambda c: t.clean_text(c, stopwords=False, short_tokens=False)) == ["it is  oclock"]
    assert column(["Running cats"], lambda c: t.clean_text(c, stemmer="porter")) == ["run cat"]
    assert column(["a-b the-c"], lambda c: t.clean_text(c, ignore="-", short_tokens=False)) == ["a-b the-c"]


def test_entities(column):
    assert column(["see http://x.y/z #tag @me ok u'RTx"], t.strip_entities) == ["see    ok "]


def test_sentences_normalised(column):
    assert column(["It's (really) bad, isn't it?"], t.normalise_sentence) == ["it 's ( really ) bad , is n't it ?"]
    assert column(["It's a well-known_fact"], lambda c: t.normalise_sentence(c, contractions=False, keep="-")) == ["it's a well-known fact"]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 12), length=st.integers(2, 10))
def test_cut_or_pad_length(spark, n, length):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(t.cut_or_pad("w", length)).first()[0]
    assert len(got) == length
    assert got == (words[:length] if n >= length else ["<pad>"] + words + ["<pad>"] * (length - n - 1))


def test_questions(column):
    assert column(["What is the best-known city?", None], t.prepare_question) == ["best-known city ?", "empty string"]
    assert column(["", "Is it?"], t.pair_tokens) == [["empty", "string"], ["is", "it", "?"]]


def test_digits(column):
    assert column(["1,234", "a1", "$12", "3.5"], t.canonical_digits) == ["DGDGDGDG", "a1", "$DGDG", "DG.DG"]


def test_contexts_and_pairs(column):
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = column(["a b c", "x", ""], lambda c: t.word_contexts(words(c)))
    assert [tuple(r) for r in got[0]] == [("a", "<START>", "b"), ("b", "a", "c"), ("c", "b", "<End>")]
    assert [tuple(r) for r in got[1]] == [("x", "<None>", "<None>")]
    assert got[2] == []
    assert [[tuple(p) for p in r] for r in column(["a b c", "x"], lambda c: t.next_words(words(c)))] == [[("a", "b"), ("b", "c")], []]
    assert column(["a b c", "x"], lambda c: t.ngrams(words(c), (1, 3))) == [["a", "b", "c", "a b", "b c", "a b c"], ["x"]]


def test_message_parts(column):
    message = "From: a\n\nhello\n> quoted\nhe wrote:\nbody\n--\nsignature"
    assert column([message, "no blank line"], t.strip_message_parts) == ["hello\nbody", ""]


def test_tags(spark):
    df = spark.sql("SELECT array(named_struct('word', 'w', 'tag', 'VBG'), named_struct('word', 'x', 'tag', 'JJ'), "
                   "named_struct('word', 'y', 'tag', 'RB'), named_struct('word', 'z', 'tag', 'IN')) AS a")
    coarse = df.select(t.sanitize_tags("a").alias("a"))
    assert [r["tag"] for r in coarse.first()[0]] == ["v", "a", "r", None]
    assert coarse.select(t.check_tags("a")).first()[0][0]["word"] == "w"
    with pytest.raises(Exception, match="tag must be"):
        df.select(t.check_tags("a")).collect()
    assert [r["word"] for r in df.select(t.filter_tags("a", UNIMPORTANT_TAGS)).first()[0]] == ["w", "x"]
    assert df.select(t.combine_tags("a")).first()[0] == ["wVBG", "xJJ", "yRB", "zIN"]


def test_porter_published_examples():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "feed": "feed", "conflated": "conflat", "hopping": "hop",
             "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic",
             "electriciti": "electr", "adoption": "adopt", "controll": "control", "roll": "roll", "probate": "probat"}
    assert {w: porter(w) for w in pairs} == pairs


def test_stem_arrays_and_names(spark):
    df = spark.createDataFrame([(0, ["running", None, "cats", "running"]), (1, []), (2, None)], "i int, w array<string>")
    assert [r[0] for r in df.orderBy("i").select(stem_tokens("w", "p")).collect()] == [["run", None, "cat", "run"], [], None]
    assert resolve_stemmer("") == "porter"
    with pytest.raises(NotImplementedError):
        resolve_stemmer("lan")
    with pytest.raises(ValueError):
        resolve_stemmer("unknown")
