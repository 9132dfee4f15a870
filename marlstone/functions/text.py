"""Row-wise text functions.

Every function takes and returns a Column built from Spark's own expressions,
so a whole cleaning chain stays one projection inside the JVM and adds no
shuffle.  Chains refer to their input once per step, so they grow linearly, and
lambdas refer only to their own arguments: whatever else a lambda mentions
would be computed again for every element.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .wordlists import ENGLISH_STOPWORDS, PUNCTUATION

# Token patterns.  The first is a run of Unicode word characters,
# the second a run of anything but white space.
WORD = r"[\p{L}\p{N}_]+"
NON_SPACE = r"[^\s\p{Z}\x0B\x1C-\x1F\x85]+"
WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

# Parts of a short message that are not prose, in removal order.
MESSAGE_ENTITIES = (r"http\S+", r"#\S+", r"@\S+", r"u'RT\S+")

# The sentence normaliser's kept characters, contraction endings
# and marks that become tokens of their own.
KEPT_CHARACTERS = r"A-Za-z0-9(),!?'`"
CONTRACTION_ENDINGS = ("'s", "'ve", "n't", "'re", "'d", "'ll")
SEPARATE_MARKS = (",", "!", "(", ")", "?")

# How a quoted line of a message starts or announces itself.
QUOTED_LINE = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"

PAD = "<pad>"
UNKNOWN = "<unk>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _quoted(text: str) -> str:
    """``text`` as a literal inside a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&])", r"\\\1", text)


def as_text(c) -> Column:
    """Any scalar as a string; undecodable bytes are dropped."""
    return F.translate(_col(c).cast("string"), "�", "")


def lower_all(c) -> Column:
    return F.lower(_col(c))


def remove_punctuation(c, ignore: Iterable[str] | None = None, punctuation: Iterable[str] = PUNCTUATION) -> Column:
    """Delete (not blank out) punctuation, keeping the characters in ``ignore``."""
    return _without(c, _dropped(ignore, punctuation))


def _dropped(ignore: Iterable[str] | None, punctuation: Iterable[str]) -> str:
    keep = set("".join(ignore)) if ignore else set()
    return "".join(ch for ch in "".join(punctuation) if ch not in keep)


def _without(c, characters: str, also: str = "") -> Column:
    """Delete a set of characters (one pass; ``also`` is a ready class part)."""
    return F.regexp_replace(_col(c), f"[{_quoted(characters)}{also}]+", "") if characters or also else _col(c)


def remove_numeric(c) -> Column:
    return _without(c, "", "0-9")


def resolve_tokenizer(name: str = "regexp") -> str:
    """The tokenizer's full name from any prefix of it."""
    if "regexp".startswith(name.lower()):
        return "regexp"
    raise ValueError(f"unknown tokenizer: {name!r}")


def tokenize(c, tokenizer: str = "regexp", pattern: str = WORD) -> Column:
    """Lower-case, then every match of ``pattern``."""
    resolve_tokenizer(tokenizer)
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(pattern), F.lit(0))


def whitespace_tokens(c, lower: bool = True) -> Column:
    """Runs of non-space characters (no empty strings at the edges)."""
    text = F.lower(_col(c)) if lower else _col(c)
    return F.regexp_extract_all(text, F.lit(NON_SPACE), F.lit(0))


def join_tokens(tokens) -> Column:
    return F.array_join(_col(tokens), " ")


def drop_stopwords(tokens, stopwords: Iterable[str] | None = None, case_sensitive: bool = False) -> Column:
    """Tokens that are not stop-words; the list is a literal set lookup."""
    words = sorted({w if case_sensitive else w.lower() for w in (ENGLISH_STOPWORDS if stopwords is None else stopwords)})
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda w: ~(w if case_sensitive else F.lower(w)).isin(words))


def drop_split_stopwords(tokens, stopwords: Iterable[str] | None = None) -> Column:
    """Drop neighbouring tokens that together spell a stop-word.

    Left to right and without overlap.  Each token becomes one letter of a mask
    (1 = joins its successor into a stop-word); replacing "1 and the letter
    after it" by DD is exactly the left-to-right scan, in linear time.
    """
    words = sorted({w.lower() for w in (ENGLISH_STOPWORDS if stopwords is None else stopwords)})
    tokens = _col(tokens)
    following = F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1)))
    longest = max(map(len, words), default=0)
    hits = F.zip_with(tokens, following, lambda a, b: F.when(
        (F.length(a) + F.length(b) <= longest) & F.concat(a, b).isin(words), "1").otherwise("0"))
    mask = F.split(F.regexp_replace(F.array_join(hits, ""), "1.", "DD"), "")
    pairs = F.arrays_zip(tokens.alias("w"), mask.alias("m"))
    return F.filter(pairs, lambda p: p["m"] == "0").getField("w")


def remove_stopwords(c, stopwords: Iterable[str] | None = None, splitwords: bool = False) -> Column:
    """Drop stop-words from text and re-join with single spaces."""
    kept = drop_stopwords(whitespace_tokens(c, lower=False), stopwords)
    return join_tokens(drop_split_stopwords(kept, stopwords) if splitwords else kept)


def remove_short_tokens(c, minimum_token_length: int = 3, pattern: str = WORD) -> Column:
    if pattern == WORD and minimum_token_length > 1:
        # A word is a whole run of word characters, so its least length can be
        # asked of the run itself.
        return join_tokens(tokenize(c, pattern=f"{WORD[:-1]}{{{minimum_token_length},}}"))
    return join_tokens(F.filter(tokenize(c, pattern=pattern), lambda w: F.length(w) >= minimum_token_length))


def consolidate_words(c, variants: Mapping[str, str], pattern: str = WORD) -> Column:
    """Variant to canonical form by a literal map of any size.

    Membership is a hash lookup; only a token that is a variant searches the
    map.  A table that grows with the data goes through
    ``operators.lookup.consolidate_by_table``.
    """
    if not variants:
        return join_tokens(tokenize(c, pattern=pattern))
    table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
    return join_tokens(F.transform(tokenize(c, pattern=pattern), lambda w: F.when(w.isin(list(variants)), F.try_element_at(table, w)).otherwise(w)))


def sentence_split(c) -> Column:
    """Sentences by end mark and white space (approximate)."""
    return F.split(F.trim(_col(c)), r"(?<=[.!?])\s+")


def split_substrings(word, minimum_length: int) -> Column:
    """All suffixes of at least ``minimum_length``, then the shorter prefixes."""
    if not isinstance(minimum_length, int):
        raise TypeError("minimum_length must be an integer")
    m = max(minimum_length, 1)
    w = _col(word)
    n = F.length(w)
    none = F.array().cast("array<string>")
    suffixes = F.when(n >= m, F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.substring(w, i, n))).otherwise(none)
    prefixes = F.when(n > m, F.transform(F.sequence(F.lit(m), n - 1), lambda k: F.substring(w, F.lit(1), k))).otherwise(none)
    return F.concat(suffixes, prefixes)


def parse_phrase_rules(context: str) -> list[tuple[str, str, str]]:
    """``POSITION from to`` lines, from a rule text or a readable local path."""
    if "\n" not in context and os.path.exists(context):
        with open(context, encoding="utf-8") as f:
            context = f.read()
    rules = []
    for line in context.split("\n"):
        if not line.strip() or line.startswith("#"):
            continue
        parts = line.split()
        if len(parts) != 3:
            raise ValueError(f"a rule is POSITION from to, not {line!r}")
        if parts[0] not in ("START", "END", "EQUAL", "ALL"):
            raise ValueError(f"unknown rule position: {parts[0]!r}")
        rules.append(tuple(parts))
    return rules


def clean_specific_phrases(c, context: str) -> Column:
    """Apply the rules in order; each is one anchored replacement."""
    anchors = {"START": ("\\A", ""), "END": ("", "\\z"), "EQUAL": ("\\A", "\\z")}
    text = _col(c)
    for position, old, new in parse_phrase_rules(context):
        if position == "ALL":
            text = F.replace(text, F.lit(old), F.lit(new))
        else:
            before, after = anchors[position]
            target = new.replace("\\", "\\\\").replace("$", "\\$")
            text = F.regexp_replace(text, before + _quoted(old) + after, target)
    return text


def clean_text(c, *, punctuation: bool = True, numeric: bool = True, stopwords: bool | Iterable[str] = True,
               short_tokens: bool = True, variants: Mapping[str, str] | None = None,
               ignore: Iterable[str] | None = None, punctuation_set: Iterable[str] = PUNCTUATION,
               splitwords: bool = False, minimum_token_length: int = 3, stemmer: str | None = None,
               pattern: str = WORD) -> Column:
    """The cleaning chain: lower, punctuation, digits, stop-words, short words, variants, stem.

    Punctuation goes first, so "don't" is "dont" by the time stop-words are
    looked up and stays.  Lemmas need a table:
    ``operators.lookup.lemmatize``.
    """
    text = lower_all(c)
    # Two deletions of single characters are one deletion of either.
    text = _without(text, _dropped(ignore, punctuation_set) if punctuation else "", "0-9" if numeric else "")
    if stopwords is not False:
        text = remove_stopwords(text, None if stopwords is True else stopwords, splitwords)
    if short_tokens:
        text = remove_short_tokens(text, minimum_token_length, pattern)
    if variants is not None:
        text = consolidate_words(text, variants, pattern)
    if stemmer is not None:
        from .stemming import stem_tokens

        text = join_tokens(stem_tokens(tokenize(text, pattern=pattern), stemmer))
    return text


def strip_entities(c) -> Column:
    """Remove links, hash tags, user names and repost marks from a message."""
    text = _col(c)
    for pattern in MESSAGE_ENTITIES:
        text = F.regexp_replace(text, pattern, "")
    return text


def normalise_sentence(c, contractions: bool = True, keep: str = "") -> Column:
    """Keep letters, digits and a few marks; space the marks out; lower-case."""
    text = F.regexp_replace(_col(c), f"[^{KEPT_CHARACTERS}{_quoted(keep)}]", " ")
    for ending in CONTRACTION_ENDINGS if contractions else ():
        text = F.replace(text, F.lit(ending), F.lit(" " + ending))
    for mark in SEPARATE_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(f" {mark} "))
    return F.lower(F.trim(F.regexp_replace(text, r"\s{2,}", " ")))


def stop_stem_tokens(c, punctuation: bool = True, stop: bool = False, stemmer: str | None = None,
                     stopwords: Iterable[str] | None = None) -> Column:
    """Tokens of already normalised text, optionally without stop-words and stemmed."""
    text = remove_punctuation(c) if punctuation else _col(c)
    tokens = whitespace_tokens(text, lower=False)
    if stop:
        tokens = F.transform(drop_stopwords(tokens, stopwords, case_sensitive=True), F.lower)
    if stemmer is not None:
        from .stemming import stem_tokens

        tokens = stem_tokens(tokens, stemmer)
    return tokens


def cut_or_pad(tokens, length: int) -> Column:
    """Exactly ``length`` tokens: cut, or one pad in front and the rest behind."""
    words = _col(tokens)
    n = F.size(words)
    pad = F.array(F.lit(PAD))
    return F.when(n >= length, F.slice(words, 1, length)).otherwise(
        F.concat(pad, words, F.array_repeat(F.lit(PAD), length - 1 - n)))


def prepare_document(c, length: int = 2000, fix_length: bool = True) -> Column:
    """Normalised, stop-word-free tokens of a document, cut or padded."""
    tokens = stop_stem_tokens(normalise_sentence(c), punctuation=True, stop=True)
    return cut_or_pad(tokens, length) if fix_length else tokens


def prepare_question(c) -> Column:
    """Normalised question without stop-words; a missing one is "empty string"."""
    cleaned = join_tokens(stop_stem_tokens(normalise_sentence(c, contractions=False, keep="-"),
                                           punctuation=False, stop=True))
    return F.when(_col(c).isNull(), F.lit("empty string")).otherwise(cleaned)


def canonical_digits(word) -> Column:
    """A word without letters has each digit as DG and no thousands commas."""
    w = _col(word)
    marked = F.regexp_replace(w, r"\p{Nd}", "DG")
    return F.when(w.rlike(r"\p{L}"), w).when(marked.startswith("DG"), F.replace(marked, F.lit(","), F.lit(""))).otherwise(marked)


def pair_tokens(c) -> Column:
    """Words and single marks of a question; an empty one reads "empty string"."""
    text = F.when(F.coalesce(_col(c), F.lit("")) == "", F.lit("empty string")).otherwise(F.lower(_col(c)))
    return F.regexp_extract_all(text, F.lit(WORD_OR_MARK), F.lit(0))


def edit_text(c) -> Column:
    """Only ASCII letters, digits, blanks and line ends, for edit distances."""
    return F.regexp_replace(_col(c), r"[^A-Za-z0-9 \n]+", "")


def next_words(tokens) -> Column:
    """(word, next_word) of every token but the last."""
    t = _col(tokens)
    rest = F.greatest(F.size(t) - 1, F.lit(0))
    return F.arrays_zip(F.slice(t, F.lit(1), rest).alias("word"), F.slice(t, F.lit(2), rest).alias("next_word"))


def word_contexts(tokens) -> Column:
    """Every token with its neighbours; sentence edges have marker words."""
    t = _col(tokens)
    n = F.size(t)
    rest = F.greatest(n - 1, F.lit(0))
    before = F.when(n > 1, F.concat(F.array(F.lit("<START>")), F.slice(t, F.lit(1), rest))).otherwise(F.array(F.lit("<None>")))
    after = F.when(n > 1, F.concat(F.slice(t, F.lit(2), rest), F.array(F.lit("<End>")))).otherwise(F.array(F.lit("<None>")))
    rows = F.arrays_zip(t.alias("word"), before.alias("prev_word"), after.alias("next_word"))
    return F.slice(rows, F.lit(1), n)


def ngrams(tokens, ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """All n-grams with n in the range, words joined by one space."""
    lo, hi = ngram_range
    t = _col(tokens)
    parts, grams = [], t
    for n in range(1, hi + 1):
        if n > 1:
            # Append the n-th word; the shifted list ends first, and the
            # n-grams that ran out of words are null.
            grams = F.array_compact(F.zip_with(grams, F.slice(t, n, F.greatest(F.size(t), F.lit(1))),
                                               lambda g, w: F.concat(g, F.lit(" "), w)))
        if n >= lo:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def strip_message_parts(c, headers: bool = True, quotes: bool = True, footers: bool = True) -> Column:
    """Remove the header block, quoted lines and the signature of a message.

    Header: up to the first blank line (a message without one is all header).
    Footer: from the last line that is blank or made of dashes.  Quotes: lines
    that start with > or | or announce a quotation.
    """
    text = _col(c)
    if headers:
        cut = F.instr(text, "\n\n")
        text = F.when(cut > 0, F.substr(text, cut + 2)).otherwise(F.lit(""))
    if footers:
        lines = F.split(F.trim(text), "\n")
        last = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(r"^\s*-*\s*$"), i)))
        text = F.when(last > 0, F.array_join(F.slice(lines, F.lit(1), last), "\n")).otherwise(text)
    if quotes:
        text = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTED_LINE)), "\n")
    return text


# -- tagged words: array<struct<word, tag>> ---------------------------------

def sanitize_tags(tagged) -> Column:
    """Fine tags to v, n, a (adjective) or r (adverb); anything else to null."""
    def coarse(t):
        tag = F.lower(t["tag"])
        return F.struct(t["word"].alias("word"), F.when(tag.startswith("v"), "v").when(tag.startswith("n"), "n")
                        .when(tag.startswith("j"), "a").when(tag.startswith("rb"), "r")
                        .when(tag.isin("a", "r"), tag).alias("tag"))

    return F.transform(_col(tagged), coarse)


def check_tags(tagged) -> Column:
    """The same tagged words; an unknown coarse tag fails the job."""
    ok = F.forall(_col(tagged), lambda t: t["tag"].isNull() | t["tag"].isin("a", "n", "r", "v"))
    return F.when(ok, _col(tagged)).otherwise(
        F.raise_error(F.lit("tag must be one of a, n, r, v or null")).cast("array<struct<word:string,tag:string>>"))


def filter_tags(tagged, ignore: Iterable[str]) -> Column:
    words = list(ignore)
    return F.filter(_col(tagged), lambda t: ~t["tag"].isin(words))


def combine_tags(tagged) -> Column:
    return F.transform(_col(tagged), lambda t: F.concat(t["word"], t["tag"]))
