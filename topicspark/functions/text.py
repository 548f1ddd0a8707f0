"""Column-level text functions.

Every function takes and returns ``Column`` objects built only from Spark's
built-in expressions, so the work stays JVM-side inside whole-stage codegen.
Regex patterns are written in the subset shared by Java regex and RE2, so the
same pattern text is used by the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour.
# Character classes of the Japanese code-frequency count (katakana is tested
# first, so the long-vowel mark U+30FC, listed in both sets, counts as katakana):
#   katakana: U+30A1..U+30F6 and U+30FC
#   hiragana: U+3041..U+3096 and U+30FC
#   kanji:    U+4E00..U+9FFF
KATAKANA_CLASS = r"[\x{30A1}-\x{30F6}\x{30FC}]"
HIRAGANA_CLASS = r"[\x{3041}-\x{3096}]"  # U+30FC is already counted as katakana
KANJI_CLASS = r"[\x{4E00}-\x{9FFF}]"
# Line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Whitespace of Python's str.split() with no argument.
WS_CHARS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Analytical word tokens: runs of letters and digits (lower-cased first).
WORD_TOKEN = r"[\p{L}\p{N}]+"
# Sentence: a run of non-terminators followed by its terminators.
SENTENCE = r"[^.!?。！？\n]+[.!?。！？]*"
# Script runs for Japanese text without a morphological analyser.
SCRIPT_RUN = (r"[\x{4E00}-\x{9FFF}々]+|[\x{3041}-\x{3096}\x{30FC}]+|[\x{30A1}-\x{30FA}\x{30FC}]+"
              r"|[0-9\x{FF10}-\x{FF19}]+|[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+"
              r"|[\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]+")
THINK_TAG = r"</?think>"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value, use) -> Column:
    """use(value) with the value computed once a row.

    A column that a lambda refers to may be inlined into it by the optimizer,
    and is then computed again for each element; a lambda's variable never is.
    """
    return F.get(F.transform(F.array(_c(value)), use), F.lit(0))


# --- T1 / T2: character classes and histogram ------------------------------

def code_frequencies(text) -> Column:
    """struct(katakana, hiragana, kanji, other) character counts."""
    t = _c(text)
    kata = F.regexp_count(t, F.lit(KATAKANA_CLASS)).cast("bigint")
    hira = F.regexp_count(t, F.lit(HIRAGANA_CLASS)).cast("bigint")
    kanji = F.regexp_count(t, F.lit(KANJI_CLASS)).cast("bigint")
    total = F.length(t).cast("bigint")
    return F.struct(kata.alias("katakana"), hira.alias("hiragana"), kanji.alias("kanji"),
                    (total - kata - hira - kanji).alias("other"))


def characters(text) -> Column:
    """Array of the characters (code points) of a text."""
    return F.split(_c(text), "", -1)


# --- T3 / T4: katakana sentences -------------------------------------------

def _class_count(text: Column, cls: str) -> Column:
    """Characters of a class, without an array that holds each of them."""
    return F.length(text) - F.length(F.regexp_replace(text, cls + "+", ""))


def _majority_pairs(text: Column) -> Column:
    """Occurrences of the pair of neighbouring characters that more than half of all places hold (of some pair, if none)."""
    def pairs(chars):
        m = F.size(chars) - 1
        return F.zip_with(F.slice(chars, 1, m), F.slice(chars, 2, m), lambda a, b: F.concat(a, b))

    def times(ordered):  # one that more than half hold is in the middle
        middle = F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
        return once(middle, lambda x: F.size(ordered) - F.size(F.array_remove(ordered, x)))

    return once(characters(text), lambda chars: once(F.sort_array(pairs(chars)), times))


def is_katakana_sentence(text) -> Column:
    """True iff no hiragana, katakana share > 0.5 and none of the rejection rules.

    Branches are evaluated lazily (CASE WHEN), so the costly repetition checks
    only run on texts that already look like katakana. Empty text is False.
    """
    t = _c(text)
    n = F.length(t)
    kata = _class_count(t, KATAKANA_CLASS)
    hira = _class_count(t, HIRAGANA_CLASS)
    distinct_chars = F.size(F.array_distinct(characters(t)))
    # a pair at more than half of all places is one character twice, so half of all characters repeat the one before
    repeats = n - F.length(F.regexp_replace(t, r"(?s)(.)\1+", "$1"))
    return (
        F.when(n == 0, F.lit(False))
        .when(~((hira == 0) & (kata / n > 0.5)), F.lit(False))
        .when(n < 8, F.lit(False))
        .when((n < 10) & (F.substring(t, -2, 2).isin("？」", "！」")), F.lit(False))
        .when((n < 100) & (distinct_chars / n < 0.5), F.lit(False))
        .when(F.regexp_count(t, F.lit(r"(.)\1+")) / n > 0.1, F.lit(False))
        .when(F.regexp_count(t, F.lit(r"(..)ッ?\1")) / n > 0.1, F.lit(False))
        .when(repeats / n <= 0.5, F.lit(True))
        .when(_majority_pairs(t) / n > 0.5, F.lit(False))
        .otherwise(F.lit(True))
    )


_KATA_SRC = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRA_DST = "".join(chr(c) for c in range(0x3041, 0x3097))


def kata2hira(text) -> Column:
    """T4 (translation part): katakana U+30A1..30F6 -> hiragana U+3041..3096."""
    return F.translate(_c(text), _KATA_SRC, _HIRA_DST)


def kata2hira_if_katakana_sentence(text) -> Column:
    """T4: convert only paragraphs that T3 calls katakana sentences."""
    t = _c(text)
    return F.when(is_katakana_sentence(t), kata2hira(t)).otherwise(t)


# --- T5-T8: splitting ----------------------------------------------------------

def lines(text) -> Column:
    """Lines as Python's splitlines() gives them, empties kept (a final break adds one '')."""
    return F.split(_c(text), LINE_BREAK, -1)


def paragraphs(text) -> Column:
    """T5: non-empty lines, in order."""
    return F.filter(lines(text), lambda p: p != F.lit(""))


def sentences_ja(text) -> Column:
    """Newline after each '。', double newlines collapsed once, then lines."""
    t = F.replace(F.replace(_c(text), F.lit("。"), F.lit("。\n")), F.lit("\n\n"), F.lit("\n"))
    return lines(t)


def sentence_segment(text) -> Column:
    """Rule-based sentences (run of non-terminators plus its terminators), trimmed."""
    parts = F.transform(F.regexp_extract_all(_c(text), F.lit(SENTENCE), 0), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != F.lit(""))


def tokenize_ws(text) -> Column:
    """Whitespace split like Python's str.split()."""
    return F.regexp_extract_all(_c(text), F.lit(f"[^{WS_CHARS}]+"), 0)


# --- T9-T16: tokens ------------------------------------------------------------

def tokenize_word(text, lowercase: bool = True) -> Column:
    """letter/digit runs (the default analytical tokenizer)."""
    t = F.lower(_c(text)) if lowercase else _c(text)
    return F.regexp_extract_all(t, F.lit(WORD_TOKEN), 0)


def script_tokens_ja(text) -> Column:
    """Runs of one script class (kanji, hiragana, katakana, digits, latin)."""
    return F.regexp_extract_all(_c(text), F.lit(SCRIPT_RUN), 0)


def ws_token_filter(tokens) -> Column:
    """Drop tokens that are empty or whitespace only."""
    return F.filter(_c(tokens), lambda t: ~t.rlike(f"^[{WS_CHARS}]*$"))


def pos_filter(tagged, pos_set) -> Column:
    """Drop tagged tokens whose pos1 is in the set."""
    values = list(pos_set)
    if not values:
        return _c(tagged)
    arr = F.array(*[F.lit(v) for v in values])
    return F.filter(_c(tagged), lambda t: ~F.array_contains(arr, t["pos1"]))


def surface_filter(tokens, pattern: str | None) -> Column:
    """Drop tokens in which the pattern is found; blank pattern = no filter."""
    if not pattern:
        return _c(tokens)
    return F.filter(_c(tokens), lambda t: ~t.rlike(pattern))


def token_features(tagged, features) -> Column:
    """The selected features of each tagged token joined by '/'; none -> surface."""
    feats = list(features or [])

    def one(t):
        if not feats:
            return t["orth"]
        return F.concat_ws("/", *[F.coalesce(t[f], F.lit("")) for f in feats])

    return F.transform(_c(tagged), one)


def lemma_fallback(lemma, surface) -> Column:
    """Lemma, or the surface form when the lemma is unknown."""
    return F.coalesce(F.nullif(_c(lemma), F.lit("")), _c(surface))


def proper_noun_blank(tagged, use_lemma: bool = True) -> Column:
    """Proper nouns (pos2 = 固有名詞) become '' so positions stay aligned."""
    def one(t):
        word = lemma_fallback(t["lemma"], t["orth"]) if use_lemma else t["orth"]
        return F.when(t["pos2"] == F.lit("固有名詞"), F.lit("")).otherwise(word)

    return F.transform(_c(tagged), one)


def lowercase_by_lang(text, lang, japanese: str = "ja") -> Column:
    """Lower-case except for Japanese."""
    return F.when(_c(lang) == F.lit(japanese), _c(text)).otherwise(F.lower(_c(text)))


def ngrams(tokens, n_min: int = 1, n_max: int = 1) -> Column:
    """All n-grams for n in [n_min, n_max], tokens joined by a space.

    Built by zipping shifted slices, so each n costs one pass over the array
    (no per-position slicing of the whole array).
    """
    toks = _c(tokens)
    per_n = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            per_n.append(toks)
            continue
        m = F.greatest(F.size(toks) - n + 1, F.lit(0))
        grams = F.slice(toks, 1, m)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(toks, k + 1, m), lambda a, b: F.concat_ws(" ", a, b))
        per_n.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast("array<string>")))
    return per_n[0] if len(per_n) == 1 else F.concat(*per_n)


# --- T19-T22: small helpers --------------------------------------------------------

def strip_topic_prefix(label, topic) -> Column:
    """Remove '{topic}: ' only when it is a prefix."""
    lab = _c(label)
    prefix = F.concat(_c(topic).cast("string"), F.lit(": "))
    return F.when(lab.startswith(prefix), lab.substr(F.length(prefix) + 1, F.length(lab))).otherwise(lab)


def strip_think_tags(text) -> Column:
    """Remove <think> / </think> tags (not their content) and trim."""
    return F.trim(F.regexp_replace(_c(text), THINK_TAG, ""))


def split_fixed(arr, n: int) -> Column:
    """Cut an array into n-sized pieces (last may be shorter)."""
    a = _c(arr)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / F.lit(n)).cast("int") - 1, F.lit(0))),
                         lambda i: F.slice(a, i * n + 1, n))
    return F.when(F.size(a) > 0, pieces).otherwise(F.slice(F.array(a), 1, 0))
