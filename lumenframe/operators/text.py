"""Text: tokens, counts, tf-idf, similarity, sentiment, stemming."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import scalar as S

#: Stop words.
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "can't", "cannot", "could",
    "couldn't", "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "get", "got", "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he", "her", "here", "hers",
    "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "just", "let's", "me", "might", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of", "off", "on", "once",
    "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shan't", "she", "should", "shouldn't", "so", "some", "such", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "were", "weren't", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "won't", "would", "wouldn't", "you",
    "your", "yours", "yourself", "yourselves", "also", "back", "even", "first", "go", "going", "good", "great", "know", "like", "look", "make", "much", "new", "now", "old", "one", "people", "really", "right", "say", "see", "still", "take",
    "tell", "think", "time", "two", "us", "use", "want", "way", "well", "work",
)
#: Words of the sentiment lexicon.
POSITIVE = (
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "awesome", "love", "happy", "joy", "beautiful", "brilliant", "best", "perfect", "superb", "outstanding", "magnificent", "delightful", "impressive", "marvelous",
    "terrific", "splendid", "fabulous", "pleasant", "nice", "fine", "enjoy", "glad", "pleased", "thankful", "grateful", "exciting", "positive", "success", "win", "winning", "triumph", "celebrate", "cheerful", "bright", "warm", "kind",
    "generous", "helpful", "clever", "strong", "powerful", "calm", "peaceful", "comfortable",
)
NEGATIVE = (
    "bad", "terrible", "horrible", "awful", "worst", "hate", "ugly", "disgusting", "dreadful", "poor", "sad", "angry", "miserable", "painful", "unhappy", "disappointing", "failure", "fail", "wrong", "broken", "weak", "useless", "annoying",
    "boring", "stupid", "ridiculous", "pathetic", "lousy", "nasty", "rude", "cruel", "harsh", "toxic", "negative", "disaster", "catastrophe", "tragic", "depressing", "hopeless", "fearful", "worried", "anxious", "stress", "frustrating",
    "confused", "lost", "lonely", "empty", "dark", "cold",
)


def tokens(df: DataFrame, text: str, name: str = "tokens") -> DataFrame:
    """df with the lower-cased runs of letters and digits of a text; none for null."""
    return df.withColumn(name, S.words(F.lower(F.coalesce(text, F.lit("")))))


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, n): the sparse term-count matrix. Counted within a map task first."""
    return tokens(df.select(key, text), text).select(key, F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def remove_stopwords(column: str):
    """Tokens that aren't stop words, in whatever case."""
    return F.filter(column, lambda t: ~F.lower(t).isin(*STOPWORDS))


def is_stopword(column):
    return F.lower(column).isin(*STOPWORDS)


def whitespace_tokens(column):
    """What stands between runs of white space."""
    return F.filter(F.split(column, r"\s+"), lambda t: t != "")


def char_tokens(column):
    """The characters of a text."""
    return F.filter(F.split(column, ""), lambda t: t != "")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def tfidf(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): n * (ln((1 + documents) / (1 + df)) + 1), each document scaled to length 1.

    The number of documents counts those without tokens. Frequent tokens are a join key with as many rows as they have
    documents, which adaptive execution splits. Counts are made once: both uses of them read one shuffle.
    """
    counts = token_counts(df, key, text)
    one = df.agg(F.count(F.lit(1)).alias("_all"))
    w = counts.join(document_frequency(counts), "token").crossJoin(F.broadcast(one))
    w = w.withColumn("w", F.col("n") * (F.log((1 + F.col("_all")) / (1 + F.col("df"))) + 1)).select(key, "token", "w")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "token", (F.col("w") / length).alias("weight"))


def sentiment(df: DataFrame, text: str) -> DataFrame:
    """df with positive, negative (tokens of the lexicon) and score: their difference over their sum, 0 without any."""
    t = tokens(df, text, "_t")
    count = lambda words: F.size(F.filter("_t", lambda x: x.isin(*words))).cast("long")
    t = t.withColumn("positive", count(POSITIVE)).withColumn("negative", count(NEGATIVE)).drop("_t")
    both = F.col("positive") + F.col("negative")
    return t.withColumn("score", F.when(both == 0, F.lit(0.0)).otherwise((F.col("positive") - F.col("negative")) / F.greatest(both, F.lit(1))))


def pad(column: str, size: int, value: str = ""):
    """An array cut or filled to a size."""
    return F.slice(F.concat(F.col(column), F.array_repeat(F.lit(value), size)), 1, size)


def gazetteer(df: DataFrame, text: str, entries: dict[str, str], patterns: dict[str, str] | None = None) -> DataFrame:
    """df with entities array<struct<text, kind>>: listed names and matches of patterns."""
    name = "|".join(sorted(map(_quoted, entries), key=len, reverse=True))
    kinds = F.create_map(*[F.lit(x) for e in entries.items() for x in e])
    found = [F.transform(F.regexp_extract_all(text, F.lit(rf"\b({name})\b"), F.lit(1)), lambda x: F.struct(x.alias("text"), kinds[x].alias("kind")))] if entries else []

    def matches(kind: str, pattern: str):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind")))

    found += [matches(k, p) for k, p in (patterns or {}).items()]
    return df.withColumn("entities", F.concat(*found))


def _quoted(x: str) -> str:
    import re

    return re.escape(x)


def best_similar(df: DataFrame, key: str, text: str, block: Sequence[str]) -> DataFrame:
    """Each row against the first row of its block: (key, first, jaccard of token sets, edit similarity of the first tokens)."""
    rows = tokens(df.select(key, *block, text), text).select(key, *block, F.array_distinct("tokens").alias("t"))
    first = rows.groupBy(*block).agg(F.min(F.struct(key, "t")).alias("f"))
    joined = rows.join(first, list(block)).filter(F.col(key) != F.col(f"f.{key}"))
    return joined.select(key, F.col(f"f.{key}").alias("first"), S.jaccard(F.col("t"), F.col("f.t")).alias("jaccard"), S.edit_similarity(F.array_join(F.slice("t", 1, 5), " "), F.array_join(F.slice("f.t", 1, 5), " ")).alias("edit"))


_VOWELS = "aeiou"


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(w: str) -> int:
    """Vowel-consonant changes."""
    kinds = [_vowel(w, i) for i in range(len(w))]
    return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 3) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 1) and w[-1] not in "wxy"


#: Endings of the Porter algorithm's second, third and fourth steps.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def stem(w: str) -> str:
    """The Porter stem of a lower-case word."""
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    again = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            root = w[: len(w) - len(end)]
            if _measure(root) > 1 and (end != "ion" or root.endswith(("s", "t"))):
                w = root
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def stems(counts: DataFrame) -> DataFrame:
    """(token, stem) of the distinct tokens of a count matrix; Python sees each word once."""

    @F.pandas_udf("string")
    def apply(x: pd.Series) -> pd.Series:
        return x.map(stem)

    return counts.select("token").distinct().withColumn("stem", apply("token"))


def wordpieces(df: DataFrame, text: str, vocabulary: Sequence[str], unknown: str = "[UNK]", name: str = "pieces") -> DataFrame:
    """df with the longest pieces first of each lower-cased word; a word's later pieces are listed with ##. Words that can't be
    cut are unknown. Distinct words are cut once a batch."""
    known = df.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def pieces(word: str) -> list[str]:
        out, at, have = [], 0, known.value
        while at < len(word):
            end = len(word)
            while end > at and (("##" if at else "") + word[at:end]) not in have:
                end -= 1
            if end == at:
                return [unknown]
            out.append(("##" if at else "") + word[at:end])
            at = end
        return out

    @F.pandas_udf("array<string>")
    def apply(lists: pd.Series) -> pd.Series:
        seen: dict[str, list[str]] = {}
        return lists.map(lambda ws: [p for w in ws for p in (seen[w] if w in seen else seen.setdefault(w, pieces(w)))])

    return tokens(df, text, "_w").withColumn(name, apply("_w")).drop("_w")


def fit_tagger(tagged: DataFrame, sentence: str, position: str, word: str, tag: str, smooth: float = 0.1) -> dict:
    """Log probabilities of a hidden Markov tagger: counts of first tags, tag pairs and (tag, word), smoothed. The counts are
    aggregates; the model has a row a distinct (tag, word)."""
    import math

    from pyspark.sql import Window

    rows = tagged.withColumn("_before", F.lag(tag).over(Window.partitionBy(sentence).orderBy(position)))
    pairs = {(r["_before"], r[tag]): r["n"] for r in rows.groupBy("_before", tag).agg(F.count(F.lit(1)).alias("n")).collect()}
    emitted = {(r[tag], r["w"]): r["n"] for r in rows.groupBy(tag, F.lower(word).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    tags, words_ = sorted({t for _, t in pairs}), len({w for _, w in emitted})
    out: dict = {"tags": tags, "step": {}, "word": {}, "other": {}}
    for before in [None, *tags]:
        total = sum(n for (b, _), n in pairs.items() if b == before)
        out["step"][before] = {t: math.log((pairs.get((before, t), 0) + smooth) / (total + smooth * len(tags))) for t in tags}
    for t in tags:
        total = sum(n for (a, _), n in emitted.items() if a == t)
        out["other"][t] = math.log(smooth / (total + smooth * (words_ + 1)))
        out["word"][t] = {w: math.log((n + smooth) / (total + smooth * (words_ + 1))) for (a, w), n in emitted.items() if a == t}
    return out


def best_tags(words_: Sequence[str], model: dict) -> list[str]:
    """The likeliest tags of a sentence, by Viterbi."""
    if not words_:
        return []
    see = lambda t, w: model["word"][t].get(w.lower(), model["other"][t])
    score = {t: model["step"][None][t] + see(t, words_[0]) for t in model["tags"]}
    back = []
    for w in words_[1:]:
        best = {t: max(model["tags"], key=lambda b, t=t: (score[b] + model["step"][b][t], b)) for t in model["tags"]}
        score = {t: score[best[t]] + model["step"][best[t]][t] + see(t, w) for t in model["tags"]}
        back.append(best)
    out = [max(model["tags"], key=lambda t: (score[t], t))]
    for best in reversed(back):
        out.append(best[out[-1]])
    return out[::-1]


def tag(df: DataFrame, column: str, model: dict, name: str = "tags") -> DataFrame:
    """df with the tags of each array of words."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def apply(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: best_tags(list(ws), shared.value))

    return df.withColumn(name, apply(column))
