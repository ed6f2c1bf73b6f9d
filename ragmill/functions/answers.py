"""Answer normalisation and scores for visual question answering, and needle scores for long contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let
from .text import words

# Fixed values of the metric: the marks, number words, articles and contractions that every implementation must share.
MARKS = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
NUMBER_WORDS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
ARTICLES = ["a", "an", "the"]
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've", "couldnt've": "couldn't've",
    "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've", "hadn'tve": "hadn't've", "hasnt": "hasn't",
    "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've", "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's",
    "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've", "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll",
    "let's": "let's", "maam": "ma'am", "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've",
    "mustnt": "mustn't", "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's", "shouldve": "should've",
    "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've", "somebody'd": "somebodyd", "somebodyd've": "somebody'd've",
    "somebody'dve": "somebody'd've", "somebodyll": "somebody'll", "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've",
    "someone'dve": "someone'd've", "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've",
    "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've", "they'dve": "they'd've",
    "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't", "wed've": "we'd've", "we'dve": "we'd've",
    "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're", "whats": "what's", "whatve": "what've", "whens": "when's",
    "whered": "where'd", "wheres": "where's", "whereve": "where've", "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll",
    "whos": "who's", "whove": "who've", "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've",
    "wouldnt": "wouldn't", "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've", "you'dve": "you'd've",
    "youll": "you'll", "youre": "you're", "youve": "you've",
}


def _literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def strip_marks(text: Column) -> Column:
    """Marks beside a space (or all, in a text with a number like 1,000) go, others become spaces; then up to 32 periods that no
    digit follows go."""

    def by_mark(original: Column) -> Column:
        out, thousands = original, F.regexp_like(original, F.lit(r"\d,\d"))
        for m in MARKS:
            beside = F.contains(original, F.lit(m + " ")) | F.contains(original, F.lit(" " + m)) | thousands
            out = F.replace(out, F.lit(m), F.when(beside, "").otherwise(" "))
        return out

    def periods(t: Column) -> Column:
        return F.array_join(F.split(t, r"\.(?!\d)", 33), "")

    return let(let(text, by_mark), periods)


def fold_words(text: Column) -> Column:
    """Lower case, number words as digits, no articles, contractions written out."""

    def known(table: dict[str, str]) -> Callable[[Column], Column]:
        """Few words are in a table: they are told by a set, so that the others are not looked up in a map, entry by entry."""
        return lambda w: F.when(w.isin(list(table)), F.try_element_at(_literal_map(table), w)).otherwise(w)

    digits, spelled = known(NUMBER_WORDS), known(CONTRACTIONS)
    kept = F.filter(F.transform(words(F.lower(text)), digits), lambda w: ~w.isin(ARTICLES))
    return F.array_join(F.transform(kept, spelled), " ")


def flat(text: Column) -> Column:
    return F.trim(F.translate(text, "\n\t", "  "))


def normalize_answer(text: Column) -> Column:
    return fold_words(strip_marks(flat(text)))


def consensus(prediction: Column, answers: Column) -> Column:
    """Mean over gold answers of min(1, matches among the others / 3). Answers are normalised only if they differ.

    answers is an array of strings, each its own annotation.
    """
    plain = F.transform(answers, flat)

    def score(golds: Column) -> Column:
        differ = F.size(F.array_distinct(golds)) > 1
        own = F.when(differ, F.transform(golds, lambda g: fold_words(strip_marks(g)))).otherwise(golds)
        guess = F.when(differ, normalize_answer(prediction)).otherwise(flat(prediction))

        def mean(pair: Column) -> Column:
            hits = F.size(F.filter(pair["own"], lambda g: g == pair["guess"]))
            each = F.transform(pair["own"], lambda g: F.least(F.lit(1.0), (hits - F.when(g == pair["guess"], 1).otherwise(0)) / F.lit(3.0)))
            return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(each)

        return let(F.struct(own.alias("own"), guess.alias("guess")), mean)

    return let(plain, score)


def contains_any(text: Column, answers: Column) -> Column:
    """Some answer is in the text, case ignored."""
    return let(F.lower(text), lambda t: F.exists(answers, lambda a: F.contains(t, F.lower(a))))


def _plain(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?U)\s+", " "))


def needle_score(response: Column, needle: Column) -> Column:
    """10 if the needle is in the response; else 8, 5, 3 or 1 by the share of its words found (0.8, 0.5, 0.2)."""

    def by_words(p: Column) -> Column:
        n, r = F.array_distinct(words(p["n"])), words(p["r"])
        share = F.size(F.array_intersect(n, r)) / F.greatest(F.size(n), F.lit(1))
        none = F.coalesce(response == "", F.lit(True)) | (p["n"] == "")
        return F.when(none, 1).when(F.contains(p["r"], p["n"]), 10).when(share >= 0.8, 8).when(share >= 0.5, 5).when(share >= 0.2, 3).otherwise(1)

    return let(F.struct(F.coalesce(F.trim(_plain(needle)), F.lit("")).alias("n"), F.coalesce(_plain(response), F.lit("")).alias("r")), by_words)


def needles_score(response: Column, needles: Column) -> Column:
    """10 for all needles, 1 for none, else 1 + 8 * found / all, rounded half to even."""
    plain = F.filter(F.transform(needles, lambda n: F.trim(_plain(n))), lambda n: n != "")

    def score(p: Column) -> Column:
        found, n = F.size(F.filter(p["n"], lambda x: F.contains(p["r"], x))), F.size(p["n"])
        return F.when((n == 0) | (p["r"] == "") | (found == 0), 1).when(found == n, 10).otherwise((1 + F.bround(8 * found / n)).cast("int"))

    return let(F.struct(plain.alias("n"), F.coalesce(_plain(response), F.lit("")).alias("r")), score)
