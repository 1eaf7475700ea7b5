"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinegraph.llm.common import words_of

#: Common function words of English, French, Spanish and German, then of Italian, Portuguese, Dutch,
#: Swedish and Danish, Polish, Czech, Romanian, Hungarian, Finnish, Turkish, Indonesian and Vietnamese.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au de des du elle en est et il la le les on ou par pas pour que qui un une "
    "con del el es esta las los no para por se su una y "
    "auf das dem den der die ein eine ist mit nicht sich sie und von zu "
    "che di non per sono della "
    "da em não uma com dos "
    "het een van voor niet zijn "
    "och att som det på av er til "
    "nie się jest na do że "
    "je se že by ale "
    "și cu pe din sau "
    "az és hogy egy nem "
    "ja ei että oli mutta "
    "ve bir bu için ile "
    "yang dan di itu dengan "
    "và của là có không"
).split()

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


#: The Unicode blocks of scripts that set no blanks between words, as a pattern that Java and RE2 share. Thai, Lao,
#: Tibetan, Burmese, Khmer; CJK signs, kana, bopomofo; Han with its extensions; full-width forms.
UNSPACED = r"\x{0E00}-\x{109F}\x{1780}-\x{17FF}\x{3000}-\x{312F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"

#: So many characters of these scripts count as one word where words are a denominator.
UNSPACED_WORD = 4

#: Characters in small letters, and function words, that every document is given besides its own: what a few words
#: happen to be proves little, and the more there are, the less these weigh.
SMALL_CHARS, FREE_STOPS = 100, 1


@dataclass(frozen=True)
class Rule:
    """A document passes when low <= metric <= high."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("n_words", low=10),
    Rule("repeat_ratio", high=0.2),
    Rule("mean_word_chars", low=1.5),
    Rule("mean_spaced_chars", high=25.0),
    Rule("longest_word_chars", high=20_000),
    Rule("symbol_ratio", high=0.1),
    Rule("shout_ratio", high=0.5),
    Rule("stop_ratio", low=0.005),
    Rule("dup_line_ratio", high=0.6),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus a struct column _q of counts and ratios of the whole text.

    A null or blank text has no words and ratios of 0. All work is per row, in built-in functions: linear in the
    text, but for one sort of its five-word windows.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    row = row.withColumns({"_w": words_of(F.col("_t")), "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w = F.col("_w")
    n = F.size("_w")
    row = row.withColumn("_g", F.array_sort(F.transform(F.slice("_w", F.lit(1), F.greatest(n - 4, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, *(F.get(w, i + k) for k in range(1, 5))).alias("h"), i.alias("p")))))
    g = F.col("_g")
    again = F.transform("_g", lambda s, i: F.when((F.get(g, i - 1)["h"] == s["h"]) | (F.get(g, i + 1)["h"] == s["h"]), s["p"]))
    row = row.withColumn("_p", F.array_sort(F.filter(again, lambda p: p.isNotNull())))
    covered = F.aggregate(F.zip_with(F.slice("_p", F.lit(2), F.greatest(F.size("_p") - 1, F.lit(0))), F.slice("_p", F.lit(1), F.greatest(F.size("_p") - 1, F.lit(0))), lambda b, a: F.least(F.lit(5), b - a)), F.lit(5), lambda s, x: s + x)
    unspaced = F.length(F.regexp_replace("_t", f"[^{UNSPACED}]+", ""))
    # Of texts with such characters, the words' others.
    longest = F.when(unspaced == 0, F.transform("_w", lambda x: F.length(x))).otherwise(F.transform("_w", lambda x: F.length(F.regexp_replace(x, f"[{UNSPACED}]+", ""))))
    counts = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size("_p") == 0, F.lit(0)).otherwise(covered).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_capitals": F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long"),
        "n_latin": F.length(F.regexp_replace("_t", "[^A-Za-z]+", "")).cast("long"),
        "n_stop": F.size(F.filter("_w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "n_unspaced": unspaced.cast("long"),
        "longest": F.coalesce(F.array_max(longest), F.lit(0)).cast("long"),
    }
    row = row.select("_row", F.struct(*(v.alias(k) for k, v in counts.items())).alias("_q"))
    return row


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def metrics(q: Column) -> dict[str, Column]:
    return {
        "n_words": q["n_words"],
        "repeat_ratio": ratio(q["n_repeat_words"], q["n_words"]),
        "mean_word_chars": ratio(q["word_chars"], q["n_words"]),
        "mean_spaced_chars": ratio(q["word_chars"] - q["n_unspaced"], q["n_words"]),
        "longest_word_chars": q["longest"],
        "symbol_ratio": ratio(q["n_symbols"], q["n_words"] + q["n_unspaced"] / UNSPACED_WORD),
        "shout_ratio": q["n_capitals"] / (q["word_chars"] + SMALL_CHARS),
        # To as many words as the text's share of Latin letters: the function words are of languages that use these.
        "stop_ratio": (q["n_stop"] + FREE_STOPS) * q["word_chars"] / F.greatest(q["n_words"] * q["n_latin"], F.lit(1)),
        "dup_line_ratio": ratio(q["n_dup_lines"], q["n_lines"]),
    }


def verdict(q: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether all rules hold, as one expression compiled from the table."""
    values, out = metrics(q), F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (values[r.metric] >= r.low)
        if r.high is not None:
            out = out & (values[r.metric] <= r.high)
    return out


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """_row (the document's own columns, whatever their names), _q (the counts), base_failed and kept for each row.

    Null, empty and blank texts fail; repeated rows are judged each for itself; an empty table gives none.
    """
    q = F.col("_q")
    return measures(docs, text).select("_row", "_q", base_failed(q).alias("base_failed"), (~base_failed(q) & verdict(q, rules)).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their own columns.

    inline() of one row or none, not a filter: the optimiser would copy a filter's expression below each projection.
    """
    return judge(docs, text, rules).select(F.inline(F.when(F.col("kept"), F.array("_row"))))
