"""Words, sentences and text measures as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.chunk import sentences

#: Words that coherence leaves out.
FUNCTION_WORDS = (
    "the a an in on at to for of and or but is are was were be been being have has had do does did will would could should "
    "may might must can it its this that these those with by from as if then than so"
).split()
#: Terms that mark a domain's texts.
DOMAIN_TERMS = {
    "legal": "whereas hereinafter notwithstanding pursuant thereto indemnify covenant jurisdiction arbitration plaintiff defendant liability damages breach remedy statute".split(),
    "medical": "diagnosis prognosis etiology pathophysiology therapeutic contraindicated dosage symptom bilateral acute chronic clinical patient treatment medication procedure".split(),
    "financial": "revenue ebitda amortization depreciation liquidity solvency leverage portfolio yield basis derivative hedge variance forecast fiscal compliance audit".split(),
    "general": [],
}
#: Common words by language, for identification.
STOP_WORDS = {
    "en": "the of and to in is that for it as was with on by this at from are be or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un une du est que pour dans ce qui sur au par pas".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
    "it": "di che la il un per non una sono mi ho lo ha le si con cosa come da ma".split(),
    "pt": "de que e do da em um para com não uma os no se na por mais as dos como".split(),
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor".split(),
    "pl": "i w nie na się z do to że a o jak ale po co tak za od jest przez".split(),
}


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+", -1), lambda w: w != "")


def latin_words(text: Column) -> Column:
    """Distinct lower-case words of three or more letters a-z that touch no other word character.

    Other letters are first replaced by a digit, which is a word character but no letter, so engines agree on boundaries.
    """
    seen = F.regexp_replace(F.regexp_replace(F.lower(text), r"[\p{L}\p{M}&&[^\x00-\x7F]]", "0"), r"[^\x00-\x7F]", " ")
    return F.array_distinct(F.regexp_extract_all(seen, F.lit(r"\b[a-z]{3,}\b"), F.lit(0)))


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, where the optimizer would repeat its expression in every place of use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def coherence(text: Column) -> Column:
    """0.3 + 2.3 x mean overlap of neighbouring sentences' content words, at most 1; 1 for under two sentences, 0.7 where none compare."""
    function_words = F.array(*[F.lit(w) for w in FUNCTION_WORDS])

    def of_sets(sets):
        n = F.greatest(F.size(sets) - 1, F.lit(0))
        overlaps = F.filter(F.zip_with(F.slice(sets, F.lit(1), n), F.slice(sets, F.lit(2), n), lambda a, b: F.when((F.size(a) > 0) & (F.size(b) > 0), jaccard(a, b))), lambda x: x.isNotNull())
        score = lambda o: F.when(F.size(o) == 0, 0.7).otherwise(F.least(F.lit(1.0), 0.3 + F.aggregate(o, F.lit(0.0), lambda a, x: a + x) / F.size(o) * 2.3))
        return F.when(F.size(sets) < 2, 1.0).otherwise(let(overlaps, score))

    return let(F.transform(sentences(text), lambda x: F.array_except(latin_words(x), function_words)), of_sets)


def syllables(word: Column) -> Column:
    w = F.lower(word)
    n = F.size(F.regexp_extract_all(w, F.lit("[aeiouy]+"), F.lit(0)))
    n = n - F.when(F.endswith(w, F.lit("e")) & (n > 1), 1).otherwise(0) + F.when(F.endswith(w, F.lit("le")) & (F.length(w) > 2) & ~F.substring(w, -3, 1).isin(*"aeiouy"), 1).otherwise(0)
    return F.greatest(F.lit(1), n)


def fluency_of(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    asl = n_words / n_sentences
    ease = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (206.835 - 1.015 * asl - 84.6 * (n_syllables / n_words)) / 100.0))
    off = F.when(asl > 50, F.least(F.lit(0.3), (asl - 50) / 100.0)).when(asl < 5, 0.2).otherwise(0.0)
    return F.when((n_words == 0) | (n_sentences == 0), 0.0).otherwise(F.greatest(F.lit(0.3), F.greatest(F.lit(0.0), ease - off)))


def fluency(text: Column) -> Column:
    return let(words(text), lambda w: fluency_of(F.size(w), F.size(sentences(text)), F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))))


def domain_quality(text: Column, domain: str) -> Column:
    terms = DOMAIN_TERMS.get(domain, [])
    if not terms:
        return F.lit(0.75)
    w = words(F.lower(text))
    hits = F.size(F.filter(w, lambda x: x.isin(*terms)))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(1.0), hits / F.size(w) / 0.01)))


def _over_runs(sorted_values: Column, term) -> Column:
    """Sum of term(run length) over the runs of equal values of a sorted array."""
    start = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a, x):
        same = a["prev"].eqNullSafe(x)
        done = F.when(same | (a["run"] == 0), a["sum"]).otherwise(a["sum"] + term(a["run"]))
        return F.struct(x.alias("prev"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), done.alias("sum"))

    return F.aggregate(sorted_values, start, step, lambda a: F.when(a["run"] == 0, a["sum"]).otherwise(a["sum"] + term(a["run"])))


def perplexity(text: Column) -> Column:
    """Of the text's own smoothed bigrams; 50 for under three tokens, at most 1000.

    The mean log probability is a sum over runs of the sorted bigrams less one over runs of the sorted first words, so each
    text is done in its row: O(n log n), no exploding and no shuffle.
    """

    def of(w):
        n = F.size(w) - 1
        firsts = F.slice(w, F.lit(1), F.greatest(n, F.lit(0)))
        pairs = F.zip_with(firsts, F.slice(w, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws("\x01", a, b))
        seen = _over_runs(F.array_sort(pairs), lambda c: c * F.log(c + F.lit(1.0)))
        given = let(F.size(F.array_distinct(firsts)), lambda v: _over_runs(F.array_sort(firsts), lambda c: c * F.log(c + v + F.lit(0.0))))
        return F.when(F.size(w) < 3, 50.0).otherwise(F.least(F.lit(1000.0), F.exp((given - seen) / n)))

    return let(tokens(F.lower(text)), of)


def detect_language(text: Column) -> Column:
    """The language with most common words in the text; ties in the order of STOP_WORDS, none at all: English."""
    rows = lambda w: F.array(*[F.struct(_hits(w, v).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(STOP_WORDS.items())])
    return F.array_max(let(words(F.lower(text)), rows))["lang"]


def _hits(w: Column, stop: list[str]) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(*stop)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors within [0, 1]; 0.5 where a vector is missing."""
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b))))


def overall(semantic: Column, coherent: Column, fluent: Column, domain: Column) -> Column:
    return 0.40 * semantic + 0.25 * coherent + 0.20 * fluent + 0.15 * domain


def passes(semantic: Column, coherent: Column, fluent: Column) -> Column:
    return (semantic >= 0.65) & (coherent >= 0.60) & (fluent >= 0.55)
