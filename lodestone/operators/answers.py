"""Routes of questions, and citations of answers: ranges, checks, and attaching them to sentences. All in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.numbers import let
from lodestone.operators.entities import cut, entities
from lodestone.operators.search import tokens

#: Routes and the wording that calls for them, primary ones first.
ROUTES = {
    "compare": r"(?i)\b(?:compare|differences?|what changed|changed between|versus|vs|redline|amended|(?:older|newer) version)\b",
    "table": r"(?i)\b(?:total|sum|average|how many|how much|highest|lowest|largest|smallest|most|least|count)\b",
    "image": r"(?i)\b(?:photos?|photographs?|images?|pictures?|screenshots?|scans?|diagrams?|figures?|charts?|drawings?|looks like)\b",
    "entity": r"(?i)\b(?:relate[sd]? to|linked to|connected to|associated with|everything about|who is|belongs? to|which (?:vendor|supplier|company|client|person))\b",
    "keyword": r"\"[^\"]+\"|\b[A-Z]{2,6}\b|\b[A-Z]{1,4}[- ]?[0-9]{2,6}\b|(?i:\b(?:what does|what is|meaning of|define|explain)\b)",
}
CITED, RANGE = r"\[([0-9]+(?:\s*,\s*[0-9]+)*)\]", r"\[([0-9]{1,9})\s*[-–]\s*([0-9]{1,9})\]"
#: A wider range counts as its first number; what a fact weighs; the least scores with facts and without.
WIDEST, FACT, LEAST, LEAST_PLAIN = 8, 1.5, 1.5, 0.55
#: Words that tell nothing of what a sentence is about.
STOP = ("the", "and", "for", "are", "was", "were", "with", "that", "this", "from", "has", "have", "had", "not", "but", "you", "its", "their", "which", "will", "shall", "can", "may", "any", "all", "per", "into", "than", "then")


def routes(question: Column, has_image: Column | None = None) -> Column:
    """array<string>: the routes of a question, primary ones first. A null question is blank.

    Meaning-based search is always among them but for a pure image search.
    """
    question = F.coalesce(question, F.lit(""))
    found = F.array_compact(F.array(*[F.when(question.rlike(p), F.lit(r)) for r, p in ROUTES.items()]))
    if has_image is not None:
        found = F.when(F.coalesce(has_image, F.lit(False)), F.array_union(found, F.array(F.lit("image"), F.lit("multimodal")))).otherwise(found)
    only_image = (F.size(found) > 0) & (F.size(F.array_except(found, F.array(F.lit("image"), F.lit("multimodal")))) == 0)
    return F.when(only_image, found).otherwise(F.array_append(found, F.lit("semantic")))


def primary(found: Column) -> Column:
    """The route that leads: compare, table, image or entity, in that order, else semantic."""
    return F.coalesce(*[F.when(F.array_contains(found, r), F.lit(r)) for r in ("compare", "table", "image", "entity")], F.lit("semantic"))


def _replaced(text: Column, pattern: str, with_what: Column) -> Column:
    """The text with its matches replaced, in order, by the strings of an array."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), with_what, lambda between, new: F.concat(between, F.coalesce(new, F.lit("")))), "")


def _marks(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")


def expand_ranges(text: Column) -> Column:
    """``[1-3]`` as ``[1][2][3]``; one that falls, or spans more than WIDEST, as its first number."""
    low, high = (F.transform(F.regexp_extract_all(text, F.lit(RANGE), F.lit(i)), lambda x: x.cast("long")) for i in (1, 2))
    return _replaced(text, RANGE, F.zip_with(low, high, lambda a, b: _marks(F.when((a <= b) & (b - a <= WIDEST), F.sequence(a, F.greatest(a, F.least(b, a + WIDEST)))).otherwise(F.array(a)))))


def _numbers(cited: Column) -> Column:
    return F.transform(F.split(cited, r"\s*,\s*"), lambda x: x.try_cast("long"))


def check_citations(text: Column, n_sources: Column) -> Column:
    """struct<text, valid, invalid>: the text without citations of sources that aren't there, and the distinct numbers of both."""
    groups = F.transform(F.regexp_extract_all(text, F.lit(CITED), F.lit(1)), _numbers)
    there = lambda n: F.coalesce(n.between(F.lit(1), n_sources), F.lit(False))
    clean = _replaced(text, CITED, F.transform(groups, lambda g: _marks(F.filter(g, there))))
    clean = F.btrim(F.regexp_replace(clean, r"[ \t]+([.,;:])", "$1"))
    every = F.array_distinct(F.flatten(groups))
    return F.struct(clean.alias("text"), F.filter(every, there).alias("valid"), F.filter(every, lambda n: ~there(n)).alias("invalid"))


def _content(text: Column) -> Column:
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP)))


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def attach_citations(answer: Column, sources: Column) -> Column:
    """struct<text, dropped>: the answer with a citation for each sentence, by the place of its source in ``sources``.

    A sentence that cites already stays as it is. Else the best source, the first of equals, is one that holds its
    facts and shares its words. A sentence without such a source is dropped if it states facts or has more than four
    content words. Null texts count as empty; without sources the answer stays as it is. What is named more than once
    is worked out once: the sources for an answer, facts and words for a sentence, its best source.
    """
    answer, none = F.coalesce(answer, F.lit("")), F.array().cast("array<string>")
    known = F.transform(F.coalesce(sources, none), lambda s: let(F.coalesce(s, F.lit("")), lambda t: F.struct(_content(t).alias("words"), _letters(t).alias("letters"))))

    def kept(sentence: Column, facts: Column, words: Column, known: Column) -> Column:
        def score(s: Column, i: Column) -> Column:
            hits = F.size(F.filter(facts, lambda f: s["letters"].contains(f)))
            shared = F.size(F.array_intersect(words, s["words"])) / F.greatest(F.lit(3), F.size(words))
            return F.struct((hits * FACT + shared).alias("score"), (-i).alias("place"))

        def chosen(best: Column) -> Column:
            fits = (best["score"] >= LEAST) | ((F.size(facts) == 0) & (best["score"] >= LEAST_PLAIN))
            cited = F.concat(sentence, F.lit(" ["), (1 - best["place"]).cast("string"), F.lit("]"))
            return F.when(fits, cited).when((F.size(facts) == 0) & (F.size(words) <= 4), sentence)

        return let(F.array_max(F.transform(known, score)), chosen)

    def judged(sentence: Column, known: Column) -> Column:
        said = F.struct(F.transform(entities(sentence), lambda e: _letters(e["value"])).alias("facts"), _content(sentence).alias("words"))
        found = let(said, lambda x: kept(sentence, x["facts"], x["words"], known))
        return F.struct(sentence.alias("sentence"), F.when(sentence.contains("["), sentence).otherwise(found).alias("kept"))

    def joined(parts: Column) -> Column:
        text = F.array_join(F.array_compact(F.transform(parts, lambda p: p["kept"])), " ")
        dropped = F.transform(F.filter(parts, lambda p: p["kept"].isNull()), lambda p: p["sentence"])
        return F.struct(text.alias("text"), dropped.alias("dropped"))

    def attached(both: Column) -> Column:
        parts = F.transform(F.filter(cut(both["answer"], r"(?<=[.!?])\s+"), lambda s: F.btrim(s) != ""), lambda s: judged(s, both["known"]))
        return F.when(F.size(both["known"]) == 0, F.struct(both["answer"].alias("text"), none.alias("dropped"))).otherwise(let(parts, joined))

    return let(F.struct(answer.alias("answer"), known.alias("known")), attached)
