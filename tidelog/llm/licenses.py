"""License scans over a positional index of rare licence words.

Templates (whole licences and notices) hold key phrases. A first pass counts in how many
files of the corpus each of the phrases' words stands; each phrase is then indexed by its
two words with the highest IDF. A second pass looks up where a file has such words: one
at ``pos`` that stands at ``off`` in a phrase lets the phrase begin at ``pos - off``. Starts
on which both words' postings agree are verified: every word of the phrase, common ones
too, has to stand at its place. A file has a template's label if all the template's
phrases are verified; what a phrase's words give is found at all places, so that the
phrases of ``BASE`` are counted by the same index.

``score``: 1 where a phrase of ``BASE`` stands; else the largest share, over the phrases
verified of the templates whose label the file has, of the template's words that stand
at their places around the phrase.

A file is judged from its own words and from counts of a few hundred words, so nothing is
shuffled but these counts.

Defined cases: null and empty texts have no words and no labels; texts of any length are
read whole; rows that repeat an id or a text are scanned one by one, so repeats give
repeats; words equally rare are taken in order of the alphabet; a null id is a file like
any other; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .license_texts import TEMPLATES

#: A run of ASCII letters and digits and of what lies beyond ASCII.
WORD = r"[\p{Alnum}\P{ASCII}]+"
#: Phrase and label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words by which a phrase is indexed (or all that it has).
ANCHORS = 2


def words_of(text: str) -> list[str]:
    """Of a template."""
    return re.findall("[a-z0-9]+", text.lower())


def _find(whole: list[str], part: list[str]) -> int:
    return next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)


def phrases_of(templates: tuple) -> tuple[list[tuple[str, ...]], list[tuple[str, list[str], dict[int, int]]]]:
    """The distinct phrases, those of BASE first, and of each template the label, the
    words, and where each of its phrases (by number) begins."""
    phrases = [tuple(p.split()) for p, _ in BASE]
    found = []
    for label, text, own in templates:
        words, at = words_of(text), {}
        for p in own:
            part = tuple(words_of(p))
            if part not in phrases:
                phrases.append(part)
            at[phrases.index(part)] = _find(words, list(part))
        found.append((label, words, at))
    return phrases, found


def _words(text_col: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), 0)


def _strings(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def document_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many files each word stands: a row for each word of the templates at most."""
    own = docs.select(_words(text_col).alias("words")).select(F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))).alias("own"))
    return {r["word"]: r["count"] for r in own.select(F.explode("own").alias("word")).groupBy("word").count().collect()}


def _index(anchors: list[tuple[str, int, int]]) -> Column:
    """Word -> its postings: (phrase, place within it)."""
    postings: dict[str, list[Column]] = {}
    for word, phrase, at in anchors:
        postings.setdefault(word, []).append(F.struct(F.lit(phrase).alias("phrase"), F.lit(at).alias("at")))
    return F.create_map(*(x for w, own in postings.items() for x in (F.lit(w), F.array(*own))))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_base, first_word, last_word, base_labels,
    labels, score."""
    phrases, found = phrases_of(templates)
    counts = document_counts(docs, sorted({w for p in phrases for w in p}), text_col)
    rarest = [sorted(set(p), key=lambda w: (counts.get(w, 0), w))[:ANCHORS] for p in phrases]
    first = [(own[0], n, i) for n, own in enumerate(rarest) for i, w in enumerate(phrases[n]) if w == own[0]]
    last = [(own[-1], n, i) for n, own in enumerate(rarest) for i, w in enumerate(phrases[n]) if w == own[-1]]

    texts = docs.select(F.col(id_col).alias("id"), _words(text_col).alias("words"))
    empty = F.array().cast("array<int>")

    def places(anchors: list[tuple[str, int, int]]) -> Column:
        own = sorted({w for w, _, _ in anchors})
        at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(own))
        return F.when(F.size("words") > 0, at).otherwise(empty)

    def starts(at: str, anchors: list[tuple[str, int, int]]) -> Column:
        index = _index(anchors)
        return F.flatten(F.transform(at, lambda i: F.transform(F.element_at(index, F.get("words", i)), lambda x: F.struct(x["phrase"].alias("phrase"), (i - x["at"]).alias("start")))))

    whole = F.array(*map(_strings, phrases))

    def stands(s: Column) -> Column:
        own = F.get(whole, s["phrase"])
        return (s["start"] >= 0) & (F.slice("words", F.greatest(s["start"], F.lit(0)) + 1, F.size(own)) == own)

    met = texts.select("id", "words", places(first).alias("at_first"), places(last).alias("at_last"))
    agreed = met.select("id", "words", F.array_intersect(starts("at_first", first), starts("at_last", last)).alias("agreed"))
    verified = agreed.select("id", "words", F.filter("agreed", stands).alias("verified"))

    base = F.filter("verified", lambda s: s["phrase"] < len(BASE))
    seen = F.array_distinct(F.transform("verified", lambda s: s["phrase"]))
    every = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, at)).alias("needs")) for n, (label, _, at) in enumerate(found)))
    has = F.filter(every, lambda t: F.size(F.array_except(t["needs"], "seen")) == 0)
    told = verified.select("id", "words", "verified", base.alias("base"), seen.alias("seen")).withColumn("has", F.when(F.size("seen") > 0, has).otherwise(F.filter(every, lambda t: F.lit(False))))

    # (template, phrase) -> the template's words and the phrase's place within them
    around = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(p).alias("phrase"), F.lit(at).alias("at"), _strings(words).alias("of")) for n, (_, words, own) in enumerate(found) for p, at in own.items()))

    def share(a: Column, s: Column) -> Column:
        from_ = s["start"] - a["at"]
        hits = F.filter(F.sequence(F.lit(0), F.size(a["of"]) - 1), lambda k: (from_ + k >= 0) & F.coalesce(F.get("words", F.greatest(from_ + k, F.lit(0))) == F.get(a["of"], k), F.lit(False)))
        return F.size(hits) / F.size(a["of"])

    held = lambda t: F.exists("has", lambda h: h["template"] == t)
    shares = F.flatten(F.transform(F.filter(around, lambda a: held(a["template"])), lambda a: F.transform(F.filter("verified", lambda s: s["phrase"] == a["phrase"]), lambda s: share(a, s))))
    out = told.withColumn("score", F.when(F.size("base") > 0, F.lit(1.0)).when(F.size("has") > 0, F.array_max(shares)).otherwise(F.lit(0.0)))
    names = F.array_sort(F.array_distinct(F.transform("base", lambda s: F.get(_strings([label for _, label in BASE]), s["phrase"]))))
    at = F.transform("base", lambda s: s["start"])
    return out.select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.transform("has", lambda h: h["label"]))), ",").alias("labels"),
        "score",
    )
