"""Entities, key points and summaries of posting texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.constants import CHUNK_CHARS, KEY_POINT_LIMIT, SUMMARY_MAX_WORDS, SUMMARY_MIN_WORDS, WORD
from postlens.functions import text as X
from postlens.operators.phrases import NAMES, Names, listed_names, names_in_text, naming_sentences
from postlens.operators.scaling import broadcast_if_small, unrolled
from postlens.operators.terms import counted_rows, repeats, tfidf, vocabulary, weighed_lists

MONEY = r"[$€£₹]\s?\d+(?:[.,]\d+)*"
DATE = (
    r"\d{4}-\d{2}-\d{2}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4}"
    r"|\d{1,2}/\d{1,2}/\d{4}"
)
WORD_RUN = rf"[{WORD}]+"


def pattern_entities(text: Column, kind: str) -> Column:
    """Dates or amounts of a text in reading order."""
    pattern = {"DATE": DATE, "MONEY": MONEY}[kind]
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def phrase_rows(df: DataFrame, keys: list[str], text: str, longest: int) -> DataFrame:
    """``(keys, pos, phrase)``: every run of up to ``longest`` words."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"({WORD_RUN})"), 1)
    grown = df.select(*keys, found.alias("_w"))
    frames = [
        unrolled(grown, keys, X.ngrams(F.col("_w"), n), "pos", "phrase")
        for n in range(1, longest + 1)
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


KINDS = ("GPE", "ORG")


def names_of(gazetteer: DataFrame) -> DataFrame:
    """Distinct ``(phrase, kind)`` of places and organisations, their words parted by one blank.

    Rows of other kinds, and names without a word, take no part in either plan.
    """
    words = F.regexp_extract_all(F.col("phrase"), F.lit(f"({WORD_RUN})"), 1)
    named = gazetteer.where(F.col("kind").isin(*KINDS)).select(F.array_join(words, " ").alias("phrase"), "kind")
    return named.where(F.col("phrase") != "").distinct()


def short_names(gazetteer: DataFrame, longest: int | None) -> DataFrame:
    """Names of at most ``longest`` words, by default all."""
    names = names_of(gazetteer)
    return names if longest is None else names.where(F.size(F.split("phrase", " ")) <= longest)


def longest_name(names: DataFrame) -> int:
    """Words in the longest name; one row of one aggregate."""
    return names.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(1)).alias("n")).first()["n"]


def gazetteer_hits(df: DataFrame, keys: list[str], text: str, gazetteer: DataFrame, longest: int | None = None) -> DataFrame:
    """``(keys, pos, phrase, kind)``: phrases listed in ``gazetteer(phrase, kind)``.

    ``longest`` is the most words a phrase may have, by default those of the longest
    name. The list is broadcast only when counted small; otherwise the phrases are
    joined by shuffle, where AQE splits frequent phrases.
    """
    listed = names_of(gazetteer)
    longest = longest_name(listed) if longest is None else longest
    return phrase_rows(df, keys, text, longest).join(broadcast_if_small(listed), "phrase")


def no_strings() -> Column:
    return F.array().cast("array<string>")


def entities(df: DataFrame, key: str, gazetteer: DataFrame, text: str = "text", longest: int | None = None,
             limit: int = NAMES) -> DataFrame:
    """``(key, locations, organizations, dates, money)`` in reading order.

    Names are found by one automaton, in one pass per text without a shuffle, whatever
    their number and length. Only a list beyond ``limit`` names, too long to broadcast, is
    joined on the phrase; its lists stay within one text, so gathering is bounded.
    ``longest`` leaves out names of more words.
    """
    by_pattern = [pattern_entities(F.col(text), "DATE").alias("dates"), pattern_entities(F.col(text), "MONEY").alias("money")]
    names = listed_names(short_names(gazetteer, longest), limit)
    if names is not None:
        found = df.withColumn("_names", names_in_text(F.col(text), names, KINDS))
        return found.select(key, F.col("_names.GPE").alias("locations"), F.col("_names.ORG").alias("organizations"), *by_pattern)
    hits = gazetteer_hits(df, [key], text, gazetteer, longest)
    gathered = hits.groupBy(key).agg(*[
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "phrase")))),
            lambda h: h["phrase"],
        ).alias(name)
        for kind, name in (("GPE", "locations"), ("ORG", "organizations"))
    ])
    return df.select(key, *by_pattern).join(gathered, key, "left").select(
        key, F.coalesce("locations", no_strings()).alias("locations"),
        F.coalesce("organizations", no_strings()).alias("organizations"), "dates", "money",
    )


def named_sentences(text: Column, names: Names, limit: int = KEY_POINT_LIMIT) -> Column:
    """The first sentences that hold a listed name, a date or an amount."""
    return naming_sentences(text, names, f"{DATE}|{MONEY}", limit, X.SPACE_CHARS)


def key_points(df: DataFrame, key: str, gazetteer: DataFrame, text: str = "text",
               limit: int = KEY_POINT_LIMIT, longest: int | None = None, phrase_limit: int = NAMES) -> DataFrame:
    """``(key, rank, sentence)``: the first sentences that name an entity."""
    names = listed_names(short_names(gazetteer, longest), phrase_limit)
    if names is not None:
        points = df.select(key, named_sentences(F.col(text), names, limit).alias("_points"))
        return unrolled(points, [key], F.col("_points"), "_p", "sentence").select(key, (F.col("_p") + 1).alias("rank"), "sentence")
    cut = unrolled(df, [key], X.sentences(F.col(text)), "place", "sentence")
    named = gazetteer_hits(cut, [key, "place"], "sentence", gazetteer, longest).select(key, "place").distinct()
    by_pattern = cut.where(F.col("sentence").rlike(f"{DATE}|{MONEY}")).select(key, "place")
    marked = named.unionByName(by_pattern).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return cut.join(marked, [key, "place"], "left_semi").withColumn("rank", rank).where(
        F.col("rank") <= limit
    ).select(key, "rank", "sentence")


def lead_summary(text: Column, max_words: int = SUMMARY_MAX_WORDS, min_words: int = SUMMARY_MIN_WORDS,
                 width: int = CHUNK_CHARS) -> Column:
    """Chunk summaries of the whole text joined by a blank."""
    return F.array_join(
        F.filter(
            F.transform(X.chunks(text, width), lambda c: X.lead_summary(c, max_words, min_words)),
            lambda s: s != "",
        ),
        " ",
    )


def summarize(df: DataFrame, text: str = "text", summarizer: Callable[[Column], Column] = lead_summary) -> DataFrame:
    """Adds summary, its length, the original length and their ratio."""
    with_summary = df.withColumn("summary", summarizer(F.col(text)))
    return with_summary.withColumns({
        "original_length": F.length(text),
        "summary_length": F.length("summary"),
        "compression_ratio": X.compression_ratio(F.length("summary"), F.length(F.col(text))),
    })


def central_sentences(df: DataFrame, weights: DataFrame, key: str, text: str = "text",
                      width: int = CHUNK_CHARS) -> DataFrame:
    """``(key, summary)`` from the sentence of each chunk with the highest mean weight.

    ``weights`` is the TF-IDF table of the same texts. The join is on (key, term),
    so frequent words do not gather.
    """
    parts = unrolled(df, [key], X.chunks(F.col(text), width), "chunk", "_c")
    cut = unrolled(parts, [key, "chunk"], X.sentences(F.col("_c")), "place", "sentence")
    words = unrolled(cut, [key, "chunk", "place"], X.tokens(F.col("sentence")), "_i", "term")
    scored = words.join(weights.select(key, "term", "tfidf"), [key, "term"]).groupBy(key, "chunk", "place").agg(
        F.round(F.avg("tfidf"), 9).alias("score")
    )
    best = scored.groupBy(key, "chunk").agg(F.max(F.struct("score", (-F.col("place")).alias("p"))).alias("b"))
    picked = cut.join(best.select(key, "chunk", (-F.col("b.p")).alias("place")), [key, "chunk", "place"])
    return picked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "sentence"))).alias("s")).select(
        key, F.array_join(F.transform("s", lambda p: p["sentence"]), " ").alias("summary")
    )


def _mean_weights() -> Callable:
    """Mean weight of every sentence of every chunk; a sentence without a weighed word has none."""
    @F.arrow_udf("array<array<double>>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for words, terms in batches:
            out = []
            for chunks, own in zip(words, terms):
                weight = dict(zip(own.values.field("term").to_pylist(), own.values.field("tfidf").to_pylist()))
                means = []
                for sentences in chunks.as_py() or ():
                    found = [[weight[t] for t in s if t in weight] for s in sentences]
                    means.append([sum(f) / len(f) if f else None for f in found])
                out.append(means)
            yield pa.array(out, pa.list_(pa.list_(pa.float64())))

    return score


def central_texts(docs: DataFrame, key: str, text: str = "text", width: int = CHUNK_CHARS) -> DataFrame:
    """``(key, summary)`` from the sentence of each chunk with the highest mean TF-IDF weight.

    A text's weights, sentences and scores stay in its row. Rows that share a key go by the tables.
    """
    if repeats(docs, key):
        return central_sentences(docs, tfidf(docs, key, text), key, text, width)
    terms = vocabulary(counted_rows(docs, key, text), docs.agg(F.count("*").alias("n")))
    rows = weighed_lists(docs, terms, key, text, keep=[text])
    cut = rows.select(key, "_terms", F.transform(X.chunks(F.col(text), width), X.sentences).alias("_s"))
    words = F.transform("_s", lambda c: F.transform(c, X.tokens))
    scored = cut.select(key, "_s", _mean_weights()(words, F.col("_terms")).alias("_m"))

    def best(sentences: Column, means: Column) -> Column:
        ranked = F.transform(means, lambda m, i: F.when(m.isNotNull(), F.struct(F.round(m, 9).alias("m"), (-i).alias("p"))))
        return F.get(sentences, -F.array_max(ranked)["p"])

    picked = F.filter(F.zip_with("_s", "_m", best), lambda s: s.isNotNull())
    return scored.select(key, picked.alias("_p")).where(F.size("_p") > 0).select(key, F.array_join("_p", " ").alias("summary"))
