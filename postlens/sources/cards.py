"""Listing cards of stored pages to rows, from a declared card layout."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from postlens.constants import NOT_AVAILABLE, NOT_MENTIONED, NOT_SPECIFIED
from postlens.functions.parse import experience_compact, salary_lakh
from postlens.sources.tree import Element, parse_html


@dataclass(frozen=True)
class Field:
    """Where a value is found; without a default its absence drops the card."""

    name: str
    tag: str | None
    cls: str | None
    default: str | None = None


@dataclass(frozen=True)
class CardLayout:
    tag: str | None
    cls: str | None
    fields: tuple[Field, ...] = field(default_factory=tuple)
    # True strips every text piece before joining, False strips the joined text
    strip_pieces: bool = False


# fixed values: card layouts of the known listing pages
JOB_POST = CardLayout("div", "job-post", (
    Field("title", "h2", "job-title", NOT_AVAILABLE),
    Field("company", "span", "company-name", NOT_AVAILABLE),
    Field("location", "span", "location", NOT_AVAILABLE),
    Field("description", "div", "job-description", NOT_AVAILABLE),
), strip_pieces=True)
JOB_POST_STRICT = CardLayout(None, "job-post", (
    Field("title", None, "job-title"),
    Field("company", None, "company-name"),
    Field("location", None, "location"),
    Field("description", None, "job-description"),
))
JOB_TUPLE = CardLayout("article", "jobTuple", (
    Field("title", "a", "title"),
    Field("company", "a", "subTitle"),
    Field("description", "div", "job-description"),
    Field("salary", "span", "salary"),
    Field("experience", "span", "experience"),
))
JOB_BEACON = CardLayout("div", "job_seen_beacon", (
    Field("title", "h2", "jobTitle"),
    Field("company", "span", "companyName"),
    Field("description", "div", "job-snippet"),
    Field("salary", "div", "salary-snippet", NOT_SPECIFIED),
    Field("experience", "div", "experience-snippet", NOT_SPECIFIED),
))
JOB_CARD = CardLayout(None, "JobCard", (
    Field("title", None, "JobCard_jobTitle__1X30I", NOT_MENTIONED),
    Field("company", None, "JobCard_companyName__3d0VI", NOT_MENTIONED),
    Field("location", None, "JobCard_location__3Ctnr", NOT_MENTIONED),
    Field("salary", None, "JobCard_salary__2oZp2", NOT_MENTIONED),
    Field("description", None, "JobCard_description__2X30I", ""),
))


def _text(node: Element, strip_pieces: bool) -> str:
    if strip_pieces:
        return "".join(piece.strip() for piece in node.strings())
    return "".join(node.strings()).strip()


def page_cards(html: str, layout: CardLayout) -> Iterator[list[str]]:
    """Field values of every complete card of one page, in document order."""
    for card in parse_html(html).elements():
        if not card.matches(layout.tag, layout.cls):
            continue
        values = []
        for spec in layout.fields:
            found = next((n for n in card.elements() if n.matches(spec.tag, spec.cls)), None)
            value = spec.default if found is None else _text(found, layout.strip_pieces)
            if value is None:
                break
            values.append(value)
        else:
            yield values


def html_cards(pages: DataFrame, layout: CardLayout, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, card, <fields>)``; a page gives no, one or many rows."""
    names = [spec.name for spec in layout.fields]
    key_type = dict(pages.dtypes)[key]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (page, i, *values)
                for page, body in zip(batch[key], batch[html])
                if body is not None
                for i, values in enumerate(page_cards(body, layout))
            ]
            yield pd.DataFrame(rows, columns=[key, "card", *names])

    schema = f"{key} {key_type}, card int, " + ", ".join(f"{n} string" for n in names)
    return pages.select(key, html).mapInPandas(walk, schema)


def parsed_cards(cards: DataFrame, source: str, mode: str = "compat") -> DataFrame:
    """Salary and experience text to numbers, and the source tag."""
    return cards.withColumns({
        "salary": salary_lakh(F.col("salary"), mode),
        "experience": experience_compact(F.col("experience"), mode),
        "source": F.lit(source),
    })


def register_card_function(spark: SparkSession, layout: CardLayout, name: str = "html_cards") -> None:
    """Make a layout usable in SQL: ``FROM pages, LATERAL html_cards(html)``."""
    from pyspark.sql.functions import udtf

    class Cards:
        def eval(self, html: str):
            if html is not None:
                for i, values in enumerate(page_cards(html, layout)):
                    yield (i, *values)

    schema = "card int, " + ", ".join(f"{spec.name} string" for spec in layout.fields)
    spark.udtf.register(name, udtf(Cards, returnType=schema))
