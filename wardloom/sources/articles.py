"""Article, preprint, curated, full-text and web sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.dates import dashed_date, pubmed_date, whole_number
from wardloom.functions.text import has_text, split_names, string_array, strings, strip, text_or_empty
from wardloom.reference_data import GUIDELINE_TYPES
from wardloom.sources.base import Source, document, parsed_json, parsed_xml

# --- PubMed ------------------------------------------------------------------

_TYPES = "PublicationTypeList struct<PublicationType array<struct<_VALUE string, _UI string>>>"
_PUBMED = (
    "PubmedArticle array<struct<MedlineCitation struct<"
    "PMID struct<_VALUE string, _Version string>, "
    "Article struct<"
    "ArticleTitle string, "
    "Abstract struct<AbstractText array<struct<_VALUE string, _Label string>>>, "
    "AuthorList struct<Author array<struct<LastName string, ForeName string, CollectiveName string>>>, "
    "Journal struct<JournalIssue struct<PubDate struct<Year string, Month string, Day string>>>, "
    "ELocationID array<struct<_VALUE string, _EIdType string>>, "
    f"{_TYPES}>, "
    f"{_TYPES}>>>"
)
# Leaves whose text ends at the first child element. Cutting on the raw text keeps escaped "<" intact.
_CUT_AT_CHILD = (
    r"(?s)(<(ArticleTitle|AbstractText|LastName|ForeName|CollectiveName|PublicationType)"
    r"(?:\s[^>]*)?(?<!/)>[^<]*)<(?!/\2\s*>|!\[CDATA\[).*?</\2\s*>"
)


def _parse_pubmed(payload: Column) -> Column:
    return parsed_xml(F.regexp_replace(payload, _CUT_AT_CHILD, "$1</$2>"), _PUBMED)


def _author_name(author: Column) -> Column:
    person = strip(F.concat(author["LastName"], F.lit(" "), text_or_empty(author["ForeName"])))
    return (
        F.when(has_text(author["CollectiveName"]), author["CollectiveName"])
        .when(has_text(author["LastName"]), person)
    )


def _abstract_part(part: Column) -> Column:
    text = text_or_empty(part["_VALUE"])
    return F.when(has_text(part["_Label"]), F.concat(part["_Label"], F.lit(": "), text)).otherwise(text)


def _pubmed_documents(types_in_article: bool):
    def build(parsed: DataFrame) -> DataFrame:
        rows = (
            parsed.select(F.explode("parsed.PubmedArticle").alias("article"))
            .select(F.col("article.MedlineCitation").alias("citation"))
            .where("citation.Article is not null")
            .select("citation", F.col("citation.Article").alias("article"))
        )
        issued = F.col("article.Journal.JournalIssue.PubDate")
        # a year that is not a number cannot be read; such articles are left to ``unreadable_years``
        rows = rows.where(~has_text(issued["Year"]) | whole_number(issued["Year"]).between(1, 9999))
        pmid = text_or_empty(F.col("citation.PMID._VALUE"))
        abstract = F.array_join(F.transform("article.Abstract.AbstractText", _abstract_part), "\n\n")
        authors = F.array_compact(F.transform("article.AuthorList.Author", _author_name))
        dois = F.filter("article.ELocationID", lambda e: e["_EIdType"] == "doi")
        types = F.transform("citation.PublicationTypeList.PublicationType", lambda t: t["_VALUE"])
        if types_in_article:
            inner = F.transform("article.PublicationTypeList.PublicationType", lambda t: t["_VALUE"])
            types = F.concat(strings(types), strings(inner))
        guideline = F.arrays_overlap(strings(types), F.array(*[F.lit(t) for t in GUIDELINE_TYPES]))
        return rows.select(
            *document(
                "pubmed",
                pmid,
                F.col("article.ArticleTitle"),
                abstract,
                "abstract",
                F.when(guideline, F.lit("guideline")).otherwise(F.lit("peer_reviewed")),
                authors=authors,
                publication_date=F.when(
                    has_text(issued["Year"]), pubmed_date(issued["Year"], issued["Month"], issued["Day"])
                ),
                url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")),
                doi=F.get(dois, 0)["_VALUE"],
            )
        )

    return build


def _undated(parsed: DataFrame) -> DataFrame:
    """Articles left out because their year is not a number."""
    articles = parsed.select(F.explode("parsed.PubmedArticle").alias("article"))
    citation = F.col("article.MedlineCitation")
    year = citation["Article"]["Journal"]["JournalIssue"]["PubDate"]["Year"]
    bad = has_text(year) & ~F.coalesce(whole_number(year).between(1, 9999), F.lit(False))
    return articles.where(bad).select(
        citation["PMID"]["_VALUE"].alias("source_id"), year.alias("year"), F.to_json("article").alias("payload")
    )


PUBMED = Source("pubmed", _parse_pubmed, _pubmed_documents(types_in_article=False), _undated)
# Current exports put the publication types inside the article element; this reads both places
PUBMED_BOTH_TYPE_PLACES = Source("pubmed", _parse_pubmed, _pubmed_documents(types_in_article=True), _undated)


def unreadable_years(landed: DataFrame, payload: str = "payload") -> DataFrame:
    """Articles left out because their year is not a number, by id."""
    return _undated(PUBMED.parsed(landed, payload)).select(F.lit("pubmed").alias("source"), "source_id", "year")


_ARTICLE_END = "</PubmedArticle>"


def landed_articles(spark: SparkSession, path: str) -> DataFrame:
    """Article exports of any size as landed payloads, one article each.

    Files are cut at the end tag of an article while they are read, so a large file is read by many tasks.
    """
    pieces = spark.read.option("lineSep", _ARTICLE_END).text(path)
    begin = F.regexp_instr("value", F.lit(r"<PubmedArticle[\s>]"))
    article = F.concat(F.substring(F.col("value"), begin, F.length("value")), F.lit(_ARTICLE_END))
    whole = F.concat(F.lit("<PubmedArticleSet>"), article, F.lit("</PubmedArticleSet>"))
    return pieces.where(begin > 0).select(whole.alias("payload"))


# --- medRxiv -----------------------------------------------------------------


def _medrxiv_documents(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.explode("parsed.collection").alias("item"))
    item = F.col("item")
    return rows.select(
        *document(
            "medrxiv",
            item["doi"],
            item["title"],
            item["abstract"],
            "abstract",
            "preprint",
            authors=split_names(item["authors"]),
            publication_date=dashed_date(item["date"]),
            specialty=F.when(has_text(item["category"]), string_array(item["category"])),
            url=F.concat(F.lit("https://www.medrxiv.org/content/"), text_or_empty(item["doi"])),
            doi=text_or_empty(item["doi"]),
        )
    )


MEDRXIV = Source(
    "medrxiv",
    lambda payload: parsed_json(
        payload,
        "collection array<struct<doi string, title string, authors string, date string, "
        "abstract string, category string, server string>>",
    ),
    _medrxiv_documents,
)

# --- Curated, full-text and web answers ---------------------------------------


def _curated_documents(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.explode("parsed.results").alias("item"))
    item = F.col("item")
    return rows.select(
        *document(
            "glass",
            item["id"],
            item["title"],
            item["content"],
            "curated",
            "curated",
            specialty=F.when(has_text(item["category"]), string_array(item["category"])),
            url=item["url"],
        )
    )


CURATED = Source(
    "glass",
    lambda payload: parsed_json(
        payload,
        "results array<struct<id string, title string, content string, category string, url string>>",
    ),
    _curated_documents,
)


def _fulltext_documents(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.explode("parsed.results").alias("item"))
    item = F.col("item")
    return rows.select(
        *document(
            "annas_archive",
            item["id"],
            item["title"],
            item["content"],
            "full_text",
            "peer_reviewed",
            authors=split_names(item["author"]),
            doi=item["doi"],
        )
    )


FULLTEXT = Source(
    "annas_archive",
    lambda payload: parsed_json(
        payload,
        "results array<struct<id string, title string, author string, content string, doi string>>",
    ),
    _fulltext_documents,
)


def _web_documents(parsed: DataFrame) -> DataFrame:
    rows = parsed.select(F.explode("parsed.data").alias("item"))
    url = text_or_empty(F.col("item.url"))
    return rows.select(
        *document(
            "firecrawl",
            url,
            F.coalesce(F.col("item.title"), url),
            F.col("item.markdown"),
            "full_text",
            "peer_reviewed",
            url=url,
        )
    )


WEB = Source(
    "firecrawl",
    lambda payload: parsed_json(
        payload, "data array<struct<url string, title string, markdown string>>"
    ),
    _web_documents,
)


def normalize_scrapes(landed: DataFrame, payload: str = "payload", url: str = "url") -> DataFrame:
    """Answers to scraping one known url: a single page object, keyed by the url asked for."""
    page = parsed_json(F.col(payload), "data struct<title string, markdown string>")["data"]
    rows = landed.select(page.alias("page"), F.col(url).alias("asked"))
    return rows.select(
        *document(
            "firecrawl",
            F.col("asked"),
            F.coalesce(F.col("page.title"), F.col("asked")),
            F.col("page.markdown"),
            "full_text",
            "peer_reviewed",
            url=F.col("asked"),
        )
    )
