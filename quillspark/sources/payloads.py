"""Decoders of metadata payloads held in tables: JSON of registries, Atom XML and HTML meta tags.
Fetching is left to whatever fills the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CROSSREF = """doi string, title array<string>, author array<struct<family:string,given:string>>, `container-title` array<string>,
 `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>,
 created struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>,
 volume string, issue string, page string, `article-number` string, type string"""
OPENALEX = """doi string, title string, publication_year int, type string, authorships array<struct<author:struct<display_name:string>>>,
 primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>"""
SCHOLAR = """title string, year int, abstract string, venue string, journal struct<name:string>, externalIds struct<DOI:string>, authors array<struct<name:string>>"""
PUBMED = """MedlineCitation struct<Article:struct<ArticleTitle:struct<value:string>,AuthorList:struct<Author:string>,Pagination:struct<MedlinePgn:string>,
 Journal:struct<Title:string,JournalIssue:struct<Volume:string,Issue:string,PubDate:struct<Year:string>>>>>"""
PERSON = "struct<LastName:string,ForeName:string,Initials:string>"


def year_of(work: Column, order=("published-print", "published-online", "created", "issued")) -> Column:
    """The first year of the dates in order."""
    return F.coalesce(*[F.get(F.get(work[k]["date-parts"], F.lit(0)), F.lit(0)).cast("string") for k in order], F.lit(""))


def names(authors: Column, most: int | None = None, join: str = " and ") -> Column:
    """'Family, Given' of each author with a family name."""
    some = F.filter(authors, lambda a: F.coalesce(F.trim(a["family"]), F.lit("")) != "")
    out = F.transform(some, lambda a: F.concat_ws(", ", F.trim(a["family"]), F.nullif(F.trim(a["given"]), F.lit(""))))
    return F.coalesce(F.array_join(out if most is None else F.slice(out, 1, most), join), F.lit(""))


def crossref(payload: Column) -> Column:
    w = F.from_json(payload, CROSSREF)
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        text(w["doi"]).alias("doi"), text(F.get(w["title"], F.lit(0))).alias("title"), names(w["author"]).alias("authors"), year_of(w).alias("year"),
        text(F.get(w["container-title"], F.lit(0))).alias("journal"), text(w["volume"]).alias("volume"), text(w["issue"]).alias("issue"),
        F.coalesce(F.nullif(w["article-number"], F.lit("")), w["page"], F.lit("")).alias("pages"), F.lit("crossref").alias("source"),
    )


def crossref_search(payload: Column) -> Column:
    """A found work: three authors at most, the year of print or else of the online version."""
    w = F.from_json(payload, CROSSREF.replace("doi string", "DOI string") + ", abstract string")
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        text(w["DOI"]).alias("doi"), text(F.get(w["title"], F.lit(0))).alias("title"), F.coalesce(F.nullif(names(w["author"], 3), F.lit("")), F.lit("Unknown")).alias("authors"),
        year_of(w, ("published-print", "published-online")).alias("year"), text(F.get(w["container-title"], F.lit(0))).alias("journal"), text(w["abstract"]).alias("abstract"), F.lit("CrossRef").alias("source"),
    )


def openalex(payload: Column) -> Column:
    from ..functions.text import inverted_index_text

    w = F.from_json(payload, OPENALEX)
    text = lambda c: F.coalesce(c, F.lit(""))
    who = F.array_join(F.slice(F.transform(w["authorships"], lambda a: a["author"]["display_name"]), 1, 3), "; ")
    return F.struct(
        F.replace(text(w["doi"]), F.lit("https://doi.org/"), F.lit("")).alias("doi"), text(w["title"]).alias("title"), text(who).alias("authors"), text(w["publication_year"].cast("string")).alias("year"),
        text(w["primary_location"]["source"]["display_name"]).alias("journal"), text(inverted_index_text(w["abstract_inverted_index"])).alias("abstract"), F.lit("openalex").alias("source"),
    )


def scholar(payload: Column) -> Column:
    """Null for a work without a DOI."""
    w = F.from_json(payload, SCHOLAR)
    text = lambda c: F.coalesce(c, F.lit(""))
    journal = F.coalesce(F.nullif(w["journal"]["name"], F.lit("")), w["venue"], F.lit(""))
    out = F.struct(w["externalIds"]["DOI"].alias("doi"), text(w["title"]).alias("title"), text(F.array_join(F.slice(F.transform(w["authors"], lambda a: a["name"]), 1, 3), "; ")).alias("authors"), text(w["year"].cast("string")).alias("year"), journal.alias("journal"), text(w["abstract"]).alias("abstract"), F.lit("semantic-scholar").alias("source"))
    return F.when(text(w["externalIds"]["DOI"]) != "", out)


def pubmed(payload: Column) -> Column:
    """The author list is one person or an array of them."""
    a = F.from_json(payload, PUBMED)["MedlineCitation"]["Article"]
    text = lambda c: F.coalesce(c, F.lit(""))
    people = a["AuthorList"]["Author"]
    people = F.when(people.startswith("["), F.from_json(people, f"array<{PERSON}>")).otherwise(F.array(F.from_json(people, PERSON)))
    people = F.filter(people, lambda p: text(p["LastName"]) != "")
    who = F.transform(people, lambda p: F.concat_ws(", ", p["LastName"], F.coalesce(F.nullif(p["ForeName"], F.lit("")), F.nullif(p["Initials"], F.lit("")))))
    issue = a["Journal"]["JournalIssue"]
    return F.struct(
        F.coalesce(F.nullif(F.array_join(who, " and "), F.lit("")), F.lit("Unknown")).alias("authors"), text(a["ArticleTitle"]["value"]).alias("title"), text(a["Journal"]["Title"]).alias("journal"),
        text(issue["Volume"]).alias("volume"), text(issue["Issue"]).alias("number"), text(a["Pagination"]["MedlinePgn"]).alias("pages"), text(issue["PubDate"]["Year"]).alias("year"),
    )


def unescaped(text: Column) -> Column:
    """The named and numeric references that occur in meta tags; ampersands last."""
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"), ("&#38;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def meta_values(html: Column, name: str) -> Column:
    found = F.regexp_extract_all(html, F.lit(rf'(?i)<meta\s+name="{name}"\s+content="([^"]*)"'), F.lit(1))
    return F.transform(found, lambda v: F.trim(unescaped(v)))


def arxiv_html(html: Column, arxiv_id: Column) -> Column:
    first = lambda n: F.coalesce(F.get(meta_values(html, n), F.lit(0)), F.lit(""))
    return F.struct(
        F.array_join(meta_values(html, "citation_author"), " and ").alias("author"), first("citation_title").alias("title"), F.substring(first("citation_date"), 1, 4).alias("year"),
        arxiv_id.alias("eprint"), F.lit("arXiv").alias("archiveprefix"), F.concat(F.lit("https://arxiv.org/abs/"), arxiv_id).alias("url"), first("citation_abstract").alias("abstract"),
    )


ATOM = "entry struct<title:string,published:string,author:array<struct<name:string>>>"


def arxiv_atom(xml: Column, arxiv_id: Column) -> Column:
    e = F.from_xml(xml, ATOM)["entry"]
    swap = lambda n: F.when(F.contains(n, F.lit(" ")), F.concat(F.regexp_extract(n, r"^[^ ]* (.*)$", 1), F.lit(", "), F.regexp_extract(n, r"^([^ ]*) ", 1))).otherwise(n)
    who = F.array_join(F.transform(e["author"], lambda a: swap(a["name"])), " and ")
    return F.struct(F.coalesce(F.nullif(who, F.lit("")), F.lit("Unknown")).alias("author"), F.coalesce(e["title"], F.lit("")).alias("title"), F.substring(F.coalesce(e["published"], F.lit("")), 1, 4).alias("year"), arxiv_id.alias("eprint"))
