"""Citations, context and prompts as column expressions; zero pages and empty fields are left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CITATIONS = "No citations available"
NO_CONTEXT = "No relevant context found."
SYSTEM_PROMPT = "You answer questions on food safety from the given sources only, and you name the sources."
ANSWER_PROMPT = ("Sources:\n", "\n\nQuestion: ", "\n\nAnswer from the sources and cite them by number. Say so if they do not suffice.")
EXPANSION_PROMPT = ("Write other wordings of this question, as a JSON list of strings.\n\nQuestion: ", "\n")


def _given(c: Column) -> Column:
    """A page or text that says something."""
    return c.isNotNull() & (c.cast("string") != "") & (c.cast("string") != "0")


def chunk_citation(name: Column, page: Column, section: Column, chunk_id: Column) -> Column:
    return F.concat_ws(" | ", F.concat(F.lit("Document: "), name), F.when(_given(page), F.concat(F.lit("Page: "), page)), F.when(_given(section), F.concat(F.lit("Section: "), section)), F.concat(F.lit("ID: "), chunk_id))


def citation(name: Column, page: Column, section: Column) -> Column:
    return F.concat_ws(" | ", name, F.when(_given(page), F.concat(F.lit("p. "), page)), F.when(_given(section), section))


# Fixed value: the card's four lines.
CARD = "Citation Format:\n- Document: %s\n- Page: %s\n- Section: %s\n- Reference ID: %s"


def citation_card(name: Column, page: Column, section: Column, chunk_id: Column) -> Column:
    """The four-line form; what is missing reads N/A."""
    or_na = lambda c: F.when(_given(c), c.cast("string")).otherwise("N/A")
    return F.format_string(CARD, name, or_na(page), or_na(section), chunk_id)


def citation_list(citations: Column) -> Column:
    """Numbered lines of an array of citations."""
    lines = F.transform(citations, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), citation(x["document_name"], x["page"], x["section"])))
    return F.when(F.coalesce(F.size(citations), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(NO_CITATIONS)


def citation_block(citations: Column) -> Column:
    """The block that closes an answer; an empty list gives an empty text."""
    line = lambda x, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["document_name"], F.lit("Unknown")),
        F.when(_given(x["page"]), F.concat(F.lit(", p. "), x["page"])).otherwise(""),
        F.when(_given(x["section"]), F.concat(F.lit(" - "), x["section"])).otherwise(""),
        F.when(_given(x["chunk_id"]), F.concat(F.lit(" (ID: "), x["chunk_id"], F.lit(")"))).otherwise(""),
    )
    return F.when(F.coalesce(F.size(citations), F.lit(0)) > 0, F.concat(F.lit("\n\nCitations:\n"), F.array_join(F.transform(citations, line), "\n"))).otherwise("")


def context_source(rank: Column, text: Column, name: Column, page: Column, section: Column) -> Column:
    """One numbered source of a context."""
    return F.concat(F.lit("[Source "), rank.cast("string"), F.lit("]\n"), text, F.lit("\nDocument: "), name, F.when(_given(page), F.concat(F.lit(", Page: "), page)).otherwise(""), F.when(_given(section), F.concat(F.lit(", Section: "), section)).otherwise(""))


def answer_prompt(query: Column, context: Column) -> Column:
    """Both values are put in once; braces in them mean nothing."""
    a, b, c = ANSWER_PROMPT
    return F.concat(F.lit(a), context, F.lit(b), query, F.lit(c))


def expansion_prompt(query: Column) -> Column:
    a, b = EXPANSION_PROMPT
    return F.concat(F.lit(a), query, F.lit(b))
