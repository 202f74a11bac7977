"""Versioned prompts: a registry, and this engine's own texts.

A name has any number of versions, one of them active; a caller can pin
another one.  Placeholders stand in braces and are filled by `fill`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prompt:
    name: str
    version: str
    body: str
    notes: str = ""
    active: bool = False


class Registry:
    """Prompts by name and version, in the order they came."""

    def __init__(self) -> None:
        self._all: dict[tuple[str, str], Prompt] = {}

    def add(self, *prompts: Prompt) -> None:
        for p in prompts:
            if (p.name, p.version) in self._all:
                raise ValueError(f"{p.name} {p.version} is registered already")
            self._all[p.name, p.version] = p

    def versions(self, name: str) -> list[Prompt]:
        found = [p for p in self._all.values() if p.name == name]
        if not found:
            raise ValueError(f"no prompt is named {name}")
        return found

    def active(self, name: str) -> Prompt:
        on = [p for p in self.versions(name) if p.active]
        if len(on) != 1:
            raise ValueError(f"{name} has {len(on)} active versions, not one")
        return on[0]

    def get(self, name: str, version: str) -> Prompt:
        for p in self.versions(name):
            if p.version == version:
                return p
        raise ValueError(f"{name} has no version {version}, only {', '.join(p.version for p in self.versions(name))}")

    def names(self) -> list[str]:
        return list(dict.fromkeys(name for name, _ in self._all))

    def active_versions(self) -> dict[str, str]:
        return {n: self.active(n).version for n in self.names()}

    def table(self, spark: SparkSession) -> DataFrame:
        """name, version, notes, active: what answers.prompt_problems checks."""
        return spark.createDataFrame([(p.name, p.version, p.notes, p.active) for p in self._all.values()], "name string, version string, notes string, active boolean")


def fill(prompt: Prompt, **values: Column) -> Column:
    """The prompt's text with every {name} replaced."""
    out = F.lit(prompt.body)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


CATALOGUE = Registry()
CATALOGUE.add(
    Prompt("query_classification", "v1", "Acts:\n{acts}\n\nSay whether the question asks what the law says (DEFINITIONAL) or how courts read it (INTERPRETIVE), and how relevant each act is, from 0 to 1.\n\nQuestion: {query}"),
    Prompt("query_classification", "v2", "Acts:\n{acts}\n\nReturn JSON with intent (DEFINITIONAL: what the law says; INTERPRETIVE: how courts read it), act_relevances (celex and relevance from 0 to 1 for every act above) and sub_questions (none, or two to four that each ask for one provision).\n\nQuestion: {query}", "adds sub-questions", True),
    Prompt("topic_selection", "v1", "Which of these topics does the question touch?\n{topics}\n\nQuestion: {query}", active=True),
    Prompt("answer_synthesis", "v1", "Answer from the passages alone.\n\n{context}\n\nQuestion: {question}"),
    Prompt("answer_synthesis", "v2", "Answer the question in continuous prose, from the passages alone; say so if they don't hold the answer. {guidance}\n\nPassages:\n{context}\n\nQuestion: {question}", "takes guidance on what governs", True),
    Prompt("answer_filter", "v1", "Strike from the draft what the question did not ask for; change nothing else.\n\nQuestion: {question}\n\nDraft: {draft_answer}", active=True),
    Prompt("context_curation", "v1", "Which passages help to answer the question?\n{passages}\n\nQuestion: {question}"),
    Prompt("context_curation", "v2", "Return JSON: keep, the numbers of the passages that help to answer the question, and governing, those of them that decide it.\n{passages}\n\nQuestion: {question}", "tells governing passages", True),
    Prompt("attribution", "v1", "Return JSON with assignments: for the index of each sentence the markers of the sources that support it.\n\nSentences:\n{sentences}\n\nSources:\n{sources}", active=True),
    Prompt("hyde", "v1", "Write a provision, as one of these acts would word it, that answers the question.\n\nActs: {acts}\n\nQuestion: {query}", active=True),
    Prompt("article_summary_system", "v1", "You sum up provisions for lawyers, in two sentences.", active=True),
    Prompt("article_summary_user", "v1", "{celex} {act_title}\n{article_title}\n\n{body}", active=True),
    Prompt("chapter_summary_system", "v1", "You say in two sentences what a chapter of an act is about.", active=True),
    Prompt("chapter_summary_user", "v1", "{celex} {act_title}\nChapter {number}: {chapter_title}\n\n{article_titles}", active=True),
    Prompt("case_law_entity_summary_system", "v1", "You sum up a section of a judgment; return JSON with heading and summary.", active=True),
    Prompt("case_law_entity_summary_user", "v1", "Section (level {depth}): {heading}\n\n{body}", active=True),
    Prompt("case_law_entire_doc_summary_system", "v1", "You sum up a judgment as a whole.", active=True),
    Prompt("case_law_entire_doc_summary_user", "v1", "In about {char_length} characters:\n\n{document_content}", active=True),
    Prompt("claim_extraction", "v1", "List the text's claims, one a line.\n\n{text}", active=True),
    Prompt("claim_verification", "v1", "Does the passage support the claim? Answer 1 or 0.\n\nPassage: {passage}\n\nClaim: {claim}", active=True),
)
