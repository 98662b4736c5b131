"""Prompts, conversations and request parameters as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: article: (title, what has to be shown)
TESTS = {
    "2": ("Right to life", "whether force was no more than absolutely necessary and deaths were properly investigated"),
    "3": ("Prohibition of torture", "whether treatment reached a minimum level of severity"),
    "5": ("Right to liberty and security", "whether detention was lawful, reasoned and reviewed"),
    "6": ("Right to a fair trial", "whether proceedings as a whole were fair and timely"),
    "8": ("Right to respect for private and family life", "whether an interference was lawful, had an aim and was proportionate"),
    "10": ("Freedom of expression", "whether a restriction was prescribed, had an aim and was needed in a democracy"),
    "14": ("Prohibition of discrimination", "whether like persons were treated differently without justification"),
    "P1-1": ("Protection of property", "whether a fair balance was struck between the community and the owner"),
}
OTHER = ("", "whether the standards of the provision were met")

TEMPLATES = {
    "predictive": "Case under Article {article} ({title}). Rate from 1 (violation very likely found) to 5 (very unlikely).\n\n{case_text}",
    "normative": "Case under Article {article} ({title}). Consider {test}. Rate from 1 (there should be a violation) to 5 (there should be none).\n\n{case_text}",
    "factual": "Case under Article {article} ({title}). Rate from 1 (the facts show a violation) to 5 (they show none).\n\n{case_text}",
}
SYSTEM = "You rate court cases. Answer with one digit from 1 to 5."
CHALLENGE = "Are you sure? Think again and answer with one digit from 1 to 5."


def _lookup(article: Column, which: int) -> Column:
    known = F.create_map(*(F.lit(v) for a, t in TESTS.items() for v in (a, t[which])))
    return F.coalesce(F.element_at(known, article), F.lit(OTHER[which]))


def prompt(template: str, article: Column, text: Column, most: int | None = None) -> Column:
    """The template filled in; the text last, so that braces in it stay. ``most`` is the model's limit of characters."""
    text = F.coalesce(text, F.lit(""))
    out: Column = F.lit(template)
    for name, value in (("{article}", article), ("{title}", _lookup(article, 0)), ("{test}", _lookup(article, 1)), ("{case_text}", text if most is None else F.substring(text, 1, most))):
        out = F.replace(out, F.lit(name), value)
    return out


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(model: Column, system: Column, user: Column) -> Column:
    """System and user turns; models that know no system role get both in one user turn."""
    merged = F.array(_message("user", F.concat(system, F.lit("\n\n"), user)))
    return F.when(F.lower(model).contains("gemini"), merged).otherwise(F.array(_message("system", system), _message("user", user)))


def challenged(model: Column, system: Column, user: Column, answer: Column, challenge: Column) -> Column:
    """The whole conversation before the second answer: the first question and answer, and the challenge."""
    return F.concat(messages(model, system, user), F.array(_message("assistant", answer), _message("user", challenge)))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages, n_turns) of (conv_id, turn, role, text), in the order of turns; equal turns by role and text."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"), F.count(F.lit(1)).alias("n_turns"))


def request_params(model: Column, max_tokens: int = 100, temperature: float = 1.0) -> dict[str, Column]:
    """Parameters by model: reasoning models have their own limit and no temperature; some need room for reasoning."""
    m = F.lower(model)
    reasons = m.contains("gpt-5")
    roomy = m.contains("gemini") | m.contains("deepseek-v4")
    return {
        "max_completion_tokens": F.when(reasons, 2048),
        "reasoning_effort": F.when(reasons, "low"),
        "max_tokens": F.when(~reasons, F.when(roomy, 4096).otherwise(max_tokens)),
        "temperature": F.when(~reasons, F.lit(float(temperature))),
    }


def short_name(model: Column) -> Column:
    """The part behind the provider, as a name for files."""
    return F.translate(F.substring_index(model, "/", -1), ":. ", "___")
