"""Legal texts: conclusions, truncation before the assessment, removal of sentences that give the outcome, and names.

Everything is a column expression; patterns are Java's with Unix line ends, as other line ends don't count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.ratings import NO_VIOLATION, VIOLATION

LEAST_CHARS = 500

_COURT = "the court['’]?s assessment"
_HEADS = (_COURT, "merits", "the merits", "application of article 41")
_BARE = (_COURT, "merits$", "for these reasons", "operative provisions", "application of article 41", "article 41")
_OPENERS = ("the court will (?:now assess|first examine|examine the merits)", "the court must therefore determine", "the court notes at the outset that", "the court observes that the parties", "(?:turning|as) to the merits")
#: Where the assessment begins: a numbered heading, a bare heading, or an opening phrase.
MARKER = "(?imd)" + "|".join([f"^[ivx]+\\.\\s*(?:{'|'.join(_HEADS)})", f"^(?:{'|'.join(_BARE)})", *_OPENERS])

_BEEN = "there has (?:not )?been "
_SAYS = "(?:finds|holds|concludes)"
#: Phrases that give the outcome, in the order in which they are tried; a space stands for white space of any length.
CONCLUSORY = tuple("(?id)" + p.replace(" ", r"\s+") for p in (
    *(f"{_SAYS} that {_BEEN}(?:a )?{what}" for what in ("violation", "breach")),
    *(f"{_BEEN}(?:a )?{what} of article" for what in ("violation", "breach")),
    "no violation of article",
    "violated? article",
    f"accordingly,? the court {_SAYS}",
    f"it follows that {_BEEN.strip()}",
    "in the light of the above.*(?:concludes|finds)",
    "the court therefore concludes",
    "dismisses? the (?:complaint|application)",
    "holds that",
    "decides that",
))

_EITHER = "(?:a|no)"
#: A sentence that states a conclusion.
LEAK = "(?i)" + "|".join((
    f"there has (?:accordingly |therefore )?been {_EITHER} (?:violation|breach) of",
    f"court (?:therefore |accordingly )?(?:{_SAYS}|considers) that there (?:has|have|had) been {_EITHER}",
    f"finds? (?:that there is|there has been) {_EITHER} violation",
    "does not find (?:a|any) (?:violation|breach)",
    r"no violation of article [0-9]+[-\s\w./()]* has (?:therefore )?occurred",
    "unanimously,? that",
    f"discloses? {_EITHER} (?:violation|breach) of article",
))
SENTENCE_GAP = r'(?<=[!?.])\s+(?=(?:[0-9]{1,3}[.]\s+)?["“(A-Z])'
SCRUBBED = "+conclusion_scrub"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _right_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def conclusion_parts(conclusion: Column) -> Column:
    """Array of (article, label) of the parts between semicolons that name an article and say whether it was violated."""
    parts = F.transform(
        F.split(F.coalesce(conclusion, F.lit("")), ";"),
        lambda p: F.struct(
            F.regexp_extract(p, r"(?i)article\s+([P\d][-\d]*)", 1).alias("article"),
            F.when(p.rlike(r"(?i)no\s+violation"), NO_VIOLATION).when(p.rlike("(?i)violation"), VIOLATION).alias("violation_label"),
        ),
    )
    return F.filter(parts, lambda x: (x["article"] != "") & x["violation_label"].isNotNull())


def before_marker(text: Column) -> Column:
    """What stands before the first marker; the whole text without one."""
    return F.get(F.split(text, MARKER, 2), F.lit(0))


def _before_sentence(text: Column, pattern: str) -> Column:
    """The text up to the last full stop before the pattern; null without the pattern or a stop behind the first character."""
    head = F.regexp_extract(F.get(F.split(text, pattern, 2), F.lit(0)), r"(?s)^(.*\.)", 1)
    return F.when(text.rlike(pattern) & (F.length(head) > 1), _right_stripped(head))


def truncated(text: Column) -> tuple[Column, Column]:
    """The text before the assessment, and how it was cut: at a marker, else before the sentence of an outcome."""
    cuts = F.coalesce(*(_before_sentence(text, p) for p in CONCLUSORY))
    marked = text.rlike(MARKER)
    method = F.when(marked, "court_assessment_start").when(cuts.isNotNull(), "aggressive_fix: conclusory_pattern").otherwise("no_truncation")
    return F.when(marked, _right_stripped(before_marker(text))).otherwise(F.coalesce(cuts, text)), F.when(text.isNotNull(), method)


def scrubbed(text: Column) -> tuple[Column, Column]:
    """The text without sentences that state a conclusion, and how many went; unchanged if none did."""
    sentences = F.split(text, SENTENCE_GAP)
    kept = F.filter(sentences, lambda s: ~s.rlike(LEAK))
    gone = F.size(sentences) - F.size(kept)
    return F.when(gone > 0, F.array_join(kept, " ")).otherwise(text), gone


def own_article_leak(text: Column, article: Column) -> Column:
    """Whether the text states the outcome for this article."""
    pattern = F.concat(F.lit(r"(?i)there has (?:accordingly )?been (?:no|a) violation of article\s+\Q"), article, F.lit(r"\E\b"))
    return F.call_function("regexp_like", text, pattern)


def retention(length: Column, original: Column) -> Column:
    return F.coalesce(F.try_divide(100.0 * length, original), F.lit(0.0))


_ALIASES = {
    "TURKEY": ("TÜRKİYE", "TÜRKIYE", "TURQUIE"), "MOLDOVA": ("REPUBLIC OF MOLDOVA", "THE REPUBLIC OF MOLDOVA"), "NETHERLANDS": ("THE NETHERLANDS",),
    "UNITED KINGDOM": ("THE UNITED KINGDOM",), "CZECH REPUBLIC": ("THE CZECH REPUBLIC",), "ITALY": ("ITALIE",), "FINLAND": ("FINLANDE",),
    "NORTH MACEDONIA": ("FORMER YUGOSLAV REPUBLIC OF MACEDONIA", "THE FORMER YUGOSLAV REPUBLIC OF MACEDONIA", "THE FORMER YOUGOSLAV REPUBLIC OF MACEDONIA"),
}
COUNTRIES = {alias: name for name, aliases in _ALIASES.items() for alias in aliases}
KNOWN = tuple(sorted((
    "ALBANIA ANDORRA ARMENIA AUSTRIA AZERBAIJAN BELGIUM BULGARIA CROATIA CYPRUS DENMARK ESTONIA FINLAND FRANCE GEORGIA GERMANY GREECE HUNGARY ICELAND IRELAND ITALY LATVIA "
    "LIECHTENSTEIN LITHUANIA LUXEMBOURG MALTA MOLDOVA MONTENEGRO NETHERLANDS NORWAY POLAND PORTUGAL ROMANIA RUSSIA SERBIA SLOVAKIA SLOVENIA SPAIN SWEDEN SWITZERLAND TURKEY UKRAINE"
).split() + ["BOSNIA AND HERZEGOVINA", "CZECH REPUBLIC", "NORTH MACEDONIA", "SAN MARINO", "UNITED KINGDOM"], key=lambda c: (-len(c), c)))


def without_suffix(name: Column) -> Column:
    return stripped(F.regexp_replace(name, r"(?i)\s*\[GC]\s*$", ""))


def _unquoted(name: Column) -> Column:
    return stripped(F.regexp_replace(F.regexp_replace(stripped(name), '^"+|"+$', ""), "^'+|'+$", ""))


def extracted_respondent(case_name: Column) -> Column:
    """The party after ``v.``, or after ``c.`` if there is none, in capitals; null without either."""
    found = [F.nullif(F.regexp_extract(case_name, rf"(?i)\b{x}[.]\s+(.+?)\s*(?:\(|$)", 1), F.lit("")) for x in "vc"]
    return F.upper(without_suffix(_unquoted(F.regexp_replace(stripped(F.coalesce(*found)), r"\.+$", ""))))


def normal_country(name: Column) -> Column:
    """The usual name of a country: known spellings, a leading THE, and for names that begin with V. or AND the longest
    known country at the end."""
    n = without_suffix(_unquoted(name))
    alias = lambda x: F.element_at(F.create_map(*(F.lit(v) for kv in COUNTRIES.items() for v in kv)), x)
    bare = F.substring(n, F.lit(5), F.length(n))
    the = F.when(n.startswith("THE "), F.coalesce(alias(bare), F.when(bare.isin(*KNOWN), bare)))
    last = lambda names: F.nullif(F.regexp_extract(n, f"({'|'.join(names)})$", 1), F.lit(""))
    ends = F.coalesce(last(KNOWN), alias(last(COUNTRIES)))
    return F.coalesce(alias(n), the, F.when(n.startswith("V. ") | n.startswith("AND "), ends), n)


def needs_extraction(respondent: Column) -> Column:
    """Whether a respondent's name is missing or holds parts of the applicants'."""
    parts = F.filter(F.split(respondent, r"\s+"), lambda p: p != "")
    stray = F.exists(parts, lambda p: p == "V.") & ~F.forall(parts, lambda p: p.isin("V.", "AND") | (F.length(p) > 3))
    return (respondent == "UNKNOWN") | respondent.startswith("V. ") | respondent.startswith("AND ") | (respondent.contains("V.") & stray)


def is_multiple(respondent: Column) -> Column:
    parts = F.transform(F.split(respondent, " AND "), F.trim)
    alone = lambda p: ((F.length(p) > 3) & ~p.startswith("V.") & p.rlike(r"^\p{L}+$")) | p.contains(" ")
    return respondent.contains(" AND ") & F.forall(parts, alone)


def replaced(text: Column, replacements: dict[str, str]) -> Column:
    """Placeholders replaced one after another, longer ones first."""
    for old in sorted(replacements, key=len, reverse=True):
        text = F.replace(text, F.lit(old), F.lit(replacements[old]))
    return text


def pronouns(text: Column, placeholder: str, subject: str, object_form: str, verbs: list[str]) -> Column:
    """A placeholder for a person: the object's form after one of the verbs, the subject's elsewhere, in capitals if the
    placeholder begins so."""
    import re

    quoted = re.escape(placeholder)
    text = F.regexp_replace(text, rf"(?i)({'|'.join(verbs)})\s+{quoted}", f"$1 {object_form}")
    return F.replace(text, F.lit(placeholder), F.lit(subject.capitalize() if placeholder[:1].isupper() else subject))


def unfenced(reply: Column) -> Column:
    """A model's JSON answer without the fence around it."""
    return stripped(F.regexp_replace(stripped(reply), r"^```(?:json)?\s*|\s*```$", ""))


VERDICT_SCHEMA = "leaks_verdict boolean, leaking_sentences array<string>, confidence string, error string"


def verifier_reply(reply: Column) -> Column:
    return F.from_json(unfenced(reply), VERDICT_SCHEMA)
