"""Curation of cases: truncation, scrubbing, repair, exclusion, names, upsert and refresh."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T


def verdict_free(cases: DataFrame, text: str = "full_text") -> DataFrame:
    """``cases`` with the text before the assessment, scrubbed, its lengths, and whether it is too short to be used."""
    cut, method = T.truncated(F.col(text))
    rows = cases.withColumn("cut_text", cut).withColumn("removal_method", method)
    clean, gone = T.scrubbed(F.col("cut_text"))
    rows = rows.withColumn("n_scrubbed", gone).withColumn("text_nv", clean).drop("cut_text")
    rows = rows.withColumns({"truncated": F.col("removal_method") != "no_truncation", "scrubbed": F.col("n_scrubbed") > 0})
    rows = rows.withColumn("removal_method", F.when(F.col("scrubbed") & ~F.col("removal_method").contains(T.SCRUBBED), F.concat("removal_method", F.lit(T.SCRUBBED))).otherwise(F.col("removal_method")))
    rows = rows.withColumns({"original_length": F.length(text), "verdict_free_length": F.length("text_nv")})
    short = F.coalesce(F.col("verdict_free_length"), F.lit(0)) < T.LEAST_CHARS
    return rows.withColumns({"retention_percentage": T.retention(F.col("verdict_free_length"), F.col("original_length")), "excluded": short, "exclusion_reason": F.when(short, "too_short_after_truncation")})


def assert_no_leak(rows: DataFrame, text: str = "text_nv") -> None:
    """Raises if any text states the outcome for its own article."""
    leaks = rows.where(T.own_article_leak(F.col(text), F.col("article"))).count()
    if leaks:
        raise ValueError(f"{leaks} texts state their own outcome")


def conclusion_pairs(cases: DataFrame, keep_unparsed: bool = False) -> DataFrame:
    """A row for each article that a conclusion decides; cases without any give none, or one of label unknown."""
    rest = [c for c in cases.columns if c not in ("article", "violation_label")]
    rows = cases.select(*rest, F.explode_outer(T.conclusion_parts(F.col("conclusion"))).alias("x"))
    if not keep_unparsed:
        rows = rows.where("x is not null")
    return rows.select(*rest, F.coalesce("x.article", F.lit("")).alias("article"), F.coalesce("x.violation_label", F.lit("unknown")).alias("violation_label"))


_REPAIR = tuple(re.compile(p.removeprefix("(?id)"), re.I) for p in T.CONCLUSORY)


def repaired_text(text: str, sentences: list[str]) -> tuple[str, str]:
    """``text`` without its leaking sentences, or cut before them, then before any outcome; and what was done."""
    done = []

    def before(at: int, what: str) -> None:
        nonlocal text
        stop = text.rfind(".", 0, at)
        if stop > 0:
            text = text[: stop + 1].rstrip()
            done.append(what)

    for s in filter(None, sentences):
        if s.strip() in text and s.strip():
            text = text.replace(s.strip(), "", 1)
            done.append("removed")
        elif (at := text.lower().find(s.lower()[:50])) > 0:
            before(at, "cut")
    for pattern in _REPAIR:
        if m := pattern.search(text):
            before(m.start(), "cleaned")
    return text.strip(), "; ".join(done)


def repaired(cases: DataFrame, text: str = "text_nv", sentences: str = "leaking_sentences") -> DataFrame:
    """``cases`` with repaired text, repairs, length and exclusion. The repair is a fold with each row's own patterns, so it
    runs in Python by batches, without a shuffle.

    A repair that leaves less than LEAST_CHARS excludes the case and changes neither its text nor what is known of its length.
    A case that is excluded stays so. ``method``, if there is such a column, gets the repairs appended; the part retained is
    told anew where there is an ``original_length``. Null text counts as empty, null sentences as none."""

    @F.pandas_udf("text string, repairs string")
    def repair(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([repaired_text(x or "", [] if y is None else list(y)) for x, y in zip(t, s)], columns=["text", "repairs"])

    rows = cases.withColumn("_r", repair(F.col(text), F.col(sentences)))
    new, short = F.col("_r.text"), F.length("_r.text") < T.LEAST_CHARS
    old = lambda c, other: F.col(c) if c in cases.columns else other
    length = F.when(short, old("verdict_free_length", F.length(text))).otherwise(F.length(new))
    made = {
        text: F.when(short, F.col(text)).otherwise(new), "repairs": F.col("_r.repairs"), "verdict_free_length": length,
        "excluded": short | F.coalesce(old("excluded", F.lit(False)), F.lit(False)), "exclusion_reason": F.when(short, "too_short_after_repair").otherwise(old("exclusion_reason", F.lit(None).cast("string"))),
    }
    if "method" in cases.columns:
        made["method"] = F.concat_ws("; ", "method", F.nullif(F.col("_r.repairs"), F.lit("")))
    if "original_length" in cases.columns:
        made["retention"] = F.when(short, old("retention", T.retention(F.length(text), F.col("original_length")))).otherwise(T.retention(F.length(new), F.col("original_length")))
    return rows.withColumns(made).drop("_r")


def verified(cases: DataFrame, replies: DataFrame, key: str = "item_id") -> DataFrame:
    """Whether any verifier finds a leak, and all leaking sentences in the order of verifiers; cases without replies pass."""
    r = replies.select(key, "verifier", T.verifier_reply(F.col("reply")).alias("v"))
    found = r.groupBy(key).agg(F.coalesce(F.bool_or("v.leaks_verdict"), F.lit(False)).alias("leaks"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("verifier", F.coalesce("v.leaking_sentences", F.array().cast("array<string>")).alias("s")))), lambda x: x["s"])).alias("leaking_sentences"))
    return cases.join(found, key, "left").withColumns({"leaks": F.coalesce("leaks", F.lit(False)), "leaking_sentences": F.coalesce("leaking_sentences", F.array().cast("array<string>"))})


def clean_respondents(cases: DataFrame) -> DataFrame:
    """``cases`` with the respondent's usual name; what needs it is taken from the case's name. Of a name with AND that isn't
    several respondents the last part counts, if it is a country; several respondents stay as they are. Null stays null."""
    r, found = F.col("respondent"), T.extracted_respondent(F.col("case_name"))
    name = F.when(T.needs_extraction(r), F.coalesce(found, r)).otherwise(r)
    last = F.trim(F.element_at(F.split("_n", " AND "), -1))
    one = F.col("_n").contains(" AND ") & ~T.is_multiple(F.col("_n")) & last.isin(*T.KNOWN, *T.COUNTRIES)
    rows = cases.withColumn("_n", T.normal_country(name)).withColumn("_n", F.when(one, last).otherwise(F.col("_n")))
    return rows.withColumns({"old_respondent": r, "respondent": T.normal_country(F.col("_n"))}).drop("_n")


def rename_log(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(~F.col("old_respondent").eqNullSafe(F.col("respondent"))).groupBy("old_respondent", "respondent").agg(F.count(F.lit(1)).alias("n"))


def upserted(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("item_id", "article"), order: str = "ord") -> DataFrame:
    """One row for each key: the last of the new ones, else the first of the existing. ``place`` is where the key came first,
    which a replacement keeps. Rows with a null in the key are one key of their own, and its existing row is never replaced."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    fixed = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    rank = Window.partitionBy(*keys).orderBy(F.when(fixed, F.col("_new")).otherwise(-F.col("_new")), F.when((F.col("_new") == 1) & ~fixed, -F.col(order)).otherwise(F.col(order)))
    first = F.min(F.struct("_new", order)).over(Window.partitionBy(*keys))
    rows = both.withColumns({"_k": F.row_number().over(rank), "place": first})
    return rows.where("_k = 1").withColumn("replaced", (F.col("_new") == 1) & (F.col("place._new") == 0)).drop("_k", "_new")


def latest_date(rows: DataFrame, *columns: str) -> Column:
    """The greatest date written in full among the columns' first ten characters, as an aggregate."""
    raw = F.coalesce(*(F.nullif(F.substring(F.col(c).cast("string"), 1, 10), F.lit("")) for c in columns))
    return F.max(F.when(F.length(raw) == 10, F.try_to_date(raw, "yyyy-MM-dd")))


def refreshed(existing: DataFrame, scraped: DataFrame, default: str = "2020-01-01") -> DataFrame:
    """The scraped rows that are new: dated from a day before the latest known date on, and of unknown ``item_id``."""
    since = existing.agg(F.coalesce(F.date_sub(latest_date(existing, "decision_date"), 1), F.lit(default).cast("date")).alias("since"))
    fresh = scraped.crossJoin(F.broadcast(since)).where(F.try_to_date(F.substring("decision_date", 1, 10), "yyyy-MM-dd") >= F.col("since"))
    return fresh.join(existing.select("item_id").distinct(), "item_id", "left_anti")


def by_date(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Latest first, rows without a date last, else in the order they had."""
    return rows.orderBy(F.col("decision_date").desc_nulls_last(), F.col(order))


def stratified(cases: DataFrame, states: int, per_state: int, seed: int = 42) -> DataFrame:
    """All pairs of ``per_state`` cases, in the order of a hash, from each of the states with the most pairs; ties go to the
    first name. The states are few; the cases are ranked in their state, so no state is gathered by the driver."""
    top = cases.groupBy("respondent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "respondent").limit(states).select("respondent")
    ids = cases.join(F.broadcast(top), "respondent", "left_semi").select("respondent", "item_id").distinct()
    rank = F.row_number().over(Window.partitionBy("respondent").orderBy(F.md5(F.concat(F.col("item_id"), F.lit(f":{seed}"))), "item_id"))
    chosen = ids.withColumn("_k", rank).where(F.col("_k") <= per_state).drop("_k")
    return cases.join(chosen, ["respondent", "item_id"], "left_semi")


class _Reader(HTMLParser):
    SILENT = frozenset(["style", "script"])
    OPEN = frozenset("br div h1 h2 h3 h4 h5 h6 li p tr".split())
    CLOSE = (OPEN - {"br"}) | {"table"}

    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.silent = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SILENT:
            self.silent = True
        elif tag in self.OPEN:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = False
        else:
            self.parts.append("\n" if tag in self.CLOSE else "  " if tag == "td" else "")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def text_of_html(html: str | None) -> str | None:
    if html is None:
        return None
    reader = _Reader()
    reader.feed(html)
    lines = re.sub("\n\n\n+", "\n\n", "".join(reader.parts)).split("\n")
    return "\n".join(" ".join(re.split("[\t ]+", x)) for x in map(str.strip, lines)).strip()


def html_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``: entities need a parser, so it runs in Python by batches, without a shuffle."""

    @F.pandas_udf("string")
    def read(h: pd.Series) -> pd.Series:
        return h.map(text_of_html, na_action="ignore")

    return pages.withColumn("text", read(F.col(html)))


def contamination_input(cases: DataFrame, genre: str = "001-", articles: dict[str, str] | None = None) -> DataFrame:
    """The rows of one genre with a text and a label of either kind, articles renamed, texts under their two names."""
    a = F.col("article")
    for old, new in (articles or {"1": "P1-1"}).items():
        a = F.when(F.col("article") == old, new).otherwise(a)
    ok = F.col("item_id").startswith(genre) & (F.length("text_nv") > 0) & F.col("violation_label").isin("violation", "no_violation")
    return cases.where(ok).withColumn("article", a).withColumn("full_case_text_no_verdict", F.col("text_nv")).withColumn("full_case_text", F.coalesce(F.nullif("full_text", F.lit("")), "text_nv"))


def published(cases: DataFrame) -> DataFrame:
    """The projection that is handed on, with the text under one name."""
    return cases.select("item_id", "article", "case_name", "respondent", "violation_label", "decision_date", F.coalesce(F.nullif("text_nv", F.lit("")), "full_text").alias("case_text"))


def hits(rows: DataFrame, columns: str = "columns") -> DataFrame:
    """Search results flattened: ids, names, trimmed articles, date of ten characters."""
    c = lambda n: F.col(f"{columns}.{n}")
    articles = F.filter(F.transform(F.split(F.coalesce(c("article"), F.lit("")), ";"), F.trim), lambda x: x != "")
    return rows.select(c("itemid").alias("item_id"), c("docname").alias("case_name"), c("appno").alias("application_number"), F.substring(c("kpdate"), 1, 10).alias("decision_date"), c("respondent").alias("respondent"), articles.alias("articles"), c("conclusion").alias("conclusion"))


