"""Ratings from 1 (very likely a violation) to 5 (very unlikely), as column expressions.

Null ratings stay null unless said otherwise. ``polarity`` is ``"low"`` where 1 means a violation, ``"high"`` where 5 does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VIOLATION, NO_VIOLATION, ABSTENTION = "violation", "no_violation", "abstention"
NEUTRAL = 3


def extract_rating(response: Column, default: int | None = NEUTRAL) -> Column:
    """The first digit from 1 to 5 in a response; ``default`` if there is none, or for null."""
    found = F.regexp_extract(response, "[1-5]", 0).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def rating_of(response: Column, status: Column, default: int | None = NEUTRAL) -> Column:
    """``extract_rating`` of responses whose status is ok; errors give ``default`` whatever digits they hold."""
    return F.when(status == "ok", extract_rating(response, default)).otherwise(F.lit(default).cast("int"))


def oriented(rating: Column, polarity: str = "low") -> Column:
    return 6 - rating if polarity == "high" else rating


def distance_score(rating: Column, is_violation: Column) -> Column:
    """1 at the label's own end of the scale, 0 at the other."""
    return 1 - F.abs(rating - F.when(is_violation, 1).otherwise(5)) / 4.0


def accurate(avg: Column, is_violation: Column) -> Column:
    """The mean lies on the label's side of 3; exactly 3 is wrong for either label."""
    return F.when(is_violation, avg < NEUTRAL).otherwise(avg > NEUTRAL)


def says_violation(avg: Column, rule: str = "lt3") -> Column:
    """The binary prediction: ``lt3`` below 3, or ``gt2_5`` above 2.5, as one of the analyses has it."""
    return {"lt3": avg < 3, "gt2_5": avg > 2.5}[rule]


def right(avg: Column, is_violation: Column, rule: str = "lt3") -> Column:
    """Whether the binary prediction equals the label."""
    return says_violation(avg, rule) == is_violation


def class_of(rating: Column) -> Column:
    return F.when(rating <= 2, VIOLATION).when(rating >= 4, NO_VIOLATION).otherwise(F.when(rating.isNotNull(), ABSTENTION))


def direction(before: Column, after: Column) -> Column:
    """A lower rating is nearer to a violation."""
    return F.when(after < before, "toward_violation").when(after > before, "away_from_violation").otherwise("unchanged")


def change_category(before: Column, after: Column) -> Column:
    """Flipping crosses 3; else polarizing goes away from 3 and moderating towards it."""
    crosses = ((before < 3) & (after > 3)) | ((before > 3) & (after < 3))
    further = F.abs(after - 3) > F.abs(before - 3)
    return F.when(before == after, "unchanged").when(crosses, "flipping").when(further, "polarizing").otherwise("moderating")


def percent(share: Column, digits: int = 1) -> Column:
    """A share as a formatted percentage; null and NaN give two dashes."""
    return F.when(share.isNull() | F.isnan(share), "--").otherwise(F.format_string(f"%.{digits}f", share * 100))
