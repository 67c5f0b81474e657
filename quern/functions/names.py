"""How alike two names are, and what kind a place is, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import text as T

#: Marks before a part of a name, brackets that count as round ones, and general endings of names.
SEPARATORS = "-－—·(（_"
BRACKETS = ("（）〔〕【】", "()()()")
ENDINGS = ("风景区", "博物院", "博物馆", "公园", "景区", "遗址", "故里", "古镇", "广场")
EXACT_BONUS, CONTAINS_BONUS = 0.20, 0.12
#: Type codes by what a place is to a traveller, and names of places that are no destination.
NO_DESTINATION_NAMES = "乘车点|上车点|售票处|检票处|停车场|卫生间|厕所"
NO_DESTINATION_CODES = ("15", "07", "20", "12", "13", "16", "17", "18")
DESTINATION_CODES = ("11", "14", "08")
STREET_CODE, SHOP_CODE, PLACE_CODE = "061001", "06", "19"
#: Places to eat, by code and by name of type, and marks that no shop's name has.
FOOD_CODE, FOOD_TYPE, NO_SHOP_MARKS = "05", "餐饮", "[与、＋+/]"


def stem(name: Column) -> Column:
    """The name without a general ending."""
    out = F.when(F.lit(False), name)
    for ending in ENDINGS:
        out = out.when((F.length(name) > len(ending) + 1) & name.endswith(ending), F.left(name, F.length(name) - len(ending)))
    return out.otherwise(name)


def after_separator(part: Column, name: Column) -> Column:
    """Whether the part stands in the name as a whole section after a separator."""
    marks = f"[{SEPARATORS}]".replace("-", "\\-", 1)
    quoted = F.concat(F.lit(marks + r"\Q"), part, F.lit(rf"\E({marks}|$)"))
    return (part != "") & name.contains(part) & F.regexp_like(name, quoted)  # a pattern for each row is costly


def rule_score(a: Column, b: Column) -> Column:
    """Likeness that the rules decide, null where only the letters can tell."""
    left, right = T.strip(a), T.strip(b)
    return stripped_score(left, right, stem(left), stem(right))


def stripped_score(left: Column, right: Column, left_stem: Column, right_stem: Column) -> Column:
    """rule_score() of names without white space at either end, and their stems. Columns that were computed before save doing so for each pair and rule."""
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when(F.translate(left, *BRACKETS) == F.translate(right, *BRACKETS), 1.0)
        .when(left_stem == right_stem, 0.95)
        .when((right.contains(left) | left.contains(right)) & (F.least(F.length(left), F.length(right)) >= 3), 0.90)
        .when(after_separator(left, right) | after_separator(right, left), 0.90)
    )


@F.pandas_udf(DoubleType())
def letter_score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Likeness by matching blocks, for names that no rule decides."""
    for left, right in pairs:
        yield pd.Series([round(0.8 * SequenceMatcher(None, a.strip(), b.strip(), autojunk=False).ratio(), 4) for a, b in zip(left, right)], dtype=float)


def rank_bonus(mention: Column, name: Column) -> Column:
    left, right = T.strip(mention), T.strip(name)
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when((left == right) | after_separator(left, right), EXACT_BONUS)
        .when((F.length(left) >= 3) & right.contains(left), CONTAINS_BONUS)
        .when((F.length(right) >= 3) & left.contains(right), CONTAINS_BONUS)
        .otherwise(0.0)
    )


def _starts(code: Column, codes: tuple[str, ...]) -> Column:
    return F.left(code, F.lit(2)).isin(*codes)


def place_kind(code: Column, kind: Column, name: Column) -> Column:
    """destination, place_name or irrelevant."""
    code, kind = T.strip(F.coalesce(code, F.lit(""))), T.strip(F.coalesce(kind, F.lit("")))
    by_code = (
        F.when(_starts(code, (PLACE_CODE,)), "place_name")
        .when(code == STREET_CODE, "destination")
        .when(_starts(code, (*NO_DESTINATION_CODES, SHOP_CODE)), "irrelevant")
        .when(_starts(code, DESTINATION_CODES), "destination")
        .otherwise("irrelevant")
    )
    by_kind = (
        F.when(kind.startswith("地名地址信息"), "place_name")
        .when(kind.contains("特色商业街") | kind.startswith("风景名胜") | kind.startswith("科教文化服务") | kind.startswith("体育休闲服务"), "destination")
        .otherwise("irrelevant")
    )
    return F.when(F.coalesce(name, F.lit("")).rlike(NO_DESTINATION_NAMES), "irrelevant").when(code != "", by_code).otherwise(by_kind)


def is_food(code: Column, kind: Column) -> Column:
    """Whether a place is one to eat at."""
    code, kind = T.strip(F.coalesce(code, F.lit(""))), T.strip(F.coalesce(kind, F.lit("")))
    return F.when(code != "", code.startswith(FOOD_CODE)).otherwise(kind.startswith(FOOD_TYPE))


def looks_like_a_shop(name: Column) -> Column:
    return ~name.rlike(NO_SHOP_MARKS)
