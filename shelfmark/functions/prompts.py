"""Prompts for the model-backed columns, assembled as Columns; system and example messages are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.text import text_of
from shelfmark.operators.explain import BANNED, BELONGS

# Cuts and wordings.
TEXT_CHARS, DESCRIPTION_CHARS = 2400, 700
MEANS_BELONGS = "товар ДЕЙСТВИТЕЛЬНО относится к категории «{}»"
MEANS_BANNED = "товар НЕ относится к категории «{}» и попал в неё ошибочно"
ASK = "Напиши одно предложение для проверяющего сотрудника: объясни вердикт и ОБЯЗАТЕЛЬНО назови конкретные слова из карточки, на которых он основан. Не пиши общих формулировок - укажи, что именно написано в этом товаре. Вердикт менять нельзя."
NO_RULE = "правила площадки"
QUESTION = "Относится ли товар к категории? Ответь одним словом: да или нет."


def _meaning(pred: Column, category: Column) -> Column:
    around = lambda t: F.concat(F.lit(t.split("{}")[0]), category, F.lit(t.split("{}")[1]))
    return F.when(pred == 1, around(MEANS_BELONGS)).otherwise(around(MEANS_BANNED))


def comment_prompt(category: Column, text: Column, pred: Column, evidence: Column) -> Column:
    category, pred = text_of(category), F.coalesce(pred, F.lit(0))
    verdict = F.when(pred == 1, BELONGS).otherwise(BANNED)
    return F.concat(F.lit("Категория проверки: "), category, F.lit(".\nКарточка товара: "), F.left(text_of(text), F.lit(TEXT_CHARS)), F.lit("\n\nВердикт проверки: "), verdict, F.lit(" - это значит, что "), _meaning(pred, category), F.lit(". "), evidence, F.lit("\n" + ASK))


def rules_of(versions: dict[str, dict[str, str]], version: str | None = None) -> dict[str, str]:
    """The rule texts of a version (without one, the first): scoring asks as training did, so an unknown version is an error."""
    version = next(iter(versions)) if version is None else version
    if version not in versions:
        raise ValueError(f"no rules of version {version}")
    return versions[version]


def card_prompt(category: Column, name: Column, description: Column, rules: dict[str, str]) -> Column:
    """The yes-or-no question about a card; rules gives the text of each category's rule."""
    rule = F.lit(NO_RULE)
    for c, t in rules.items():
        rule = F.when(category == c, F.lit(t)).otherwise(rule)
    return F.concat(F.lit("Категория проверки: "), text_of(category), F.lit(".\nПравило: "), rule, F.lit(".\nНазвание: "), text_of(name), F.lit("\nОписание: "), F.left(text_of(description), F.lit(DESCRIPTION_CHARS)), F.lit("\n" + QUESTION))


def messages(user: Column, system: str, examples: list[tuple[str, str]] = ()) -> Column:
    """array<struct<role,content>>: the system text, example exchanges, and the user's message."""
    said = [F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))]
    for question, answer in examples:
        said += [F.struct(F.lit("user").alias("role"), F.lit(question).alias("content")), F.struct(F.lit("assistant").alias("role"), F.lit(answer).alias("content"))]
    return F.array(*said, F.struct(F.lit("user").alias("role"), user.alias("content")))
