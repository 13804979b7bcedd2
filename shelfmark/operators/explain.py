"""Explanations: fixed comments by rule flags, repair of written ones, and the result's format and contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.rules import FLAMMABLE, SUPPLEMENT
from shelfmark.functions.text import let, text_of

# Lengths, wordings, verdicts and tags of the contract.
LEAST, MOST = 50, 300
FILLER = " Вердикт основан на данных карточки товара."
PLACEHOLDER = "Вердикт вынесен по названию, описанию и изображениям товара в соответствии с правилами его категории."
BELONGS, BANNED = "не бан", "бан"
COMMENT_TAG, VERDICT_TAG = "<комментарий>", "<вердикт>"
RESERVED = "(?iu)</?(?:комментарий|вердикт)>"
SHORT_ENDING = ". Решение принято по совокупности данных карточки товара."
BAN_WORD = r"(?iuU)(?<![а-яa-zё])не\s+бан|(?<![а-яa-zё])бан(?![а-яa-zё])"
SAYS_NO = r"(?iuU)не\s+относится|не\s+подходит\s+под\s+категори"
SAYS_YES = r"(?iuU)отнесён\s+к\s+категории\s+верно|действительно\s+относится|соответствует\s+(правилу\s+)?категори"

COMMENTS = {
    "supplement_marked": "В карточке прямо указана маркировка БАД или биологически активной добавки, поэтому товар соответствует правилу категории.",
    "supplement_other": "Совокупность данных карточки относит товар к биологически активным добавкам; признака исключённого спортивного питания не найдено.",
    "no_supplement_flower": "Карточка описывает средство из группы цветов Баха, а не товар с подтверждённой маркировкой биологически активной добавки.",
    "no_supplement_empty": "Продаётся таблетница, органайзер либо пустая капсула, а не сама биологически активная добавка с обязательной маркировкой.",
    "no_supplement_denied": "В карточке есть прямое указание, что продукт не является БАД; достаточного противоположного подтверждения в данных товара нет.",
    "no_supplement_sports": "Карточка описывает продукт спортивного питания, а явная подтверждённая маркировка биологически активной добавки отсутствует.",
    "no_supplement_other": "В тексте и доступной маркировке не подтверждено явное указание БАД или dietary supplement, необходимое по правилу этой категории.",
    "fire_included": "Карточка указывает, что газ, топливо либо горючий материал входит в продаваемый комплект, поэтому товар соответствует категории.",
    "fire_itself": "Товар является самостоятельным средством розжига, пиротехническим изделием либо горючим расходным материалом, а не пустым устройством.",
    "fire_other": "Совокупность данных карточки относит товар к горючему компоненту или самостоятельному источнику огня, входящему в комплект.",
    "no_fire_absent": "В карточке указано, что газ, топливо или иной горючий расходник не входит в комплект и должен приобретаться отдельно.",
    "no_fire_designed": "Продаётся устройство или насадка, предназначенная для отдельного баллона; сам газ либо другой горючий материал в комплект не включён.",
    "no_fire_built_in": "Упомянутый поджиг является встроенной частью устройства, а отдельный источник огня или горючий расходник в комплекте не подтверждён.",
    "no_fire_other": "Карточка описывает устройство, конструкцию или аксессуар; наличие самостоятельного горючего товара в продаваемом комплекте не подтверждено.",
    "any_category": "Вердикт получен по совокупному анализу данных карточки товара с учётом правил указанной категории и проверенных модельных сигналов.",
}

FACTS = [
    (("bad_marker",), "в карточке есть маркировка БАД"),
    (("not_bad",), "есть прямое указание, что товар не является БАД"),
    (("sports",), "товар выглядит как спортивное питание"),
    (("standalone",), "товар - самостоятельное горючее или пиротехника"),
    (("fuel", "included"), "топливо или газ входит в комплект"),
    (("empirical_absence_veto",), "топливо или газ в комплект не входит"),
]


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def comment_is_valid(comment: Column, pred: Column) -> Column:
    """Long enough, without the verdict's words, and not saying the opposite of the verdict."""
    return let(collapsed(text_of(comment)), lambda t: (F.length(t) >= LEAST) & ~t.rlike(BAN_WORD) & ~((pred == 1) & t.rlike(SAYS_NO)) & ~((pred == 0) & t.rlike(SAYS_YES)))


def _at_word(head: Column, whole: Column) -> Column:
    """head cut before its last word if enough is left, else whole."""
    words = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(head.contains(" ") & (F.length(words) >= LEAST), words).otherwise(whole)


def fit_length(comment: Column) -> Column:
    def shorter(t: Column) -> Column:
        cut = _at_word(F.left(t, F.lit(MOST + 1)), F.left(t, F.lit(MOST)))
        return F.when(F.length(t) > MOST, F.regexp_replace(cut, "[ ,;:-]+$", "")).otherwise(t)

    def longer(t: Column) -> Column:
        return F.when(F.length(t) < LEAST, F.concat(F.regexp_replace(t, "[ .]+$", ""), F.lit(SHORT_ENDING))).otherwise(t)

    return F.rtrim(F.left(let(let(collapsed(comment), shorter), longer), F.lit(MOST)))


def fallback_name(category: Column, pred: Column, flags: dict[str, Column], supplement: str = SUPPLEMENT, flammable: str = FLAMMABLE) -> Column:
    """Which of COMMENTS a card gets."""
    f = flags
    yes = F.when(f["strict_bad_marker"] | f["bad_marker"], "supplement_marked").otherwise("supplement_other")
    no = F.when(f["bach_flower"], "no_supplement_flower").when(f["empty_supplement_container"], "no_supplement_empty").when(f["not_bad"], "no_supplement_denied").when(f["sports"], "no_supplement_sports").otherwise("no_supplement_other")
    fire = F.when(f["fuel"] & f["included"], "fire_included").when(f["standalone"] | f["strict_positive_family"], "fire_itself").otherwise("fire_other")
    no_fire = F.when(f["empirical_absence_veto"] | f["absent"], "no_fire_absent").when(f["designed_for"], "no_fire_designed").when(f["built_in"], "no_fire_built_in").otherwise("no_fire_other")
    return F.when(category == supplement, F.when(pred == 1, yes).otherwise(no)).when(category == flammable, F.when(pred == 1, fire).otherwise(no_fire)).otherwise("any_category")


def comment_text(name: Column) -> Column:
    return fit_length(F.element_at(F.create_map(*[F.lit(x) for kv in COMMENTS.items() for x in kv]), name))


def repaired(raw: Column, pred: Column, fallback: Column) -> Column:
    return F.when(comment_is_valid(raw, pred), raw).otherwise(fallback)


def evidence_summary(quotes: Column, flags: dict[str, Column], component: Column | None = None) -> Column:
    """Quotes if there are any, else up to three facts, else nothing."""
    said = F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("«"), q["quote"], F.lit("» ("), q["label"], F.lit(")"))), "; ")
    chosen = []
    for names, fact in FACTS:
        both = flags[names[0]]
        for n in names[1:]:
            both = both & flags[n]
        chosen.append(F.when(both, F.lit(fact)))
    if component is not None:
        chosen.append(F.when(component, F.lit("это аксессуар или негорючий компонент")))
    facts = F.slice(F.filter(F.array(*chosen), lambda x: x.isNotNull()), 1, 3)
    return F.when(F.size(quotes) > 0, F.concat(F.lit("В карточке указано: "), said, F.lit("."))).when(F.size(facts) > 0, F.concat(F.lit("Основания: "), F.array_join(facts, "; "), F.lit("."))).otherwise("")


def patch_comment(raw: Column) -> Column:
    """One line of LEAST to MOST characters: reserved tags out, blanks collapsed, filled up or cut at a word."""
    text = let(collapsed(F.regexp_replace(text_of(raw), RESERVED, " ")), lambda t: F.when(t == "", F.lit(PLACEHOLDER)).otherwise(t))
    for _ in range(-(-LEAST // len(FILLER))):
        text = let(text, lambda t: F.when(F.length(t) < LEAST, F.concat(t, F.lit(FILLER))).otherwise(t))
    return let(text, lambda t: F.when(F.length(t) > MOST, F.rtrim(_at_word(F.left(t, F.lit(MOST)), F.left(t, F.lit(MOST))))).otherwise(t))


def verdict(pred: Column) -> Column:
    return F.when(F.coalesce(pred.cast("string").try_cast("int") == 1, F.lit(False)), BELONGS).otherwise(BANNED)


def format_result(comment: Column, pred: Column) -> Column:
    return F.concat(F.lit(COMMENT_TAG), patch_comment(comment), F.lit(VERDICT_TAG), verdict(pred))


def result_is_valid(result: Column) -> Column:
    """Whether a result keeps the contract: tags, length, one line, no reserved tag inside."""
    comment = F.regexp_extract(result, f"(?s)^{COMMENT_TAG}(.*?){VERDICT_TAG}(?:{BANNED}|{BELONGS})$", 1)
    shape = result.rlike(f"(?s)\\A{COMMENT_TAG}.*?{VERDICT_TAG}(?:{BANNED}|{BELONGS})\\z")
    return F.coalesce(shape & F.length(comment).between(LEAST, MOST) & ~comment.rlike("[\\r\\n]") & ~comment.rlike(RESERVED), F.lit(False))


def contract(expected: DataFrame, results: DataFrame) -> DataFrame:
    """One row of counts: expected ids, results, ids missing, unknown or repeated, results that break the contract, and ok."""
    e = expected.select(F.col("id").cast("string").alias("id"), F.lit(1).alias("e"), F.lit(0).alias("r"), F.lit(0).alias("bad"))
    r = results.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("e"), F.lit(1).alias("r"), (~result_is_valid(F.col("result"))).cast("int").alias("bad"))
    by = e.unionByName(r).groupBy("id").agg(F.sum("e").alias("e"), F.sum("r").alias("r"), F.sum("bad").alias("bad"))
    out = by.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("r"), F.lit(0)).alias("n_results"), F.count_if((F.col("e") > 0) & (F.col("r") == 0)).alias("n_missing"), F.count_if((F.col("e") == 0) & (F.col("r") > 0)).alias("n_unknown"), F.count_if(F.col("r") > 1).alias("n_repeated"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_invalid"))
    return out.withColumn("ok", (F.col("n_expected") == F.col("n_results")) & (F.col("n_missing") + F.col("n_unknown") + F.col("n_repeated") + F.col("n_invalid") == 0))


def moved(expected: DataFrame, results: DataFrame) -> DataFrame:
    """(pos, expected_id, id) where the results (pos, id) aren't the input's sequence: another id, none, or one too many."""
    e = expected.select("pos", F.col("id").cast("string").alias("expected_id"))
    r = results.select("pos", F.col("id").cast("string").alias("id"))
    return e.join(r, "pos", "full").where(~F.col("expected_id").eqNullSafe(F.col("id")))
