"""The decision pipeline: one DataFrame through layers, the weakest first; a layer without its table changes nothing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import rules, scores
from shelfmark.functions import text as tx
from shelfmark.operators import explain, transfer


@dataclass
class Tables:
    """Optional inputs of the layers."""

    templates: DataFrame | None = None
    brands: DataFrame | None = None
    priors: DataFrame | None = None
    negatives: DataFrame | None = None
    blend: DataFrame | None = None
    knn: DataFrame | None = None  # id, knn_decision, knn_reason
    images: DataFrame | None = None  # id, image_decision, image_reason


@dataclass
class Options:
    """Thresholds by category key, the rule bank, and the least template group."""

    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.5
    bank: rules.Bank = field(default_factory=rules.Bank)
    min_group: int = transfer.MIN_GROUP


def prepared(cards: DataFrame) -> DataFrame:
    """Adds the normalised fields name_n and desc_n."""
    return cards.withColumn("name_n", tx.normalize(F.col("name"))).withColumn("desc_n", tx.normalize(F.col("description")))


def text_layer(cards: DataFrame, o: Options, t: Tables) -> DataFrame:
    """text_prob to prob, pred and reason: negative descriptions lower the score, strict positives and then the veto settle it."""
    if t.negatives is not None:
        cards = transfer.with_negative_description(cards, t.negatives)
    else:
        cards = cards.withColumn("negative_description", F.lit(False))
    p = F.coalesce(F.col("text_prob"), F.lit(0.0))
    p = F.when(F.col("negative_description"), F.least(p, F.lit(scores.SURE))).otherwise(p)
    cut = F.lit(o.default_threshold)
    for key, value in o.thresholds.items():
        cut = F.when(tx.category_key(F.col("category")) == key, F.lit(value)).otherwise(cut)
    fields = (F.col("category"), F.col("name_n"), F.col("desc_n"))
    cards = cards.withColumn("prob", p).withColumn("pred", (F.col("prob") >= cut).cast("int"))
    cards = cards.withColumn("veto", rules.absence_veto(o.bank, *fields)).withColumn("strict", rules.strict_positive(o.bank, *fields))
    settled = F.when(F.col("veto"), 0).when(F.col("strict"), 1)
    prob = F.when(F.col("veto"), F.least(F.col("prob"), F.lit(scores.SURE))).when(F.col("strict"), F.greatest(F.col("prob"), F.lit(1.0 - scores.SURE))).otherwise(F.col("prob"))
    return cards.withColumn("pred", F.coalesce(settled, "pred")).withColumn("prob", prob).withColumn("reason", F.when(F.col("veto"), "veto").when(F.col("strict"), "strict_positive").otherwise("text_model"))


def blend_layer(cards: DataFrame, t: Tables) -> DataFrame:
    """Blends vlm_prob and the brand's share in; without a configuration or a vlm_prob the text decision stays."""
    if t.blend is None or "vlm_prob" not in cards.columns:
        return cards
    if t.brands is not None:
        cards = transfer.with_brand_prob(cards, t.brands, t.priors)
    else:
        cards = cards.withColumn("brand_prob", F.lit(0.5))
    b = t.blend.select(F.col("category_key").alias("_k"), "weight", "cut", (F.col("brand_weight") if t.brands is not None else F.lit(0.0)).alias("brand_weight"))
    out = cards.join(b, tx.category_key(F.col("category")) == F.col("_k"), "left")
    mixed = F.when(F.col("weight").isNotNull() & F.col("vlm_prob").isNotNull(), scores.blend(F.col("prob"), F.col("vlm_prob"), F.col("brand_prob"), F.col("weight"), F.col("brand_weight")))
    out = out.withColumn("_mixed", mixed)
    out = out.withColumn("pred", F.when(F.col("_mixed").isNotNull(), (F.col("_mixed") >= F.col("cut")).cast("int")).otherwise(F.col("pred"))).withColumn("reason", F.when(F.col("_mixed").isNotNull(), "blend").otherwise(F.col("reason"))).withColumn("prob", F.coalesce("_mixed", "prob"))
    return out.drop("_k", "weight", "cut", "brand_weight", "_mixed", "brand_prob")


def _override(cards: DataFrame, decision: str, reason: str) -> DataFrame:
    d = F.col(decision)
    return cards.withColumn("prob", F.coalesce(scores.override_prob(d), "prob")).withColumn("reason", F.when(d.isNotNull(), F.col(reason)).otherwise(F.col("reason"))).withColumn("pred", F.coalesce(d, "pred"))


def template_layer(cards: DataFrame, o: Options, t: Tables) -> DataFrame:
    if t.templates is None:
        return cards
    out = transfer.template_transfer(cards, t.templates, o.min_group)
    return _override(out, "decision", "transfer_reason").drop("decision", "transfer_reason", "transfer_prob")


def evidence_layer(cards: DataFrame, table: DataFrame | None, kind: str) -> DataFrame:
    """Decisions by id from a table (id, <kind>_decision, <kind>_reason)."""
    if table is None:
        return cards
    e = table.select(F.col("id").alias("_eid"), f"{kind}_decision", f"{kind}_reason")
    out = cards.join(e, F.col("id") == F.col("_eid"), "left")
    return _override(out, f"{kind}_decision", f"{kind}_reason").drop("_eid", f"{kind}_decision", f"{kind}_reason")


def explain_layer(cards: DataFrame, o: Options) -> DataFrame:
    """Adds result: the written comment if it is valid, else the fixed one, in the contract's format."""
    # Each step is a projection of its own, which the optimizer doesn't inline where a result is used more than once.
    flags = rules.evidence_flags(o.bank, F.col("name_n"), F.col("desc_n"))
    rows = cards.withColumn("_flags", F.struct(*[c.alias(k) for k, c in flags.items()]))
    rows = rows.withColumn("_which", explain.fallback_name(F.col("category"), F.col("pred"), {k: F.col("_flags")[k] for k in flags}, o.bank.supplement, o.bank.flammable))
    raw = F.col("raw_comment") if "raw_comment" in cards.columns else F.lit(None).cast("string")
    rows = rows.withColumn("_comment", explain.repaired(raw, F.col("pred"), explain.comment_text(F.col("_which"))))
    return rows.withColumn("result", explain.format_result(F.col("_comment"), F.col("pred"))).drop("_flags", "_which", "_comment")


def decide(cards: DataFrame, options: Options | None = None, tables: Tables | None = None) -> DataFrame:
    """All layers over cards with name_n and desc_n: text, blend, templates, neighbours, images; then the result.

    Works on a streaming DataFrame as well: every layer is a projection or a join with a static table.
    """
    o, t = options or Options(), tables or Tables()
    out = template_layer(blend_layer(text_layer(cards, o, t), t), o, t)
    return explain_layer(evidence_layer(evidence_layer(out, t.knn, "knn"), t.images, "image"), o)


def fallback_results(cards: DataFrame) -> DataFrame:
    """A valid placeholder result for every card."""
    return cards.select("pos", "id", explain.format_result(F.lit(""), F.lit(0)).alias("result"))
