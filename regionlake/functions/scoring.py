"""Classes and scores of regions as Columns.

Pixel features are columns has_integral, has_sum, has_fraction, has_matrix, has_root, has_greek, has_sup, has_sub,
aspect, density, vertical_complexity, edge_density, uniformity, has_grid; text features are math_symbols,
greek_count, math_font, has_fraction, has_scripts, has_root, has_large_ops, has_brackets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import LevelParams
from .barrier import settle

c = F.col
STRONG = ("has_integral", "has_sum", "has_fraction", "has_matrix")
MEDIUM = ("has_greek", "has_sup", "has_sub", "has_root")
ANY_MATH = STRONG + MEDIUM
STRUCTURAL = tuple(f for f in ANY_MATH if f != "has_greek")

# fixed values: (class, scores of formula, image, table, text, reasons) of the exclusion rules in order
EXCLUSIONS = (
    ("text", (0.01, 0.01, 0.01, 0.97), ("检测为标题：宽度过大，高度较小，无数学符号特征", "高度统一", "线性布局", "无数学符号")),
    ("text", (0.02, 0.02, 0.02, 0.94), ("检测为作者信息：短文本，无数学符号",)),
    ("text", (0.03, 0.02, 0.05, 0.9), ("检测为图片说明：文本特征明显，无复杂数学结构",)),
    ("text", (0.05, 0.05, 0.05, 0.85), ("检测为文本段落：宽度大，无明显数学特征", "线性布局", "无数学符号")),
    ("image", (0.02, 0.94, 0.02, 0.02), ("像素密度高", "边缘密度低", "连续色调", "无明显数学符号")),
)
CLASSES = ("formula", "image", "table", "text")


def points(flag: Column, value: float) -> Column:
    return F.when(flag, F.lit(float(value))).otherwise(F.lit(0.0))


def total(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def any_of(names) -> Column:
    return reduce(lambda a, b: a | b, [c(n) for n in names])


def count_of(names) -> Column:
    return total([c(n).cast("int") for n in names])


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


# --- X3
def level(score: Column, p: LevelParams = LevelParams()) -> Column:
    return F.when(score >= p.high, "high").when(score >= p.low, "medium").otherwise("low")


# --- F13
def complexity() -> Column:
    n = count_of(("has_fraction", "has_scripts", "has_root", "has_large_ops", "has_brackets"))
    return F.when(n >= 3, "complex").when(n >= 1, "medium").otherwise("simple")


# --- F14
def text_features_of_pixels() -> dict[str, Column]:
    large = c("has_integral") | c("has_sum")
    return {
        "math_symbols": F.when(large, 5).otherwise(0), "greek_count": F.when(c("has_greek"), 3).otherwise(0),
        "operator_count": F.when(large, 2).otherwise(0), "math_font": c("has_greek"),
        "has_scripts": c("has_sup") | c("has_sub"), "has_large_ops": large, "has_brackets": c("has_matrix"),
    }


def has_structure() -> Column:
    return any_of(STRUCTURAL)


def has_math_signal() -> Column:
    """Any symbol, font, Greek letter or structure among the text features."""
    return (
        (c("math_symbols") > 0) | c("math_font") | (c("greek_count") > 0)
        | any_of(("has_fraction", "has_scripts", "has_root", "has_large_ops"))
    )


# --- X1
def feature_match(content_class: Column) -> Column:
    score = (
        total([points(c(f), 0.25) for f in STRONG]) + total([points(c(f), 0.125) for f in MEDIUM])
        + points(c("vertical_complexity") > 0.3, 0.1)
        + points((c("density") > 0.05) & (c("density") < 0.5), 0.1)
    )
    return F.when(content_class == "formula", F.least(F.lit(1.0), score)).otherwise(F.lit(0.5))


def context_consistency(kind: Column, kind_confidence: Column) -> Column:
    vc = c("vertical_complexity")
    display = points(c("h") > 30, 0.2) + points(vc > 0.3, 0.15)
    inline = points(c("h") < 30, 0.2) + points(vc < 0.5, 0.15)
    return F.least(F.lit(1.0), 0.5 + F.when(kind == "display", display).otherwise(inline) + kind_confidence * 0.15)


def pixel_confidence(content_class: Column, certainty: Column, tightness: Column, kind: Column,
                     kind_confidence: Column) -> Column:
    return (
        feature_match(content_class) * 0.4 + certainty * 0.3 + tightness * 0.2
        + context_consistency(kind, kind_confidence) * 0.1
    )


# --- X2
def text_confidence(page_type: Column, density: Column, text_quality: Column) -> Column:
    feature = F.least(F.lit(1.0), F.least(F.lit(0.5), c("math_symbols") * 0.1) + points(c("math_font"), 0.2)
                      + F.least(F.lit(0.3), c("greek_count") * 0.05))
    structure = F.least(F.lit(1.0), points(c("has_fraction"), 0.3) + points(c("has_scripts"), 0.2)
                        + points(c("has_root") | c("has_large_ops"), 0.3) + points(c("has_brackets"), 0.2))
    context = F.least(F.lit(1.0), points(page_type.isin("academic", "textbook"), 0.2)
                      + F.when(c("kind").isin("display", "numbered"), 0.3).when(c("kind") == "inline", 0.2).otherwise(0.0)
                      + points(density > 0.1, 0.2) + text_quality * 0.3)
    w, h = c("w"), c("h")
    fit = (F.when(w.between(20, 500) & h.between(10, 200), 0.3).when((w < 20) | (h < 10), -0.2)
           .when((w > 500) | (h > 200), -0.1).otherwise(0.0))
    aspect = F.try_divide(w, h)
    boundary = clamp01(fit + points(F.coalesce(aspect.between(1, 10), F.lit(False)), 0.4) + 0.3)
    return clamp01(feature * 0.4 + structure * 0.3 + context * 0.2 + boundary * 0.1)


# --- X6
def classify_content(df: DataFrame, reasons: bool = True) -> DataFrame:
    """Add content_class, certainty, score_<class> and (optionally) reasoning.

    Built in steps, each a projection, so that scores are computed once; the result is settled for later filters.  The
    raw formula score is never 0, so the sum is positive and the class follows from the raw scores.
    """
    w, h, dens, vc, ar = c("w"), c("h"), c("density"), c("vertical_complexity"), c("aspect")
    ratio = w / h
    math = any_of(ANY_MATH)
    complex_math = any_of(("has_fraction", "has_matrix", "has_root")) | (c("has_sup") & c("has_sub"))
    rules = (
        (ratio >= 3) & (h <= 50) & ~math & (dens <= 0.3),
        (w <= 400) & (h <= 40) & ~math & (dens <= 0.25),
        (ratio >= 2) & (h <= 60) & ~complex_math & (vc <= 0.3),
        (w >= 200) & (ratio >= 2) & ~math & (vc <= 0.4),
        (w >= 150) & (h >= 150) & (dens >= 0.5) & (c("edge_density") <= 0.4)
        & ~any_of(("has_greek", "has_sup", "has_sub")),
    )
    rule = reduce(lambda acc, r: acc.when(r[1], r[0] + 1), list(enumerate(rules))[1:], F.when(rules[0], 1))
    raw = class_scores(vc, dens, ar)
    out = df.withColumns({"_rule": rule} | {f"_raw{i}": s for i, s in enumerate(raw)})
    by_rule = lambda values: F.element_at(F.array(*map(F.lit, values)), c("_rule"))
    out = out.withColumns({
        "_sum": total([c(f"_raw{i}") for i in range(4)]), "_best": F.greatest(*[f"_raw{i}" for i in range(4)])})
    winner = reduce(lambda acc, i: acc.when(c(f"_raw{i}") == c("_best"), CLASSES[i]), (1, 2),
                    F.when(c("_rule").isNotNull(), by_rule([e[0] for e in EXCLUSIONS])).when(
                        c("_raw0") == c("_best"), CLASSES[0])).otherwise(CLASSES[3])
    share = lambda fixed, value: F.when(c("_rule").isNotNull(), by_rule(fixed)).otherwise(F.try_divide(value, c("_sum")))
    out = out.withColumns({
        "content_class": winner, "certainty": share([max(e[1]) for e in EXCLUSIONS], c("_best")),
    } | {f"score_{n}": share([e[1][i] for e in EXCLUSIONS], c(f"_raw{i}")) for i, n in enumerate(CLASSES)})
    if reasons:
        fixed = F.element_at(F.array(*[F.array(*map(F.lit, e[2])) for e in EXCLUSIONS]), c("_rule"))
        out = out.withColumn("reasoning", F.when(c("_rule").isNotNull(), fixed).otherwise(
            class_reasons(c("content_class"), c("certainty"))))
    return settle(out.drop("_rule", "_sum", "_best", *[f"_raw{i}" for i in range(4)]))


def class_scores(vc: Column, dens: Column, ar: Column) -> list[Column]:
    """Formula, image, table and text scores before normalisation."""
    medium = count_of(("has_sup", "has_sub", "has_root"))
    strong = any_of(STRONG + ("has_root",))
    bonus = (points(vc >= 0.3, 0.15) + points(c("has_sup") & c("has_sub"), 0.1)
             + points(c("has_sup") | c("has_sub"), 0.05))
    with_strong = 0.5 + total([
        points(c("has_integral"), 0.15), points(c("has_sum"), 0.15), points(c("has_fraction"), 0.1),
        points(c("has_matrix"), 0.1), points(c("has_root"), 0.1)])
    formula = (
        F.when(strong, F.least(F.lit(1.0), with_strong + bonus))
        .when(medium == 0, F.when(c("has_greek"), 0.08).otherwise(0.05))
        .otherwise(F.least(F.lit(1.0), 0.25 + medium * 0.2 + points(c("has_greek"), 0.05) + bonus))
    )
    image = (points((dens > 0.6) & (c("edge_density") < 0.3), 0.5) + points((c("w") > 200) & (c("h") > 200), 0.3)
             + points(~any_of(("has_greek", "has_sup", "has_sub", "has_fraction")), 0.2))
    table = (points(c("has_grid"), 0.6) + points((vc > 0.5) & (ar > 1), 0.2)
             + points((dens > 0.2) & (dens < 0.5), 0.2))
    plain = points(vc < 0.3, 0.4) + points((ar > 2) & (ar < 10), 0.3) + points(~any_of(STRONG), 0.3)
    text = clamp01(F.when(any_of(STRUCTURAL), plain * 0.6).otherwise(plain))
    return [formula, F.least(F.lit(1.0), image), F.least(F.lit(1.0), table), text]


def class_reasons(cls: Column, conf: Column) -> Column:
    """Reasons in order; the last one is the certainty in per cent."""
    vc = c("vertical_complexity")
    # fixed values: texts of the reasons
    per_class = {
        "formula": [
            (c("has_integral"), "包含积分符号"), (c("has_sum"), "包含求和符号"), (c("has_fraction"), "包含分数线"),
            (c("has_matrix"), "检测到矩阵括号"), (c("has_root"), "包含根号"), (c("has_greek"), "检测到希腊字母"),
            (c("has_sup") & c("has_sub"), "检测到上下标"), (vc >= 0.3, "垂直结构复杂")],
        "text": [(vc < 0.3, "线性布局"), (c("aspect") > 2, "横向文本"), (c("uniformity") > 0.8, "高度统一"),
                 (~any_of(STRONG), "无数学符号")],
        "image": [(c("density") > 0.4, "像素密度高"), (c("edge_density") < 0.3, "边缘密度低"), (F.lit(True), "连续色调"),
                  (~any_of(("has_integral", "has_sum", "has_greek")), "无明显数学符号")],
        "table": [(c("has_grid"), "检测到网格线结构"), (F.lit(True), "规则布局"), (vc > 0.5, "多行结构")],
    }
    percent = F.concat(F.lit("置信度: "), F.floor(conf * 100 + 0.5).cast("string"), F.lit("%"))
    lists = [F.array(*[F.when(cond, F.lit(t)) for cond, t in items], percent) for items in per_class.values()]
    picked = F.when(cls == "formula", lists[0]).when(cls == "text", lists[1]).when(cls == "image", lists[2]).otherwise(lists[3])
    return F.array_compact(picked)
