"""LaTeX, text signs, differences, classes and kinds."""

import random
import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from regionlake.functions import latex as lx
from regionlake.functions import placement, scoring
from regionlake.operators import corpus


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.withColumn("o", fn(F.col("s"))).orderBy("i").collect()]


def test_extract(spark):
    assert apply(spark, lx.extract_latex, ["```latex\n a+b \n```", "x ```\nc\n``` y", "p $$ d \n e $$", "q $f$ r", "  plain "]) == [
        "a+b", "c", "d \n e", "f", "plain"]
    assert apply(spark, lx.extract_all_math, ["a $x$ b $$y$$", "```latex z ```", " t "]) == ["x\ny", "z", "t"]
    assert apply(spark, lx.unwrap_model_output, ["```latex\nx\n```", "$$y$$", "$z$", "\\[ w \\]", "$"]) == ["x", "y", "z", "w", ""]


def test_normalize(spark):
    assert apply(spark, lx.normalize_latex, ["$α ≤  β$", "90°", "f′", "a·b"]) == [
        r"\alpha \leq \beta", r"90^{\circ}", "f'", r"a \cdot b"]
    assert apply(spark, lx.text_to_latex, ["a/b × 2"]) == [r"\frac{a}{b} \times 2"]


@pytest.mark.parametrize("text,good", [
    ("x^2", True), ("{a", False), ("a}", False), ("}{", False), (r"\frac{a}{b}", True), (r"\sqrt{a", False), ("$$x$$", False),
    (r"\begin{a} x \end{a}", True), (r"\begin{a} x", False), (r"\end{a} \begin{a}", False), ("(a]", False), ("", True)])
def test_validate(spark, text, good):
    assert apply(spark, lx.validate_latex, [text]) == [good]


def test_convert(spark):
    assert apply(spark, lx.to_unicode, [
        r"\alpha + \infty \in x", r"x^{2n} + y_{ij}", "x^2_1", r"\frac{a}{b}", r"\foo{x}", r"\simeq \sim", "a  b"]) == [
        "α + ∞ ∈ x", "x²ⁿ + yᵢⱼ", "x²₁", "(a)/(b)", "x", "≃ ∼", "a b"]
    assert apply(spark, lx.to_markdown, [" x "]) == ["$$\nx\n$$"]
    assert "a &lt; b &amp; c" in apply(spark, lx.to_mathml, ["a < b & c"])[0]
    assert apply(spark, lx.unknown_commands, [r"\foo \alpha \frac{a}{b}"]) == [["\\foo"]]


def test_likely(spark):
    assert apply(spark, lx.likely_latex, ["x+1", "Sorry, no", "word salad", "abc", "", "图片模糊 x=1"]) == [
        True, False, False, True, False, False]


def longest_common(a, b):
    """By definition: drop a character of either text, or keep one that both begin with."""
    @cache
    def best(a, b):
        if not a or not b:
            return 0
        return 1 + best(a[1:], b[1:]) if a[0] == b[0] else max(best(a[1:], b), best(a, b[1:]))

    return best(a, b)


def test_differences(spark):
    rnd = random.Random(3)
    pairs = [("".join(rnd.choices("abc", k=rnd.randint(0, 12))), "".join(rnd.choices("abcd", k=rnd.randint(0, 12)))) for _ in range(300)]
    for a, b in pairs:
        most = longest_common(a, b)
        assert corpus.common_length(a, b) == most
        seg = corpus.segments(a, b)
        assert "".join(t for k, t in seg if k != "added") == a and "".join(t for k, t in seg if k != "removed") == b
        assert sum(len(t) for k, t in seg if k == "unchanged") == most
        assert all(x[0] != y[0] for x, y in zip(seg, seg[1:]))
    df = spark.createDataFrame(pairs[:50], "original string, modified string")
    for r in corpus.diff_stats(df).collect():
        n = longest_common(r.original, r.modified)
        assert (r.unchanged, r.removed, r.added) == (n, len(r.original) - n, len(r.modified) - n)


def test_every_command_of_the_tables(spark):
    """Entries as literals of their own, so that a wrong one in the tables shows."""
    symbols = "·×÷±∓≤≥≠≈∞∫∑∏√∂∇αβγδεζηθικλμνξπρστυφχψωΓΔΘΛΞΠΣΦΨΩ→←↔⇒⇐⇔∈∉⊂⊃⊆⊇∪∩∅∀∃¬∧∨⊥∥"
    names = ("cdot times div pm mp leq geq neq approx infty int sum prod sqrt partial nabla alpha beta gamma delta varepsilon zeta eta "
             "theta iota kappa lambda mu nu xi pi rho sigma tau upsilon varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi "
             "Psi Omega rightarrow leftarrow leftrightarrow Rightarrow Leftarrow Leftrightarrow in notin subset supset subseteq "
             "supseteq cup cap emptyset forall exists neg land lor perp parallel").split()
    assert len(symbols) == len(names)
    got = apply(spark, lx.normalize_latex, [f"a {s} b" for s in symbols])
    assert [g.split() for g in got] == [["a", "\\" + n, "b"] for n in names]


@pytest.mark.parametrize("limit", [1000, 3])
def test_math_hint(spark, limit):
    rnd = random.Random(5)
    pieces = ["a", "=", "b", " ", "x ^", "2", "_", "1", "_{", "k", "}", r"\alpha", "∑", "word", "."]
    docs = {d: [rnd.choice(pieces) for _ in range(rnd.randint(1, 7))] for d in range(150)}
    pats = [r"[∑∫∞≈≠≤≥√]", r"[A-Za-z0-9]\s*=\s*[A-Za-z0-9]", r"[A-Za-z0-9]\s*\^\s*\d", r"[A-Za-z0-9]\s*_\s*\d", r"_\{[^}]+\}", r"\\(frac|alpha)"]
    want = {d: any(re.search(p, " ".join(t)) for p in pats) for d, t in docs.items()}
    df = spark.createDataFrame([(d, i, s) for d, t in docs.items() for i, s in enumerate(t)], "doc_id int, line_no int, str string")
    assert {r.doc_id: r.hint for r in corpus.page_math_hint(df, limit=limit).collect()} == want


def test_page_text_parts(spark):
    df = spark.createDataFrame([(1, i, f"w{i}") for i in range(7)], "doc_id int, line_no int, str string")
    parts = corpus.page_text(df, part_rows=3).orderBy("part_no").collect()
    assert [p.text for p in parts] == ["w0 w1 w2", "w3 w4 w5", "w6"]


FLAGS = ["has_integral", "has_sum", "has_fraction", "has_matrix", "has_root", "has_greek", "has_sup", "has_sub", "has_grid"]


def classified(spark, **change):
    row = {f: False for f in FLAGS} | {"w": 200.0, "h": 100.0, "aspect": 2.0, "density": 0.2, "vertical_complexity": 0.5,
                                       "edge_density": 0.5, "uniformity": 0.5} | change
    return scoring.classify_content(spark.createDataFrame([row])).first()


def test_content_classes(spark):
    r = classified(spark, has_integral=True)
    assert r.content_class == "formula" and "包含积分符号" in r.reasoning
    assert classified(spark, has_fraction=True, has_sup=True, has_sub=True).content_class == "formula"
    assert classified(spark, w=300.0, h=40.0, vertical_complexity=0.1).content_class == "text"
    assert classified(spark, w=300.0, h=300.0, density=0.7, edge_density=0.2).content_class == "image"
    table = classified(spark, w=400.0, h=300.0, has_grid=True, density=0.3, vertical_complexity=0.6)
    assert table.content_class == "table" and "检测到网格线结构" in table.reasoning
    total = sum(table[f"score_{k}"] for k in scoring.CLASSES)
    assert abs(total - 1) < 1e-9 and 0 <= table.certainty <= 1


def kind_of(spark, region, lines):
    from regionlake.operators import lines as line_ops

    df = spark.createDataFrame([(1, "r", *map(float, region))], "page_no long, id string, x double, y double, w double, h double")
    text = spark.createDataFrame([(1, i, float(y), float(h)) for i, (y, h) in enumerate(lines)],
                                 "page_no long, line_no int, line_y double, line_h double")
    return placement.classify_kind(line_ops.text_line_context(df, text), F.lit(800.0)).first()


def test_kinds(spark):
    r = kind_of(spark, (200, 300, 200, 50), [(200, 20), (400, 20)])
    assert r.kind == "display" and r.kind_confidence > 0.5
    r = kind_of(spark, (50, 200, 60, 20), [(200, 20), (225, 20), (175, 20)])
    assert r.kind == "inline" and "与文本对齐" in r.kind_reasons
    r = kind_of(spark, (300, 300, 200, 60), [])
    assert r.kind == "display" and r.kind_confidence == 1.0


def test_levels_and_thresholds(spark):
    df = spark.createDataFrame([(v / 100,) for v in range(101)], "confidence double")
    got = df.select(scoring.level(F.col("confidence")).alias("l"), "confidence").collect()
    assert all(r.l == ("high" if r.confidence >= 0.9 else "medium" if r.confidence >= 0.75 else "low") for r in got)
    kept = [df.filter(F.col("confidence") >= t).count() for t in (0.1, 0.5, 0.9)]
    assert kept == sorted(kept, reverse=True)


def test_differences_of_long_texts_stay_small():
    import tracemalloc

    rnd = random.Random(8)
    for n in (0, 1, 2, 15, 16, 17, 300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(n, n + 3))) for _ in range(2))
        parts = corpus.segments(a, b)
        assert "".join(t for kind, t in parts if kind != "added") == a and "".join(t for kind, t in parts if kind != "removed") == b
        best = longest_common(a, b) if n < 100 else corpus.common_length(a, b)
        assert sum(len(t) for kind, t in parts if kind == "unchanged") == best
    a = [rnd.choice("abcdefghij ") for _ in range(20_000)]
    b = [rnd.choice("xyz") if rnd.random() < 0.01 else ch for ch in a]
    a, b = "".join(a), "".join(b)
    tracemalloc.start()
    parts = corpus.segments(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all bit rows would be 50 MB
    assert peak < 8_000_000 and "".join(t for kind, t in parts if kind != "removed") == b
