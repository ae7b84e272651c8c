"""LaTeX text as Columns: extraction from model replies, normalising, checking and converting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# white space as the replies use it, beyond the ASCII kind
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
RARE_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# fixed values: symbol and the command it stands for
SYMBOL_COMMANDS = {
    "·": "cdot", "×": "times", "÷": "div", "±": "pm", "∓": "mp", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx",
    "∞": "infty",
    "∫": "int", "∬": "iint", "∭": "iiint", "∮": "oint", "∑": "sum", "∏": "prod", "√": "sqrt", "∂": "partial",
    "∇": "nabla",
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "varepsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "ξ": "xi", "π": "pi", "ρ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "varphi", "χ": "chi",
    "ψ": "psi", "ω": "omega",
    "Γ": "Gamma", "Δ": "Delta", "Θ": "Theta", "Λ": "Lambda", "Ξ": "Xi", "Π": "Pi", "Σ": "Sigma", "Φ": "Phi",
    "Ψ": "Psi", "Ω": "Omega",
    "→": "rightarrow", "←": "leftarrow", "↔": "leftrightarrow", "⇒": "Rightarrow", "⇐": "Leftarrow",
    "⇔": "Leftrightarrow",
    "∈": "in", "∉": "notin", "⊂": "subset", "⊃": "supset", "⊆": "subseteq", "⊇": "supseteq", "∪": "cup", "∩": "cap",
    "∅": "emptyset",
    "∀": "forall", "∃": "exists", "¬": "neg", "∧": "land", "∨": "lor", "⊥": "perp", "∥": "parallel",
}
# fixed values: symbols written without spaces around them
SYMBOL_TEXT = {"°": r"^{\circ}", "′": "'", "″": "''"}

# fixed values: the short list used for plain text
TEXT_COMMANDS = {
    "×": "times", "÷": "div", "±": "pm", "≤": "leq", "≥": "geq", "≠": "neq", "≈": "approx", "∞": "infty", "∑": "sum",
    "∫": "int", "∏": "prod", "√": "sqrt",
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda", "μ": "mu",
    "π": "pi", "σ": "sigma", "φ": "phi", "ω": "omega",
}

# fixed values: command and the character that approximates it
COMMAND_CHARS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ",
    "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ",
    "psi": "ψ", "omega": "ω",
    "Alpha": "Α", "Beta": "Β", "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π",
    "Sigma": "Σ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
    "times": "×", "div": "÷", "pm": "±", "mp": "∓", "cdot": "·", "ast": "∗", "star": "⋆", "leq": "≤", "geq": "≥",
    "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃",
    "ll": "≪", "gg": "≫", "subset": "⊂", "supset": "⊃", "subseteq": "⊆", "supseteq": "⊇", "in": "∈", "notin": "∉",
    "cup": "∪", "cap": "∩", "setminus": "∖",
    "land": "∧", "lor": "∨", "neg": "¬", "lnot": "¬", "forall": "∀", "exists": "∃", "nexists": "∄",
    "to": "→", "rightarrow": "→", "leftarrow": "←", "Rightarrow": "⇒", "Leftarrow": "⇐", "Leftrightarrow": "⇔",
    "mapsto": "↦", "uparrow": "↑", "downarrow": "↓",
    "infty": "∞", "partial": "∂", "nabla": "∇", "sum": "∑", "prod": "∏", "int": "∫", "oint": "∮", "sqrt": "√",
    "angle": "∠", "perp": "⊥", "parallel": "∥", "therefore": "∴",
    "because": "∵", "emptyset": "∅", "varnothing": "∅", "prime": "′", "circ": "∘", "bullet": "•", "ldots": "…",
    "cdots": "⋯", "vdots": "⋮", "ddots": "⋱",
    "langle": "⟨", "rangle": "⟩", "lceil": "⌈", "rceil": "⌉", "lfloor": "⌊", "rfloor": "⌋",
}
# fixed values: characters that have raised and lowered forms
RAISED = ("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ")
LOWERED = ("0123456789+-=()aeoxijnm", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓᵢⱼₙₘ")

# fixed values: phrases of a reply that refuses
REFUSALS = ("image", "blurry", "cannot", "can't", "unable", "please", "sorry", "too small",
            "无法", "不能", "看不清", "模糊", "请提供", "无法识别")


def _ascii(s: Column) -> Column:
    return F.octet_length(s) == F.char_length(s)


def _once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value made once, however often ``fn`` names it: branches of a condition share nothing by themselves."""
    return F.transform(F.array(value), fn)[0]


def strip(s: Column) -> Column:
    """Without white space at both ends; texts without any there are not searched."""
    edge = lambda t: F.left(t, F.lit(1)).rlike(SPACE) | F.right(t, F.lit(1)).rlike(SPACE)
    return _once(s, lambda t: F.when(edge(t), F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$(?![\\s\\S])", "")).otherwise(t))


def plain_spaces(s: Column) -> Column:
    """Rare kinds of white space as ordinary spaces: fixed-string replacement is much cheaper than a wide class."""
    return _once(s, lambda x: F.when(_ascii(x), x).otherwise(reduce(lambda t, ch: F.replace(t, F.lit(ch), F.lit(" ")), RARE_SPACES, x)))


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(plain_spaces(s), r"\s+", " "), r"^ | $", "")


# ---------------------------------------------------------------- X9
def _first_group(s: Column, patterns: list[tuple[str, str]]) -> Column:
    """First pattern that matches; its mark is looked for before the pattern is tried."""
    out = None
    for mark, p in patterns:
        hit, value = s.contains(mark) & s.rlike(p), strip(F.regexp_extract(s, p, 1))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(strip(s))


def extract_latex(s: Column) -> Column:
    """Content of the first fenced latex block, else any fenced block, else display, else inline mathematics."""
    return _first_group(s, [
        ("```latex", r"```latex\n?([\s\S]*?)\n?```"), ("```", r"```\n?([\s\S]*?)\n?```"),
        ("$$", r"\$\$([\s\S]*?)\$\$"), ("$", r"\$([\s\S]*?)\$")])


def extract_all_math(s: Column) -> Column:
    """Worker variant: a fenced block, else all dollar spans joined by newlines."""
    spans = F.regexp_extract_all(s, F.lit(r"\$\$?([\s\S]*?)\$\$?"), F.lit(0))
    joined = F.array_join(F.transform(spans, lambda m: strip(F.regexp_replace(m, r"^\$+|\$+$", ""))), "\n")
    latex, fence = r"```latex\s*([\s\S]*?)\s*```", r"```\s*([\s\S]*?)\s*```"
    return (F.when(s.rlike(latex), strip(F.regexp_extract(s, latex, 1)))
            .when(s.rlike(fence), strip(F.regexp_extract(s, fence, 1)))
            .when(s.rlike(r"\$\$?([\s\S]*?)\$\$?"), joined).otherwise(strip(s)))


def unwrap_model_output(s: Column) -> Column:
    """Local-model variant: drop fence lines, then one pair of dollar or bracket wrappers."""
    text = strip(s)
    text = F.when(text.startswith("```"), F.array_join(
        F.filter(F.split(text, "\n"), lambda line: ~strip(line).startswith("```")), "\n")).otherwise(text)

    def inside(t: Column, left: str, right: str) -> tuple[Column, Column]:
        n, m = len(left), len(right)
        return (t.startswith(left) & t.endswith(right),
                F.substr(t, F.lit(n + 1), F.greatest(F.lit(0), F.length(t) - n - m)))

    two, one = inside(text, "$$", "$$"), inside(text, "$", "$")
    text = F.when(two[0], two[1]).when(one[0], one[1]).otherwise(text)
    br = inside(text, "\\[", "\\]")
    return strip(F.when(br[0], br[1]).otherwise(text))


# ---------------------------------------------------------------- X10
def normalize_latex(s: Column) -> Column:
    """Strip dollars, write symbols as commands, collapse white space."""
    bare = F.when(s.startswith("$") | s.endswith("$"), F.regexp_replace(s, r"^\$+|\$+$(?![\s\S])", "")).otherwise(s)
    table = [(sym, f" \\{cmd} ") for sym, cmd in SYMBOL_COMMANDS.items()] + list(SYMBOL_TEXT.items())
    spelled = lambda b: reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), table, b)
    return collapse_spaces(_once(bare, lambda b: F.when(_ascii(b), b).otherwise(spelled(b))))


def text_to_latex(s: Column) -> Column:
    """Plain recognised text: short symbol list and a/b as a fraction."""
    spelled = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit("\\" + kv[1])), TEXT_COMMANDS.items(), s)
    return F.regexp_replace(spelled, r"(\w+)/(\w+)", r"\\frac{$1}{$2}")


# ---------------------------------------------------------------- X11
def _balanced(s: Column, left: str, right: str) -> Column:
    marks = F.regexp_extract_all(s, F.lit(f"[\\{left}\\{right}]"), F.lit(0))
    zero = F.struct(F.lit(0).alias("n"), F.lit(False).alias("bad"))

    def step(acc, m):
        n = acc["n"] + F.when(m == left, 1).otherwise(-1)
        return F.struct(n.alias("n"), (acc["bad"] | (n < 0)).alias("bad"))

    walked = F.aggregate(marks, zero, step, lambda acc: ~acc["bad"] & (acc["n"] == 0))
    return F.when(s.contains(left) | s.contains(right), walked).otherwise(F.lit(True))


def validate_latex(s: Column) -> Column:
    """Brackets balanced, no open command argument, no double dollar, every environment followed by an end."""
    wrong = (
        s.contains("$$") | (s.contains("\\") & s.rlike(r"\\[a-zA-Z]+\s*\{[^}]*\z"))
        | (s.contains("\\begin{") & s.rlike(r"\\begin\{[^}]+\}(?![\s\S]*\\end\{[^}]+\})")))
    return _balanced(s, "{", "}") & _balanced(s, "[", "]") & _balanced(s, "(", ")") & ~wrong


def validate_markdown(s: Column) -> Column:
    """The LaTeX inside dollar marks is valid, or the whole text when there are none."""
    marked = s.rlike(r"\$[^$]+\$") | s.rlike(r"\$\$[\s\S]+?\$\$")
    return validate_latex(F.when(marked, strip(F.replace(s, F.lit("$"), F.lit("")))).otherwise(s))


# ---------------------------------------------------------------- X13
def to_markdown(s: Column, inline: Column | bool = False) -> Column:
    t = strip(s)
    inline = F.lit(inline) if isinstance(inline, bool) else inline
    return F.when(inline, F.concat(F.lit("$"), t, F.lit("$"))).otherwise(F.concat(F.lit("$$\n"), t, F.lit("\n$$")))


def to_mathml(s: Column) -> Column:
    """The source as an annotation, escaped."""
    esc = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return F.concat(
        F.lit('<math xmlns="http://www.w3.org/1998/Math/MathML">\n  <annotation encoding="application/x-tex">'), esc,
        F.lit("</annotation>\n</math>"))


def _per_token(s: Column, pattern: str, fn) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), fn), "")


def _known_commands() -> Column:
    return F.create_map(*[F.lit(x) for cmd, ch in COMMAND_CHARS.items() for x in ("\\" + cmd, ch)])


def _shift(s: Column, mark: str, table: tuple[str, str]) -> Column:
    m = "\\" + mark
    body = lambda t: F.regexp_replace(t, r"^.\{?|\}$", "")
    return _per_token(s, rf"{m}\{{[^}}]+\}}|{m}\d|[^{m}]+|{m}", lambda t: F.when(
        t.rlike(rf"^{m}(\{{|\d)"), F.translate(body(t), *table)).otherwise(t))


def to_unicode(s: Column) -> Column:
    """Readable approximation: whole command names become characters, scripts are raised or lowered."""
    known = _known_commands()
    text = _per_token(s, r"\\[a-zA-Z]+|[^\\]+|\\", lambda t: F.coalesce(F.try_element_at(known, t), t))
    text = _shift(_shift(text, "^", RAISED), "_", LOWERED)
    text = F.regexp_replace(text, r"\\frac\{([^}]+)\}\{([^}]+)\}", "($1)/($2)")
    text = F.regexp_replace(text, r"\\[a-zA-Z]+", "")
    return collapse_spaces(F.regexp_replace(text, r"[{}]", ""))


def convert(s: Column, fmt: str) -> Column:
    return {"latex": lambda x: x, "markdown": to_markdown, "mathml": to_mathml, "unicode": to_unicode}[fmt](s)


def unknown_commands(s: Column) -> Column:
    """Commands that the approximation does not know."""
    known = [F.lit("\\" + cmd) for cmd, _ in COMMAND_CHARS.items()] + [F.lit("\\frac")]
    return F.array_except(F.regexp_extract_all(s, F.lit(r"\\[a-zA-Z]+"), F.lit(0)), F.array(*known))


# ---------------------------------------------------------------- F15
def likely_latex(s: Column) -> Column:
    """Not a refusal, and with a mathematical token or digit unless it is one to three characters long."""
    refused = lambda lower: reduce(lambda a, b: a | b, [lower.contains(p) for p in REFUSALS])
    token = lambda t: t.rlike(r"[\\^_=+\-*/]|\d")
    return _once(strip(s), lambda t: (t != "") & ~_once(F.lower(t), refused) & (token(t) | t.rlike(r"^[^\s]{1,3}\z")))
