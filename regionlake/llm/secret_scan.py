"""Operator 2: secrets by rules and by character Markov models.

Three rules find assignments, access keys and hexadecimal runs.  Tokens that no rule finds are judged by two character
models of first order, one of random strings and one of ordinary identifiers: a token is a secret if it is more likely
under the first by a log-likelihood ratio above ``least``.  The models are trained from labelled tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import sample
from .tables import SPACE, bind, texts

c = F.col
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
          "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# the longest runs are found whole, so a least length in the pattern drops the same matches as a later check
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RUN = 256
FAR = 1 << 62
SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def _running(values: Column, op, zero: int) -> Column:
    """``op`` of each number and all before it.  Numbers are taken up in runs of RUN, so that no long array is copied at
    every step."""
    def run(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return bind(op(acc["at"], x), lambda at: F.struct(at.alias("at"), F.array_append(acc["out"], at).alias("out")))

        start = F.struct(F.lit(zero).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, start, step)["out"]

    def join(runs: Column) -> Column:
        before = run(F.transform(runs, lambda r: F.element_at(r, -1)))
        return bind(before, lambda b: F.flatten(F.transform(runs, lambda r, k: bind(
            F.coalesce(F.get(b, k - 1), F.lit(zero).cast("long")), lambda base: F.transform(r, lambda x: op(base, x))))))

    parts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda k: run(F.slice(x, k * RUN + 1, RUN)))
    return bind(values, lambda x: F.when(F.size(x) == 0, x).otherwise(bind(parts(x), join)))


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Matches of a pattern from left to right, with code points: start, end (exclusive) and the text matched."""
    def build(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(x["all"]) - 1)
        length = lambda name, i: F.char_length(F.get(x[name], i)).cast("long")
        ends = _running(F.transform(numbers, lambda i: length("between", i) + length("all", i)), lambda a, b: a + b, 0)
        return bind(ends, lambda e: F.transform(numbers, lambda i: F.struct(
            (F.get(e, i) - length("all", i)).cast("int").alias("start"), F.lit(kind).alias("kind"), F.get(e, i).cast("int").alias("end"),
            F.get(x["part"], i).alias("match"))))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
                     F.split(text, pattern, -1).alias("between"))
    found = F.when(text.rlike(pattern), bind(parts, build)).otherwise(F.array().cast(SPAN))
    return F.filter(found, lambda s: F.char_length(s["match"]) >= least) if least else found


def _free(tokens: Column, base: Column) -> Column:
    """Tokens that overlap no span of ``base``: no span before them ends behind their start, and none behind their start
    begins before their end."""
    long = lambda x: x.cast("long")
    both = F.sort_array(F.concat(
        F.transform(base, lambda b: F.struct(long(b["start"]).alias("start"), long(b["end"]).alias("end"), F.lit(-1).alias("n"))),
        F.transform(tokens, lambda t, i: F.struct(long(t["start"]).alias("start"), long(t["end"]).alias("end"), i.alias("n")))))

    def choose(m: Column) -> Column:
        reach = _running(F.transform(m, lambda x: F.when(x["n"] < 0, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        ahead = _running(F.transform(F.reverse(m), lambda x: F.when(x["n"] < 0, x["start"]).otherwise(FAR)), lambda a, b: F.least(a, b), FAR)
        clear = lambda both: F.filter(m, lambda x, i: (x["n"] >= 0) & (F.get(both["reach"], i) <= x["start"]) & (
            F.get(both["ahead"], F.size(m) - 1 - i) >= x["end"]))
        return F.transform(bind(F.struct(reach.alias("reach"), ahead.alias("ahead")), clear), lambda x: F.get(tokens, x["n"]))

    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(bind(both, choose))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds assign, access and hex: the spans of each rule in ``text``."""
    text = c("text")
    return docs.withColumns({"assign": _spans(text, ASSIGN, 0, 2, 8), "access": _spans(text, ACCESS, 1), "hex": _spans(text, HEX, 2)})


def labelled_tokens(docs: DataFrame, bound: int = 4_000) -> DataFrame:
    """(token, random): what the rules find and digests written as base64 are random; words of eight and more of at most
    ``bound`` documents, without what the rules find there, are ordinary."""
    ids = F.broadcast(sample(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct(), bound))  # at most bound ids
    some = docs.join(ids, "doc_id")
    found = base_spans(some).select(F.explode(F.concat("assign", "access", "hex")).alias("s")).select(c("s.match").alias("token"))
    digests = some.select(F.base64(F.unhex(F.sha2(c("doc_id").cast("string"), 256))).alias("token"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = some.select(F.explode(F.split(plain, SPACE)).alias("word")).select(F.explode(F.regexp_extract_all(
        "word", F.lit("[A-Za-z0-9+/_=-]{8,}"), F.lit(0))).alias("token"))
    return found.union(digests).withColumn("random", F.lit(True)).union(ordinary.withColumn("random", F.lit(False)))


def train_markov(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random to ordinary, of each character after each other one (67 x 67 numbers, row by row).

    Each kind of sample is counted by distinct tokens, every pair of characters once more than seen; with no samples all
    ratios are 0.
    """
    n = len(ALPHABET)
    rows = samples.filter(c("token").isNotNull() & (F.char_length("token") > 1)).distinct()
    pair = bind(_codes(c("token")), lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 2), lambda i: F.when(
        (F.get(x, i) >= 0) & (F.get(x, i + 1) >= 0), F.get(x, i) * n + F.get(x, i + 1)).otherwise(-1)))
    pairs = rows.select("random", F.explode(pair).alias("pair"))
    import math

    # at most 2 * 67 * 67 rows
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.filter("pair >= 0").groupBy("random", "pair").count().collect()}
    out = []
    total = {(k, a): sum(counts.get((k, a * n + b), 0) for b in range(n)) for k in (True, False) for a in range(n)}
    for a in range(n):
        for b in range(n):
            p, q = ((counts.get((k, a * n + b), 0) + 1) / (total[k, a] + n) for k in (True, False))
            out.append(math.log(p / q))
    return out


def _codes(token: Column) -> Column:
    """The place of each character in the alphabet, -1 for others."""
    return F.transform(F.filter(F.split(token, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET), x) - 1)


def _ratio(token: Column, model: Column) -> Column:
    n = len(ALPHABET)
    pairs = lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0.0), lambda s, i: s + F.get(
        model, F.get(x, i) * n + F.get(x, i + 1)))
    return bind(_codes(token), pairs)


def secret_scan(docs: DataFrame, model: list[float], least: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans.

    Spans are arrays of (start, kind, end, match) by start, then kind; ``match`` is what was judged (of an assignment the
    value).  A token that overlaps a rule's span adds none.  Null and empty texts have no spans; repeated rows give
    repeated results.
    """
    ratios = F.from_json(F.lit("[" + ",".join(f"{x:.9f}" for x in model) + "]"), "array<double>")
    rows = texts(docs, id_col, text_col)
    text = c("text")
    rules = F.struct(_spans(text, ASSIGN, 0, 2, 8).alias("assign"), _spans(text, ACCESS, 1).alias("access"),
                     _spans(text, HEX, 2).alias("hex"), _spans(text, TOKEN, 3).alias("tokens"))

    def judge(r: Column) -> Column:
        base = F.sort_array(F.concat(r["assign"], r["access"], r["hex"]))
        added = lambda b: F.filter(_free(r["tokens"], b), lambda t: _ratio(t["match"], ratios) > least)
        sizes = [F.size(r[k]).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
        return bind(base, lambda b: bind(added(b), lambda a: F.struct(
            *sizes, F.size(a).cast("long").alias("n_random"), b.alias("base_spans"), F.sort_array(F.concat(b, a)).alias("spans"))))

    # one expression: whatever is selected later, the rules run once a row
    rows = rows.select("doc_id", bind(rules, judge).alias("found"))
    return rows.select("doc_id", *(c(f"found.{n}") for n in ("n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans")))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
