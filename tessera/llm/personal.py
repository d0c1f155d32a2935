"""Personal data by weak supervision, in DataFrame functions only.

Patterns find spans. Those that pass their kind's test (parts of an address, Luhn's sum, number of digits) are base spans
and always stay. They and looser candidates (numbers shaped like cards or phones, keys) go to five labelers that vote for,
against or not at all: strict shape, gazetteer, words before, checksum, borders. Expectation-maximisation over the counts
of vote patterns estimates each labeler's reliabilities for each kind, without any labels. A naive Bayes classifier over
features of the span itself, trained with the posteriors as weights, decides which candidates are added.

Of the corpus, only counts by vote pattern and by feature are gathered (at most 5 * 3^5 and 5 * 40 rows).

Defined cases: a null text is an empty one and has no spans; very long texts are searched whole; equal rows get equal
spans; candidates that overlap a base span, and of the others those that overlap an earlier one, are dropped; other columns are kept; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.divergence import let
from tessera.llm.shared import documents, stored

KINDS = ["email", "ip", "card", "phone", "secret"]
# The patterns of the base kinds. What may stand at their beginning is either not preceded by one of its own characters or
# follows the last match, and what can't be given back is possessive: the same matches, but in linear time and without recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns of candidates; failed cards are candidates too.
LOCAL_PHONE = r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
KEY = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+"
# Endings of host names, country codes, first digits of card numbers, words that announce a kind.
ENDINGS = r"\.(com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|eu|de|at|ch|li|lu|fr|be|es|pt|mx|ar|cl|co|pe|br|uk|ie|us|ca|au|nz|it|nl|dk|se|no|fi|is|pl|cz|sk|hu|ro|bg|gr|tr|ru|ua|jp|kr|cn|hk|tw|in|sg|za|il|ae)$"
COUNTRY = r"^\+(1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|351|352|353|354|358|420|421|971|972)[\x20(.-]"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
ANNOUNCED = {
    "email": r"(?i)(e-?mail|contact|write to|kontakt|courriel|correo|adresse)\W*$",
    "ip": r"(?i)(\bip\b|host|server|address|adresse|from|addr)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|karte|carte|tarjeta|payment|iban)\W*$",
    "phone": r"(?i)(tel|phone|call|fax|mobile|telefon|handy|t[ée]l[ée]phone|tel[ée]fono|m[óo]vil)\W*$",
    "secret": r"(?i)(token|key|secret|passw(or)?d|pwd|api|bearer|authorization)\W*$",
}
UNSAID = r"(?i)(version|page|seite|isbn|issn|§|chapter|figure|no\.|nr\.)\W*$"
LABELERS, ROUNDS, SMOOTH = 5, 25, 0.5
_FAR = (1 << 31) - 1
FEATURES, BUCKETS = 5, 8
_P = "__tessera_"
#: How many values a step of running() goes over one by one, and characters of a block of a text that is cut often.
STEP, TEXT_BLOCK = 48, 2048


def running(values: Column, join: Callable[[Column, Column], Column], first: int, levels: int = 2) -> Column:
    """Of each value (an array of bigint) the join of all before it. Blocks are joined first, then what precedes each block, then what precedes each value in its block, so that the time grows with the length (and beyond some millions of values a little faster)."""
    over = lambda v, at, n: F.aggregate(F.slice(v, at, n), F.lit(first).cast("bigint"), lambda a, x: join(a, x))

    def plain(v: Column) -> Column:
        return F.transform(v, lambda _, i: over(v, F.lit(1), i))

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / STEP).cast("int")), lambda b: over(v, b * STEP + 1, F.lit(STEP)))

        def within(before: Column) -> Column:
            block = lambda i: (i / STEP).cast("int")
            return F.transform(v, lambda _, i: join(F.get(before, block(i)), over(v, block(i) * STEP + 1, i % STEP)))

        return let(running(blocks, join, first, levels - 1), within)

    return let(values, lambda v: F.when(F.size(v) <= STEP, plain(v)).otherwise(by_blocks(v))) if levels else let(values, plain)


def matches(text: Column, pattern: str) -> Column:
    """All matches from left to right, none overlapping: start, end (code points), s, and up to 24 characters before and one after, back to the last match."""

    def placed(found: Column, between: Column) -> Column:
        sizes = F.transform(found, lambda s, i: (F.length(s) + F.length(F.get(between, i))).cast("bigint"))

        def one(before: Column, s: Column, i: Column) -> Column:
            start = (F.get(before, i) + F.length(F.get(between, i))).cast("int")
            return F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s"), F.right(F.get(between, i), F.lit(24)).alias("before"), F.left(F.get(between, i + 1), F.lit(1)).alias("after"))

        return let(running(sizes, lambda a, b: a + b, 0), lambda before: F.transform(found, lambda s, i: one(before, s, i)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern), lambda s: placed(m, s)))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def passes(kind: str, s: Column) -> Column:
    """Whether a match of a base pattern passes its kind's test."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(digits(s))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(s))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, x: Column) -> Column:
    """The votes of the five labelers as places in a table of 3 a labeler: against, none, for."""
    s, n = x["s"], F.length(digits(x["s"]))
    says = lambda c: F.when(c, 1).otherwise(-1)
    shape = {
        "email": says(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$")), "ip": says(s.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), "card": says(s.rlike(r"^(?:[0-9]{4}[ -]?){3}[0-9]{4}$|^[0-9]{15}$")),
        "phone": F.when(s.rlike(r"^(?:\+[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), 1).otherwise(0), "secret": F.when(s.rlike("^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64})$"), 1).otherwise(0),
    }
    listed = {
        "email": says(F.lower(s).rlike(ENDINGS)), "ip": says(~s.rlike(r"^(0|127|255)\.")), "card": says(digits(s).rlike(ISSUERS)),
        "phone": F.when(s.rlike(COUNTRY), 1).when(s.startswith("+"), 0).otherwise(-1), "secret": F.when(x["before"].rlike(r"[\"'=:]\s*$"), 1).otherwise(-1),
    }
    told = F.when(x["before"].rlike(ANNOUNCED[kind]), 1).when(x["before"].rlike(UNSAID), -1).otherwise(0)
    sums = {
        "email": F.lit(0), "ip": says(passes("ip", s)), "card": says(F.call_function("luhn_check", digits(s))), "phone": says(n.between(9, 15)),
        "secret": says((n >= 4) & (F.length(s) - n >= 4)),
    }
    border = says((F.length(x["before"]) == 0) | x["before"].rlike(r"[\s\"'(\[<=:]$")).cast("int")
    votes = [shape[kind], listed[kind], told, sums[kind], border]
    return F.array(*(v.cast("int") + F.lit(3 * k + 1) for k, v in enumerate(votes)))


def _features(x: Column) -> Column:
    """What the classifier sees of a span: buckets of length, of the share of digits, of blanks, of the characters before and after."""
    s, n = x["s"], F.length(x["s"])
    kind_of = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[\"']"), 2).when(c.rlike(r"[.,;:!?]"), 3).when(c.rlike("[0-9]"), 4).when(c.rlike("[A-Za-z]"), 5).otherwise(6)
    seen = [F.least(F.lit(7), F.floor(n / 6)), F.least(F.lit(7), F.floor(8 * F.length(digits(s)) / n)), F.least(F.lit(7), F.length(F.regexp_replace(s, r"[^\s-]+", ""))), kind_of(F.right(x["before"], F.lit(1))), kind_of(x["after"])]
    return F.array(*(v.cast("int") + F.lit(BUCKETS * k) for k, v in enumerate(seen)))


def _candidate(kind: str, x: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x).alias("votes"), _features(x).alias("features"))


def found_spans(df: DataFrame, text: str = "text", prefix: str = _P, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) and, prefixed, base and loose: arrays of candidates (kind, start, end, votes, features), those that pass and the rest."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,s:string,before:string,after:string>>")
    guards = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9][ -]?[0-9]"), "phone": t.contains("+")}
    out = df.withColumns({f"{prefix}{k}": F.when(guards[k], matches(t, PATTERNS[k])).otherwise(none) for k in PATTERNS})
    digit = t.rlike("[0-9]")
    out = out.withColumns({f"{prefix}local": F.when(digit, matches(t, LOCAL_PHONE)).otherwise(none), f"{prefix}key": F.when(digit, matches(t, KEY)).otherwise(none)})
    is_base = lambda k: lambda x: passes(k, x["s"])
    as_ = lambda k: lambda x: _candidate(k, x)
    base = F.concat(*(F.transform(F.filter(F.col(f"{prefix}{k}"), is_base(k)), as_(k)) for k in PATTERNS))
    failed = F.filter(F.col(f"{prefix}card"), lambda x: F.length(digits(x["s"])).between(13, 19) & ~passes("card", x["s"]))
    loose = F.concat(F.transform(failed, as_("card")), F.transform(F.col(f"{prefix}local"), as_("phone")), F.transform(F.col(f"{prefix}key"), as_("secret")))
    carry = df.columns if carry is None else carry
    return out.select(*carry, base.alias(f"{prefix}base"), loose.alias(f"{prefix}loose"))


def _fold(patterns: Column) -> Column:
    """Expectation-maximisation over (votes, n): the prior and, for true and for false, each labeler's probabilities of its votes."""
    kind = "struct<prior:double,yes:array<double>,no:array<double>>"
    first = lambda for_, against: F.array(*(F.lit(p) for _ in range(LABELERS) for p in (against, 0.3, for_)))
    start = F.struct(F.lit(0.5).alias("prior"), first(0.6, 0.1).alias("yes"), first(0.1, 0.6).alias("no")).cast(kind)
    add = lambda s, x: s + x

    def round_(m: Column, _: Column) -> Column:
        def weighed(p: Column) -> Column:
            yes = F.aggregate(p["votes"], m["prior"], lambda a, v: a * F.get(m["yes"], v))
            no = F.aggregate(p["votes"], 1 - m["prior"], lambda a, v: a * F.get(m["no"], v))
            return F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (p["n"] * yes / (yes + no)).alias("r"))

        def learned(ps: Column) -> Column:
            r = F.aggregate(F.transform(ps, lambda p: p["r"]), F.lit(0.0), add)
            n = F.aggregate(F.transform(ps, lambda p: p["n"]), F.lit(0.0), add)
            with_ = lambda k, f: F.aggregate(F.transform(F.filter(ps, lambda p: F.array_contains(p["votes"], k)), f), F.lit(0.0), add)
            places = F.sequence(F.lit(0), F.lit(3 * LABELERS - 1))
            yes = F.transform(places, lambda k: (with_(k, lambda p: p["r"]) + SMOOTH) / (r + 3 * SMOOTH))
            no = F.transform(places, lambda k: (with_(k, lambda p: p["n"] - p["r"]) + SMOOTH) / (n - r + 3 * SMOOTH))
            return F.struct(((r + SMOOTH) / (n + 2 * SMOOTH)).alias("prior"), yes.alias("yes"), no.alias("no")).cast(kind)

        return let(F.transform(patterns, weighed), learned)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, round_)


def reliabilities(found: DataFrame, prefix: str = _P) -> DataFrame:
    """Of each kind with candidates: the prior and the labelers' probabilities."""
    spans = found.select(F.explode(F.concat(f"{prefix}base", f"{prefix}loose")).alias("x")).select("x.kind", "x.votes")
    counts = spans.groupBy("kind", "votes").agg(F.count("*").cast("double").alias("n"))
    patterns = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    return patterns.select("kind", _fold(F.col("patterns")).alias("m"))


def _posterior(models: list, kind: Column, votes: Column) -> Column:
    out = F.lit(0.0)
    for row in models:
        yes, no = (F.array(*map(F.lit, row["m"][k])) for k in ("yes", "no"))
        both = let(F.struct(_product(votes, yes, row["m"]["prior"]).alias("y"), _product(votes, no, 1 - row["m"]["prior"]).alias("n")), lambda p: p["y"] / (p["y"] + p["n"]))
        out = F.when(kind == row["kind"], both).otherwise(out)
    return out


def _product(votes: Column, table: Column, first: float) -> Column:
    return F.aggregate(votes, F.lit(first), lambda a, v: a * F.get(table, v))


def classifier(found: DataFrame, prefix: str = _P) -> list[tuple[int, float, list[float]]]:
    """The model: of each kind (at most five) the bias and the weight of each feature, in nats."""
    models = reliabilities(found, prefix).collect()  # at most a row for each kind
    if not models:
        return []
    spans = found.select(F.explode(F.concat(f"{prefix}base", f"{prefix}loose")).alias("x"))
    spans = spans.groupBy("x.kind", "x.votes", "x.features").agg(F.count("*").alias("n")).withColumn("r", _posterior(models, F.col("kind"), F.col("votes")))
    spans = spans.select("kind", (F.col("n") * F.col("r")).alias("yes"), (F.col("n") * (1 - F.col("r"))).alias("no"), F.explode(F.concat("features", F.array(F.lit(-1)))).alias("f"))
    sums = spans.groupBy("kind", "f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()  # at most 41 rows for each kind
    out = []
    for kind in sorted({s["kind"] for s in sums}):
        of = {s["f"]: (s["yes"], s["no"]) for s in sums if s["kind"] == kind}
        yes, no = of[-1]
        weights = [math.log((of.get(f, (0, 0))[0] + 1) / (yes + BUCKETS)) - math.log((of.get(f, (0, 0))[1] + 1) / (no + BUCKETS)) for f in range(FEATURES * BUCKETS)]
        out.append((kind, math.log((yes + 1) / (no + 1)), weights))
    return out


def all_spans(found: DataFrame, prefix: str = _P) -> DataFrame:
    """Add the prefixed column spans: base and added spans (start, kind, end), in order."""
    model = classifier(found, prefix)

    def accepted(x: Column) -> Column:
        out = F.lit(-1.0)
        for kind, bias, weights in model:
            total = _total(x["features"], bias, weights)
            out = F.when(x["kind"] == kind, total).otherwise(out)
        return out > 0

    short = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    kind = "array<struct<start:int,kind:int,end:int>>"
    base = F.array_sort(F.transform(F.col(f"{prefix}base"), short)).cast(kind)
    loose = F.when(F.size(f"{prefix}loose") == 0, F.array().cast(kind)).otherwise(F.transform(F.filter(F.col(f"{prefix}loose"), accepted), short).cast(kind))
    out = apart(found.withColumns({f"{prefix}spans": base, f"{prefix}more": loose}), f"{prefix}more", f"{prefix}spans", prefix)
    return out.withColumn(f"{prefix}spans", F.when(F.size(f"{prefix}more") == 0, F.col(f"{prefix}spans")).otherwise(F.array_sort(F.concat(f"{prefix}spans", f"{prefix}more")))).drop(f"{prefix}more")


def apart(df: DataFrame, loose: str, base: str, prefix: str = _P) -> DataFrame:
    """df with only those candidates in the column loose that overlap no span in the column base and no earlier candidate of those. Both are put in order together; what reaches over a candidate is then known from what is before and after it."""
    mark = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["end"].alias("end")))
    ends = lambda spans, own: F.transform(spans, lambda x: F.when(x["own"] == own, x["end"]).otherwise(-1).cast("bigint"))
    begins = lambda spans: F.transform(spans, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(_FAR).cast("bigint"))
    some = lambda x, like: F.when(F.size(loose) > 0, x).otherwise(F.array().cast(like))
    spans, numbers = "array<struct<start:int,own:int,kind:int,end:int>>", "array<bigint>"
    both, before, after = (F.col(f"{prefix}{c}") for c in ("both", "before", "after"))
    out = df.withColumn(f"{prefix}both", some(F.array_sort(F.concat(mark(F.col(base), 0), mark(F.col(loose), 1))).cast(spans), spans))
    out = out.withColumns({f"{prefix}before": some(running(ends(both, 0), F.greatest, -1), numbers), f"{prefix}after": some(F.reverse(running(F.reverse(begins(both)), F.least, _FAR)), numbers)})
    # Bound by let, what is before and after is not computed for each element, however the optimizer joins projections.
    clear = lambda b, a: F.filter(F.transform(both, lambda x, i: F.when((x["own"] == 1) & (F.get(b, i) <= x["start"]) & (F.get(a, i) >= x["end"]), x)), lambda x: x.isNotNull())
    out = out.withColumn(f"{prefix}both", let(before, lambda b: let(after, lambda a: clear(b, a))))
    out = out.withColumn(f"{prefix}before", some(running(ends(both, 1), F.greatest, -1), numbers))
    first = lambda b: F.filter(F.transform(both, lambda x, i: F.when(F.get(b, i) <= x["start"], F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))), lambda x: x.isNotNull())
    return out.withColumn(loose, let(before, first)).drop(f"{prefix}both", f"{prefix}before", f"{prefix}after")


def _total(features: Column, bias: float, weights: list[float]) -> Column:
    table = F.array(*map(F.lit, weights))
    return F.aggregate(features, F.lit(bias), lambda a, f: a + F.get(table, f))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end (exclusive) of a text in blocks of TEXT_BLOCK characters."""
    at, to = (start / TEXT_BLOCK).cast("int"), (end / TEXT_BLOCK).cast("int")
    left, right = (start % TEXT_BLOCK).cast("int"), (end % TEXT_BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    over = F.concat(F.substring(block(at), left + 1, F.lit(TEXT_BLOCK)), F.array_join(F.slice(blocks, at + 2, F.greatest(to - at - 1, F.lit(0))), ""), F.substring(block(to), F.lit(1), right))
    return F.when(at == to, F.substring(block(at), left + 1, right - left)).otherwise(over)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of its texts replaced by its kind in angle brackets, and n_chars (if there) by the new length. Null texts stay null."""
    out = all_spans(stored(found_spans(df, text), "spans"))
    t, names = F.col(text), F.array(*map(F.lit, KINDS))
    spans, covered, blocks = (F.col(f"{_P}{c}") for c in ("spans", "covered", "blocks"))
    ends = F.transform(spans, lambda x: x["end"].cast("bigint"))
    # Texts are cut at characters, which are counted from a text's beginning: so long ones are cut into blocks before.
    out = out.withColumns({f"{_P}covered": running(ends, F.greatest, 0), f"{_P}blocks": F.when(F.length(t) <= TEXT_BLOCK, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)))})
    # Text after the end of all earlier spans, then the kind of a span that begins behind it.
    said = lambda c, b, x, i: F.when(F.get(c, i) <= x["start"], F.concat(cut(b, F.get(c, i), x["start"]), F.lit("<"), F.get(names, x["kind"]), F.lit(">"))).otherwise("")
    between = lambda c, b: F.array_join(F.transform(spans, lambda x, i: said(c, b, x, i)), "")
    last = lambda c: F.greatest(F.try_element_at(c, F.lit(-1)), F.try_element_at(ends, F.lit(-1)))
    whole = let(covered, lambda c: let(blocks, lambda b: F.concat(between(c, b), cut(b, last(c), F.length(t)))))
    out = out.withColumn(text, F.when(t.isNull() | (F.size(spans) == 0), t).otherwise(whole))
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length(text)).cast(df.schema["n_chars"].dataType))
    return out.select(*df.columns)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's base counts, the digest of its base spans, and all spans."""
    out = all_spans(stored(found_spans(documents(spark, sf_dir).select("doc_id", "text"), carry=["doc_id"]), "spans"))
    base = F.array_sort(F.transform(F.col(f"{_P}base"), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    of = lambda k: F.size(F.filter(F.col(f"{_P}base"), lambda x: x["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    return out.select("doc_id", *map(of, KINDS[:4]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col(f"{_P}spans")).alias("spans"))
