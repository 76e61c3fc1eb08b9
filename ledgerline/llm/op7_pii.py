r"""PII removal by information-theoretic sanitisation (DataFrame functions only).

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by fixed
patterns and checks: the protected entities, told apart by their values. Beyond them, each word
of a document with an entity is weighed by corpus co-occurrence: with n(t) the occurrences
of the word t in the corpus, n(x, t) those in documents that hold the entity x, and k(x, t) the
different neighbours t has there (the fewer of left and right ones; copies of a passage give
one), P(x|t) = n(x, t) / n(t) * (1 - 1/k), and t discloses log2(P(x|t) / P(x)) bits about x,
P(x) being the share of documents with x. A word with P(x|t) >= SHARE and at least BITS bits is
removed wherever it stands in a document with x (kind `term`).

An entity in over 1 in 2^BITS documents can have no such word and is not counted further; fewer than
2^BITS documents have none at all. Entities that one document alone holds disclose the words that
stand there several times, in different places, and hardly elsewhere. Words are counted for each
document before they meet its entities, and only those that could pass with all entities together do.

Positions come from string functions alone: splitting a text by a pattern gives what stands
between the matches, and running sums of lengths give code point offsets.

A null text is an empty one; a null doc_id is kept. Repeated rows get equal results, each as a
row of its own, and count as so many documents. Very long texts and runs are scanned once a
pattern, without recursion, and cut in one pass. Ties do not arise: thresholds are inclusive. An empty table gives no
rows. Extra columns are kept, whatever their names, except those beginning with `pii_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import maybe_among, scratch, table, text_or_empty

#: Fixed patterns of the base kinds, in the order of the digest, written so that they match the
#: same text as the plain forms in the tests, without recursion and in linear time: possessive
#: repeats, starts only where a run begins or the last match ended, 13 digits at least for a card.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a pattern cannot match, for a cheap test ahead of the pattern.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{M}]{3,}+"
SHARE, BITS = 0.6, 4.0
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"
#: Matches whose places are summed up together; code points of a piece of a text that is cut.
BLOCK, PIECE = 256, 256


def located(text: Column, pattern: str) -> Column:
    """array of (start, end, value) of the matches, in code points. Lengths are summed in blocks
    of BLOCK matches, and over the blocks, so that no long array is built match by match."""
    joined = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(joined) - 1) / BLOCK).cast("int")), lambda b: F.slice(joined, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0).cast("bigint")
    length = lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0))).cast("bigint")
    sized = F.transform(blocks, lambda b: F.struct(b.alias("b"), F.aggregate(b, zero, lambda a, x: a + length(x)).alias("n")))
    kind = "array<struct<at:bigint,b:array<struct<gap:string,value:string>>>>"
    starts = F.aggregate(sized, F.struct(zero.alias("at"), F.array().cast(kind).alias("out")), lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), s["b"].alias("b")))).alias("out")))

    def span(a, x):
        start = a["at"] + F.length(x["gap"])
        here = F.array(F.struct(start.cast("bigint").alias("start"), (start + F.length(x["value"])).cast("bigint").alias("end"), x["value"].alias("value"))).cast(SPAN)
        return F.struct((a["at"] + length(x)).alias("at"), F.when(x["value"].isNull(), a["out"]).otherwise(F.concat(a["out"], here)).alias("out"))

    return F.flatten(F.transform(starts["out"], lambda s: F.aggregate(s["b"], F.struct(s["at"].alias("at"), F.array().cast(SPAN).alias("out")), span)["out"]))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def holds(kind: str, value: Column) -> Column:
    """The checks a match must pass."""
    if kind == "ip":
        # Leading zeros are dropped first, so parts of any length compare as numbers.
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def checker(kind: str):
    return lambda s: holds(kind, s["value"])


def span_text(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def span_kind(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> dict[str, Column]:
    """array of (start, end, value) for each base kind."""
    out = {}
    for kind, pattern in PATTERNS.items():
        at = F.filter(located(text, pattern), checker(kind))
        might = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.regexp_like(text, F.lit(PATTERNS[kind]))
        out[kind] = F.when(might, at).otherwise(F.array().cast(SPAN))
    return out


def tokens(near: DataFrame) -> DataFrame:
    """(pii_row, t, start, end, value, before, after): each word of pii_text with a bit for the word on either side.
    Neighbours are told apart by 64 buckets, so never more are counted than there are."""
    words = F.transform(located(F.col("pii_text"), TERM), lambda s: F.struct(F.lower(s["value"]).alias("t"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    def beside(w):
        none, last = F.array(F.lit(None).cast("string")), F.greatest(F.size(w) - 1, F.lit(0))
        t = w["t"]
        return F.arrays_zip(w.alias("o"), F.concat(none, F.slice(t, F.lit(1), last)).alias("before"), F.concat(F.slice(t, F.lit(2), last), none).alias("after"))

    bit = lambda name: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(f"z.{name}"), F.lit(64))).alias(name)
    return near.select("pii_row", F.explode(let(words, beside)).alias("z")).where("z.o is not null").select("pii_row", "z.o.*", bit("before"), bit("after"))


def told(entities: DataFrame, base: DataFrame, docs: DataFrame, staged) -> DataFrame:
    """(pii_row, start, end, value): the disclosing words of `base` (pii_row, pii_text, ...), whose entities
    are (pii_row, x). Entities that only one document holds disclose the same words there, so
    one stands for all of them."""
    n = F.lit(docs.count())
    rare = staged(entities.groupBy("x").agg(F.count("*").alias("n_x"), F.min("pii_row").alias("pii_row")).where(F.col("n_x") * 2**BITS <= n))
    alone = rare.where("n_x = 1").select("pii_row", F.concat(F.lit("row:"), F.col("pii_row")).alias("x"), "n_x").distinct()
    held = staged(entities.join(rare.where("n_x > 1").select("x", "n_x"), "x").select("pii_row", "x", "n_x").unionByName(alone))
    near = maybe_among(base.where("pii_text is not null").select("pii_row", "pii_text"), "pii_row", held.select("pii_row"))
    k = F.least(F.bit_count(F.bit_or("before")), F.bit_count(F.bit_or("after"))).alias("k")
    words = staged(tokens(near).groupBy("pii_row", "t").agg(F.count("*").alias("n_rt"), F.bit_or("before").alias("before"), F.bit_or("after").alias("after")))
    # A word passes for no entity unless it would with all documents that hold one taken together.
    able = words.groupBy("t").agg(F.sum("n_rt").alias("n_pt"), k).where(1 - 1 / F.col("k") >= SHARE)
    able = able.join(maybe_among(known(docs), "t", able.select("t")).groupBy("t").agg(F.count("*").alias("n_t")), "t")
    able = staged(able.where(F.col("n_pt") >= SHARE * F.col("n_t")).select("t", "n_t"))
    joint = words.join(able, "t").join(held, "pii_row").groupBy("x", "t").agg(F.sum("n_rt").alias("n_xt"), F.first("n_x").alias("n_x"), F.first("n_t").alias("n_t"), k)
    share = F.col("n_xt") / F.col("n_t") * (1 - 1 / F.col("k"))
    found = joint.where((share >= SHARE) & (F.log2(share * n / F.col("n_x")) >= BITS)).select("x", "t")
    aims = staged(words.select("pii_row", "t").join(held.join(found, "x").select("pii_row", "t"), ["pii_row", "t"], "left_semi"))
    near = maybe_among(near, "pii_row", aims.select("pii_row"))
    terms = tokens(near).join(aims, ["pii_row", "t"], "left_semi").select("pii_row", "start", "end", "value")
    return staged(uncovered(terms, maybe_among(base, "pii_row", aims.select("pii_row"))), keep=True)


def known(docs: DataFrame) -> DataFrame:
    """(t): each word of the corpus, as often as it stands there."""
    return docs.select(F.explode(F.regexp_extract_all(text_or_empty(), F.lit(TERM), F.lit(0))).alias("t")).select(F.lower("t").alias("t"))


def uncovered(terms: DataFrame, base: DataFrame) -> DataFrame:
    """The terms that overlap no base span of their row, by an ordered pass over each row's spans either way."""
    spots = base.select("pii_row", F.explode(F.concat(*[F.col(f"pii_{k}") for k in PATTERNS])).alias("b")).select("pii_row", "b.start", "b.end")
    spots = terms.unionByName(spots.withColumn("value", F.lit(None).cast("string")))
    is_base = F.col("value").isNull()
    rows, order = Window.partitionBy("pii_row"), [F.col("start"), F.col("end"), is_base]
    # Both windows look back, since frames that look ahead to the end are computed anew for each row.
    up, down = (rows.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (order, [c.desc() for c in order]))
    before, after = F.max(F.when(is_base, F.col("end"))).over(up), F.min(F.when(is_base, F.col("start"))).over(down)
    spots = spots.withColumns({"pii_before": before, "pii_after": after})
    return spots.where("value is not null and coalesce(pii_before <= start, true) and coalesce(pii_after >= end, true)").select("pii_row", "start", "end", "value")


def spans(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs with pii_email, pii_ip, pii_card, pii_phone and pii_term: arrays of (start, end, value).

    Each row gets a number when it is written, so rows are found again whatever their ids and
    texts. With keep_text the result has all columns; without, all but `text`."""
    text = text_or_empty()
    with scratch(docs.sparkSession) as staged:
        base = docs.withColumns({"pii_row": F.monotonically_increasing_id(), **{f"pii_{k}": c for k, c in base_spans(text).items()}})
        some = F.greatest(*[F.size(f"pii_{k}") for k in PATTERNS]) > 0
        rest = docs.columns if keep_text else [c for c in docs.columns if c != "text"]
        base = staged(base.select("pii_row", *rest, F.when(some, text).alias("pii_text"), *[f"pii_{k}" for k in PATTERNS]), keep=True)
        values = F.array_distinct(F.concat(*[F.transform(f"pii_{k}", lambda s, k=k: F.concat(F.lit(f"{k}:"), F.lower(s["value"]))) for k in PATTERNS]))
        entities = base.where("pii_text is not null").select("pii_row", F.explode(values).alias("x"))
        terms = told(entities, base, docs, staged)
        terms = staged(terms.groupBy("pii_row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "value"))).alias("pii_term")), keep=True)
    out = base.drop("pii_text").join(terms, "pii_row", "left")
    return out.withColumn("pii_term", F.coalesce("pii_term", F.array().cast(SPAN))).drop("pii_row")


def joined_spans(kinds) -> Column:
    return F.array_join(F.concat(*[F.transform(F.col(f"pii_{k}"), span_text(k)) for k in kinds]), ",")


def without(text: Column, cuts: Column) -> Column:
    """The text with the sorted cuts (start, end, kind) replaced by marks. It is taken apart once, into
    pieces of PIECE code points, and each gap is put together from the few pieces it touches; how far
    cuts reach is carried from block to block of BLOCK cuts."""
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def gap(pieces, start, end):
        first = F.floor(start / PIECE).cast("int")
        held = F.array_join(F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, (start % PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    def body(x):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["cuts"]) - 1) / BLOCK).cast("int")), lambda b: F.slice(x["cuts"], b * BLOCK + 1, F.lit(BLOCK)))
        reach = lambda a, b: F.greatest(a["at"], F.array_max(F.transform(b, lambda s: s["end"])))
        carry = lambda a, b: F.struct(reach(a, b).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return let(blocks, lambda bs: let(F.aggregate(bs, F.struct(zero.alias("at"), none.alias("out")), carry), lambda c: F.array_join(F.concat(F.flatten(F.zip_with(bs, c["out"], marked(x["pieces"]))), F.array(gap(x["pieces"], c["at"], x["n"]))), "")))

    def marked(pieces):
        def each(block, at):
            def cut(a, s):
                mark = F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
                fresh = F.when(s["start"] >= a["at"], F.array(gap(pieces, a["at"], s["start"]), mark)).otherwise(F.array().cast("array<string>"))
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["out"], fresh).alias("out"))

            return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<string>").alias("out")), cut)["out"]

        return each

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(F.struct(pieces.alias("pieces"), cuts.alias("cuts"), F.length(text).cast("bigint").alias("n")), body)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each base span generalised to its kind in brackets and each
    disclosing term removed; overlapping spans become one, of the kind that starts first.
    A column n_chars, if there is one, is set to the new length."""
    cuts = F.array_sort(F.concat(*[F.transform(F.col(f"pii_{k}"), span_kind(k)) for k in [*PATTERNS, "term"]]))
    some = F.size("pii_cuts") > 0
    out = spans(docs).withColumn("pii_cuts", cuts)
    out = out.withColumn("text", F.when(some, without(F.col("text"), F.col("pii_cuts"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    counts = [F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(joined_spans(PATTERNS), 256).alias("base_sha256"), joined_spans([*PATTERNS, "term"]).alias("spans"), F.size("pii_term").cast("long").alias("n_term"))
