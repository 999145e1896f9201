"""Personal data: base patterns, and terms that reveal them, found by corpus co-occurrence.

Base spans are found by four patterns; spans that fail their kind's test are dropped. Every value is a
protected entity. Terms are runs of three or more letters. An entity is estimated at three levels, so that one seen once
or twice has an estimate too: its value, its group (domain of an address, network of an IP, issuer of a card, a phone number
without its last four digits) and its kind. For each term t and level e, co counts the documents that hold both anywhere, df
those that hold t (or e) at all, over the whole corpus. t discloses e if at least LEAST_SUPPORT documents support it, at least
LEAST_SHARE of the documents with t hold e, and it carries log2(co * N / (df(t) * df(e))) >= LEAST_BITS
of information about e; the level that tells most counts. Each occurrence of t outside base spans, in whichever text, becomes
a span of kind `term`. In sanitised texts base spans are generalised to the name of their kind; terms are
generalised to [TERM], or removed from REMOVE_BITS on.

All of it is DataFrame and SQL functions. Offsets are code points, ends exclusive.

Null text: as empty, no spans (sanitise leaves it null). Very long runs of one character class are scanned once.
Null doc_ids and repeated rows keep their rows; equal rows share their spans and count once each. Empty
table: no rows. Clashing further columns are not read by digests; sanitise returns them, n_chars brought up to date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Characters beside an entity within which the tests count plainly; the operator counts over whole documents.
WINDOW = 48
LEAST_SUPPORT, LEAST_SHARE, LEAST_BITS, REMOVE_BITS = 3, 0.5, 4.0, 12.0
KINDS = ["email", "ip", "card", "phone"]
TERM = r"\p{L}{3,}"
#: Disclosing terms that are sent to every task at once.
LISTED = 1 << 17

# The patterns of the contract, written so that a run of characters is entered at its first one only
# (or where the last match ended) and never given back; that changes no match but keeps long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?=(?:[0-9][\x20-]?){13})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.(?!$)|$)){4}$"


def _found(text: Column, pattern: str | Column) -> Column:
    """Matches of the pattern: array of (start, end, value)."""
    matches, gaps = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,end:int,value:string>>)").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.split(F.reverse(_digits(value)), "")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return F.when(size.between(13, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return size.between(9, 15)
    return F.lit(True)


_HINTS = {"email": "@", "ip": ".", "phone": "+"}
_NONE = "CAST(array() AS array<struct<start:int,end:int,value:string>>)"


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in text (null: as empty), in order: array of (start, end, value)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    some = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else F.lit(True)
    some = some & (text.rlike(r"[0-9][\x20-]?[0-9]") if kind == "card" else F.lit(True))
    return F.when(some, F.filter(_found(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))).otherwise(F.expr(_NONE))


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _based(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, key, text, base: array of (kind, start, end, value), the kinds in their order; and more columns of docs."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    for kind in KINDS:
        found = found.withColumn(kind, base_spans(F.col("text"), kind))
    spans = F.concat(*[_named(F.col(kind), kind) for kind in KINDS])
    return found.select("doc_id", F.xxhash64("text").alias("key"), "text", spans.alias("base"), *more)


def _levels(s: Column) -> Column:
    """The value, the group and the kind of a base span, as hashes."""
    kind, value = s["kind"], F.lower(s["value"])
    digits = _digits(value)
    group = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 3))
    group = group.when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
    return F.array(F.xxhash64(F.lit("value"), kind, value), F.xxhash64(F.lit("group"), kind, group), F.xxhash64(F.lit("kind"), kind))


def _forms() -> Column:
    """Distinct terms of a text as they are written."""
    return F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0)))


def _terms() -> Column:
    return F.array_distinct(F.transform(_forms(), F.lower))


def disclosing(docs: DataFrame) -> DataFrame:
    """Terms that disclose an entity, its group or its kind: term and bits."""
    near = stored(_based(docs).where(F.size("base") > 0).select(F.monotonically_increasing_id().alias("row"), F.array_distinct(F.flatten(F.transform("base", _levels))).alias("levels"), _terms().alias("terms")), "near")
    # how many documents hold each term or level, and how many each pair; a pair has no more support than its level
    held = near.select("row", F.explode("levels").alias("level"))
    levels = held.groupBy("level").agg(F.count("*").alias("df_level")).where(F.col("df_level") >= LEAST_SUPPORT)
    some = held.join(levels.select("level").hint("merge"), "level").groupBy("row").agg(F.collect_list("level").alias("levels"))
    beside = some.join(near.select("row", "terms").hint("merge"), "row").select(F.explode("levels").alias("level"), "terms").select("level", F.explode("terms").alias("term"))
    pairs = beside.groupBy("level", "term").agg(F.count("*").alias("co")).where(F.col("co") >= LEAST_SUPPORT)
    words = docs.select(F.col("text").cast("string").alias("text")).select(F.explode(_terms()).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("df_term")).where(F.col("df_term") >= LEAST_SUPPORT)
    total = docs.select(F.count("*").alias("n"))
    bits = F.log2(F.col("co") * F.col("n") / (F.col("df_term").cast("double") * F.col("df_level")))
    told = pairs.join(terms.hint("merge"), "term").join(levels.hint("merge"), "level").crossJoin(F.broadcast(total))  # one row
    told = told.where(F.col("co") >= LEAST_SHARE * F.col("df_term")).select("term", bits.alias("bits")).where(F.col("bits") >= LEAST_BITS)
    return told.groupBy("term").agg(F.max("bits").alias("bits"))


def revealing(docs: DataFrame) -> DataFrame:
    """Occurrences of disclosing terms in all texts, also within base spans: doc_id, key (hash of the text) and terms, an array of (kind, start, end, value,
    bits) in order. The terms go to every task, LISTED at a time with a pass over docs each; texts stay where they are read."""
    told = stored(disclosing(docs), "told")
    passes = max(1, -(-told.count() // LISTED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    forms = rows.select("doc_id", "key", "text", F.explode(_forms()).alias("form"))
    # a form has letters only, so nothing in it is a sign of the pattern; each match is a whole run of letters
    places = _found(F.col("text"), F.concat(F.lit(r"(?<!\p{L})"), F.col("form"), F.lit(r"(?!\p{L})")))
    spans = F.transform(places, lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end"), F.lit("").alias("value"), F.col("bits").alias("bits")))

    def held(k: int) -> DataFrame:
        some = told.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)  # near LISTED rows
        return forms.join(F.broadcast(some), F.lower("form") == F.col("term")).select("doc_id", "key", spans.alias("own"))

    every = reduce(DataFrame.union, [held(k) for k in range(passes)])
    return every.groupBy("doc_id", "key").agg(F.array_sort(F.flatten(F.collect_set("own"))).alias("terms"))  # the terms of one text


def _with_terms(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows (doc_id, key, base, ...) with terms outside base spans: array of (kind, start, end, value, bits) in order."""
    held = stored(revealing(docs), "terms").withColumnsRenamed({"doc_id": "d", "key": "k"})
    joined = rows.join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left").drop("d", "k")
    outside = F.filter("terms", lambda t: ~F.exists("base", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return joined.withColumn("terms", F.coalesce(outside, F.expr("CAST(array() AS array<struct<kind:string,start:int,end:int,value:string,bits:double>>)")))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of docs (doc_id, text)."""
    based = _based(docs).select("doc_id", "key", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    out = _with_terms(based, docs)
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), lambda x: x.isin(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    line = _line(F.col("base"))
    every = F.concat_ws(",", F.when(F.size("base") > 0, line), F.when(F.size("terms") > 0, _line(F.col("terms"))))
    return out.select("doc_id", *counts, F.sha2(line.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs, all columns, with base spans generalised and disclosing terms generalised or removed in text."""
    names, plain = docs.columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(plain)
    base = F.concat(*[_named(base_spans(F.col("whole.text"), kind), kind) for kind in KINDS])
    rows = rows.withColumn("base", base)
    text = F.col("whole.text").cast("string")
    rows = rows.select("whole", "base", F.col("whole.doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    rows = _with_terms(rows, docs)
    marked = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["bits"] >= REMOVE_BITS, "").otherwise("[TERM]").alias("put"))),
    )

    def put(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, (s["start"] - acc["at"]).cast("int")), s["put"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    changed = F.aggregate(F.array_sort(marked), start, put, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    dirty = F.size("base") + F.size("terms") > 0
    rows = rows.select("whole", dirty.alias("dirty"), F.when(dirty, changed).otherwise(text).alias("fresh"))
    size = F.when(F.col("dirty"), F.char_length("fresh")).otherwise(F.col("whole.n_chars")) if "n_chars" in names else None
    own = [F.col("fresh").alias(c) if c == "text" else size.cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"whole.`{c}`").alias(c) for c in names]
    return rows.select(*own)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
