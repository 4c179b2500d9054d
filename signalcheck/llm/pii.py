"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Protected entities are the values the base patterns find. Terms in the texts of an entity are weighed by corpus
co-occurrence: PMI(term, entity) over the information content of the entity is the share of the entity that the term
discloses. Terms at or above the threshold, seen with the entity in enough different texts, are spans in every text
that holds them, also without the entity: they are generalised to a placeholder, entities to their kind.

A null text counts as empty. The spans of a row depend on its text and the corpus alone, so repeated rows agree. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalcheck.llm.common import table
from signalcheck.plans.skew import broadcast_if_small, lookup
from signalcheck.session import Scratch, materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Look-behinds and possessive loops give the same matches in linear time.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LETTER = r"[\p{L}\p{M}]"
#: Letters of scripts that put no space between a name and its neighbours.
DENSE = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Words of four letters or more, shorter ones with a capital, and of any length in scripts without capitals.
TERM = rf"(?<!{LETTER})(?:{LETTER}{{4,}}+|[\p{{Lu}}\p{{Lt}}]{LETTER}{{0,2}}+|\p{{Lo}}{LETTER}{{0,2}}+)(?!{LETTER})"
DISCLOSURE = 0.9
SUPPORT = 3
#: Pairs of one text, and rows of one text, that a task takes before they are cut.
PAIRS_PER_TASK = 1_000_000
ROWS_PER_TASK = 50_000


def matches(text: Column, pattern: str | Column) -> Column:
    """(start, end, value) of all matches, in code points: the gaps between matches give the places."""
    hits = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(hits.alias("h"), F.slice(gaps, 1, F.size(hits)).alias("g"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def add(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["h"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["h"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    found = F.aggregate(zipped, start, add, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def luhn(value: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))
    each = F.transform(
        digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5))
    )
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b.cast("long")) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return digits.between(16, 19) & F.when(digits.between(16, 19), luhn(value)).otherwise(False)
    return digits.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> by kind as listed, then start."""
    may = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.contains("."), "card": F.lit(True)}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def of_kind(kind: str) -> Column:
        good = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
        named = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
        return F.when(may[kind], F.transform(good, named)).otherwise(none)

    return F.concat(*map(of_kind, KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_base(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text, its key and base spans, written once."""
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    return scratch.materialize(read.withColumn("key", F.md5("text")), "pii-base")


def windows(run: Column) -> Column:
    """All parts of two to four characters of a run that is written without spaces."""
    ends = F.sequence(F.lit(2), F.least(F.length(run), F.lit(4)))
    return F.flatten(F.transform(ends, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substr(run, i, n)
    )))


def terms_of(text: Column, base: Column) -> Column:
    """Different terms of a text, in lower case, without what its base spans hold."""
    rest = F.aggregate(base, text, lambda acc, s: F.replace(acc, s["value"], F.lit(" ")))
    words = F.regexp_extract_all(rest, F.lit(TERM), F.lit(0))
    dense = F.when(rest.rlike(f"{DENSE}{{2}}"), F.flatten(F.transform(F.regexp_extract_all(rest, F.lit(f"{DENSE}{{2,}}+"), F.lit(0)), windows)))
    return F.array_distinct(F.transform(F.concat(words, F.coalesce(dense, F.array().cast("array<string>"))), F.lower))


def most_texts(n_entity, total: int) -> Column:
    """No term in more texts than this tells DISCLOSURE of an entity of ``n_entity`` texts.

    With n_both <= n_entity the share reaches d only if n_term <= n_both * (N / n_entity)^(1 - d).
    """
    return F.pow(F.col(n_entity).cast("double"), F.lit(DISCLOSURE)) * (float(total) ** (1 - DISCLOSURE) * (1 + 1e-9))


def disclosing_terms(base: DataFrame, scratch: Scratch) -> DataFrame:
    """The terms that disclose some entity, by counts over whole texts."""
    texts = base.filter(F.size("base") > 0).groupBy("key").agg(
        F.first("text").alias("text"), F.first("base").alias("base"), F.count("*").alias("copies")
    )
    named = texts.select("key", "copies", F.explode(F.array_distinct(F.transform("base", lambda s: F.lower(s["value"])))).alias("entity"))
    named = scratch.materialize(named, "pii-named")
    # No term meets an entity in more texts than the entity has.
    entities = named.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT).drop("texts")
    entities = scratch.materialize(entities, "pii-entities")
    total = base.count()
    most = entities.agg(F.max(most_texts("n_entity", total))).first()[0]
    if most is None:
        return entities.select(F.col("entity").alias("term")).limit(0)
    # Words are counted before they are shuffled, so a common word costs one row per task; the frequency of a term comes
    # first, and only terms that some entity can be told by are paired.
    corpus = base.select(F.explode(terms_of(F.col("text"), F.col("base"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    corpus = scratch.materialize(corpus.filter(F.col("n_term").between(SUPPORT, most)), "pii-frequency")
    held = named.join(entities, "entity").groupBy("key").agg(F.count("*").alias("n_named"), F.max("n_entity").alias("largest"))
    words = texts.join(held, "key").select("key", "n_named", "largest", F.explode(terms_of(F.col("text"), F.col("base"))).alias("term"))
    words = words.join(corpus, "term").filter(F.col("n_term") <= most_texts("largest", total))
    words = scratch.materialize(words.select("key", "n_named", "term", "n_term"), "pii-words")
    # A text of very many entities and words is cut by the number of its pairs.
    parts = words.groupBy("key").agg(F.ceil(F.count("*") * F.max("n_named") / F.lit(PAIRS_PER_TASK)).cast("int").alias("parts"))
    left = named.join(entities, "entity").join(parts, "key").select("key", "entity", "copies", "n_entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = words.join(parts, "key").select("key", "term", "n_term", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int").alias("part"))
    met = left.join(right, ["key", "part"]).filter(F.col("n_term") <= most_texts("n_entity", total))
    both = met.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both")).filter(F.col("texts") >= SUPPORT)
    n = F.lit(float(total))
    pmi = F.log2(F.col("n_both") * n / (F.col("n_entity").cast("double") * F.greatest("n_term", "n_both")))
    told = F.when(F.col("n_entity") < n, pmi / F.log2(n / F.col("n_entity"))).otherwise(0.0)
    return scratch.materialize(both.filter(told >= DISCLOSURE).select("term").distinct(), "pii-disclosing")


def term_spans(text: Column, terms: Column) -> Column:
    """The places of the terms: whole words, or any place in scripts without spaces; short words as terms_of takes them."""

    def of_term(term: Column) -> Column:
        dense = term.rlike(f"^{DENSE}+$")
        edge = lambda side: F.when(dense, F.lit("")).otherwise(F.lit(f"{side}{LETTER})"))
        found = matches(text, F.concat(F.lit("(?iu)"), edge("(?<!"), term, edge("(?!")))
        good = F.filter(found, lambda m: m["value"].rlike(f"^(?:{TERM})$"))
        return F.transform(good, lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit("").alias("value")))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(terms, of_term))))


def with_held(base: DataFrame, disclosing: DataFrame, scratch: Scratch) -> DataFrame:
    """``base`` with ``held``, the disclosing terms of its text, with or without an entity; null where there are none.

    The texts that hold one are few or many. Few keys are broadcast, and no text moves; otherwise a text that a third of
    all rows repeat is joined in as many tasks as its rows need.
    """
    found = base.select("key", F.explode(terms_of(F.col("text"), F.col("base"))).alias("term")).join(broadcast_if_small(disclosing), "term")
    found = found.groupBy("key", "term").agg(F.count("*").alias("rows"))
    keys = scratch.materialize(found.groupBy("key").agg(F.max("rows").alias("rows"), F.sort_array(F.collect_list("term")).alias("held")), "pii-held")
    small = broadcast_if_small(keys)
    if small is not keys:
        return base.join(small.drop("rows"), "key", "left")
    return lookup(base, keys, "key", "rows", F.col("doc_id"), "left", ROWS_PER_TASK)


def find_personal(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key, base spans, and all spans with the method's terms that touch no base span."""
    with Scratch(docs.sparkSession) as scratch:
        base = find_base(docs, scratch)
        held = with_held(base, disclosing_terms(base, scratch), scratch)
        clear = lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"]))
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
        terms = F.when(F.col("held").isNotNull(), F.filter(term_spans(F.col("text"), F.col("held")), clear)).otherwise(none)
        return materialize(held.select("doc_id", "key", "base", F.concat("base", terms).alias("all")), "pii-spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; n_chars, where there, follows the text."""
    spans = find_personal(docs.select("doc_id", "text")).filter(F.size("all") > 0).groupBy("key").agg(F.count("*").alias("_rows"), F.array_sort(F.first(
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )).alias("_spans"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    keyed = docs.select(own, F.coalesce("text", F.lit("")).alias("text"), F.md5(F.coalesce("text", F.lit(""))).alias("_key"))
    marked = lookup(keyed, spans.withColumnRenamed("key", "_key"), "_key", "_rows", F.xxhash64("_doc"), "left", ROWS_PER_TASK)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, s):
        # A span inside one already replaced adds nothing; what sticks out is cut away.
        gap = F.substr(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    clean = F.aggregate("_spans", begin, add, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text"))))
    changed = F.col("_spans").isNotNull()
    new = {"text": F.when(changed, clean).otherwise(F.col("_doc.text"))}
    if "n_chars" in docs.columns:
        size = F.length(clean).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, size).otherwise(F.col("_doc.n_chars"))
    return marked.select(*(new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
