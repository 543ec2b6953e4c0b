"""Operator 5: personal data, and the terms that give it away. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Every distinct value found is a protected
entity c. Terms t are the words of three letters and more of every document that holds the entity, and document counts
over the whole corpus tell how much a term discloses: the share

    PMI(c; t) / IC(c) = log(N n(c,t) / (n(c) n(t))) / log(N / n(c))

of the entity's information content that the term gives away, where n(c,t) and n(t) count documents with the term
anywhere. It is 1 if the term occurs with the entity only. From REMOVE_AT on a term is removed, from GENERALISE_AT on it
is generalised to a placeholder, at all its places in the documents that hold the entity; of two entities' verdicts on a
word the stricter holds. Entities of the same documents share their counts and are one holder g in what follows. Entities of a single document count like others: a word found in
that document only gives it away wholly.

Positions are code points, the end exclusive. Java's regular expressions find the same leftmost non-overlapping matches
as the plain patterns; they are written possessively and anchored at the start of a run, so that time stays linear in
long runs and no match recurses. split() and regexp_extract_all() see the same matches, and the lengths of gaps and
matches add up to positions.

Defined cases: a null text counts as empty and has no span; repeated rows each count as a document and each give a row;
an empty table gives an empty table; other columns are carried by sanitise() and ignored by find(); spans of two kinds
may overlap, all are reported, and sanitise() replaces their union by the placeholder of the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # whole runs of 14 to 19 digits: a run of another length is a match that fails
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
TERM = r"\p{L}{3,}+"
GENERALISE_AT, REMOVE_AT = 0.9, 0.98
SPAN = "array<struct<s:int,e:int,v:string>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, v>> of a pattern's matches in a text."""
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("n"), h.alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a, x):
        s = a["at"] + x["g"]
        return F.when(x["h"].isNull(), a).otherwise(F.struct((s + x["n"]).alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["h"].alias("v")))).alias("out")))

    return F.aggregate(steps, start, step, lambda a: a["out"])


def luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), "(?<=.)(?=.)"), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, kind, v>> sorted by start, then kind as listed."""
    n_digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    valid = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["v"].rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
        "card": lambda x: luhn(x["v"]),
        "phone": lambda x: n_digits(x["v"]).between(10, 15),
    }
    empty = F.array().cast("array<struct<s:int,k:int,e:int,kind:string,v:string>>")

    def one(k: int, kind: str) -> Column:
        spans = F.filter(located(text, PATTERNS[kind]), valid[kind])
        spans = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v")))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(empty) if NEEDS[kind] else spans

    found = [one(k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*found))


def written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))))


def _scanned(docs: DataFrame, text_col: str, carried: list[Column]) -> DataFrame:
    """A written table: row number, what is carried, the text and its base spans."""
    base = docs.select(*carried, docs[text_col].cast("string").alias("_text")).withColumn("_spans", base_spans(F.coalesce(F.col("_text"), F.lit(""))))
    return kept(base.withColumn("_row", F.monotonically_increasing_id()))


def terms(text: Column) -> Column:
    """The distinct words of three letters and more, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.array_distinct(F.split(text, r"\P{L}+")), lambda w: F.length(w) >= 3), F.lower))


def _holders(scanned: DataFrame) -> DataFrame:
    """(_row, g, n_c): the sets of documents that hold an entity, each once, by row; g names a set by 128 bits."""
    holds = kept(scanned.select("_row", F.explode(F.array_distinct(F.transform("_spans", lambda x: F.xxhash64(x["kind"], F.lower(x["v"]))))).alias("c")))
    entities = holds.groupBy("c").agg(F.count("*").alias("n_c"), F.bit_xor(F.xxhash64("_row")).alias("x"), F.bit_xor(F.xxhash64("_row", F.lit("second"))).alias("y"))
    return holds.join(entities, "c").select("_row", F.struct("x", "y").alias("g"), "n_c").distinct()


def _term_spans(scanned: DataFrame) -> DataFrame:
    """(_row, _terms array<struct<s, k, e, kind>>): disclosing terms in the documents of their entities."""
    n_docs = float(scanned.count())
    holders = kept(_holders(scanned).where(F.col("n_c") < n_docs))
    # no share reaches GENERALISE_AT unless n(t) <= n(c) ** GENERALISE_AT * N ** (1 - GENERALISE_AT), as n(c,t) <= n(c)
    most = F.pow(F.col("n_c"), F.lit(GENERALISE_AT)) * max(n_docs, 1.0) ** (1 - GENERALISE_AT) * (1 + 1e-9)
    at_most = holders.agg(F.max(most)).first()[0] or 0.0
    in_docs = scanned.select(F.explode(terms(F.col("_text"))).alias("t")).groupBy("t").agg(F.count("*").alias("n_t")).where(F.col("n_t") <= at_most)
    own = scanned.where(F.size("_spans") > 0).select("_row", F.explode(terms(F.col("_text"))).alias("t")).join(in_docs, "t")
    found = kept(own.join(holders, "_row").where(F.col("n_t") <= most))
    share = F.log(F.lit(n_docs) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(n_docs) / F.col("n_c"))
    told = found.groupBy("g", "t").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t")).withColumn("share", share).where(F.col("share") >= GENERALISE_AT)
    told = kept(found.join(told.select("g", "t", "share"), ["g", "t"]).groupBy("_row", "t").agg(F.max("share").alias("share")))

    # places: the lengths of gaps and words add up in order
    texts = scanned.where(F.size("_spans") > 0).join(told.select("_row").distinct(), "_row", "left_semi").select("_row", "_text")
    steps = F.zip_with(F.split("_text", TERM, -1), F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)), lambda g, h: F.struct((F.length(g) + F.coalesce(F.length(h), F.lit(0))).alias("step"), F.length(h).alias("n"), F.lower(h).alias("t")))
    ends = F.sum("x.step").over(Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    places = texts.select("_row", F.posexplode(steps).alias("i", "x")).select("_row", "x.t", "x.n", ends.alias("e"))
    marked = places.join(told, ["_row", "t"]).withColumn("kind", F.when(F.col("share") >= REMOVE_AT, "remove").otherwise("generalise"))
    span = F.struct((F.col("e") - F.col("n")).alias("s"), F.when(F.col("kind") == "remove", 4).otherwise(5).alias("k"), F.col("e"), F.col("kind"))
    return marked.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_terms"))


def _joined(docs: DataFrame, text_col: str, carried: list[Column]) -> DataFrame:
    scanned = _scanned(docs, text_col, carried)
    rows = scanned.join(_term_spans(scanned), "_row", "left")
    bare = F.transform("_spans", lambda x: F.struct(x["s"], x["k"], x["e"], x["kind"]))
    # a word within a base span is covered already
    free = F.filter(
        F.coalesce("_terms", F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")),
        lambda x: ~F.exists(F.col("_spans"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])),
    )
    return rows.withColumn("_all", F.array_sort(F.concat(bare, free)))


def find(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row."""
    rows = _joined(docs, text_col, [docs[id_col].cast("long").alias("doc_id")])

    def count(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("_spans")), 256).alias("base_sha256"), written(F.col("_all")).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every span of the text replaced: [EMAIL] and so on, [TERM], or nothing for removed terms."""
    rows = _joined(docs, text_col, [F.struct(*(docs[c] for c in docs.columns)).alias("doc")])  # within a struct no name clashes
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        name = F.when(x["kind"] == "remove", "").when(x["kind"] == "generalise", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        within = F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))
        return F.when(x["s"] < a["at"], within).otherwise(F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, x["s"] - a["at"]), name).alias("out")))

    new = F.aggregate("_all", start, step, lambda a: F.concat(a["out"], F.substring(F.col("_text"), a["at"] + 1, F.lit(2**31 - 1))))
    was = F.col("doc")
    return rows.select(*(F.when(F.size("_all") > 0, new).otherwise(was[c]).alias(c) if c == text_col else was[c].alias(c) for c in docs.columns))
