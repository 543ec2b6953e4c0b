"""Operator 10: document fingerprints as invertible Bloom lookup sketches. DataFrame functions only.

A text's paragraphs are its lines, cut at PIECE code points where they are longer; its keys are their distinct 64-bit
hashes. A sketch has three tables of m cells, m a power of two not below the number of keys. Each key is counted in one
cell of each table, which holds the number of keys, the xor of the keys and the xor of their check hashes; empty cells
aren't kept. The fingerprint is the written sketch, so equal texts have equal fingerprints.

Two versions are compared by subtracting sketches of the same m: shared keys cancel. A cell with one key left, as its
check hash confirms, gives the key and its side; taking that key out of its other cells opens more of them. If cells
remain that nothing opens, the comparison is done again with m doubled, twice, and at last by the key sets themselves.
The likeness is the share of the joint keys that both have.

All of it is done within a row; the one shuffle lays the documents out by id, so that each can see the next.

Defined cases: a null text counts as empty; a text without keys (empty, or newlines only) is like another such text (1)
and unlike any other (0); repeated paragraphs count once; rows with the same id follow each other in the order of their
text's hash; an empty table gives an empty table; other columns are ignored. After the last document comes the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import kept

PIECE, LEAST, ROUNDS, DOUBLINGS, BATCH = 256, 4, 12, 2, 256
CELL = "struct<i:int,c:int,x:bigint,h:bigint>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.transform(F.array(value), body)[0]


def keys_of(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[^\n]{1,%d}+" % PIECE), F.lit(0)), lambda p: F.xxhash64(p))))


def table_cells(n_keys: Column) -> Column:
    """m: the least power of two that isn't below the number of keys."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n_keys, F.lit(LEAST)).cast("double")))).cast("int")


def entries(keys: Column, sign: Column, m: Column) -> Column:
    """A cell of each table for every key: array<struct<i, c, x, h>>."""

    def cell(k: Column, j: int) -> Column:
        return F.struct((F.pmod(F.xxhash64(k, F.lit(j)), m.cast("long")) + j * m.cast("long")).cast("int").alias("i"), sign.alias("c"), k.alias("x"), F.xxhash64(k, F.lit(7)).alias("h"))

    return F.flatten(F.transform(keys, lambda k: F.array(*(cell(k, j) for j in range(3)))))


def summed(cells: Column) -> Column:
    """The cells of each place added up, places in order, without those that come to nothing."""
    none = F.array().cast(f"array<{CELL}>")
    start = F.struct(F.array().cast(f"array<array<{CELL}>>").alias("done"), none.alias("cur"), F.lit(None).cast(CELL).alias("last"))

    def live(c: Column) -> Column:
        return c.isNotNull() & ((c["c"] != 0) | (c["x"] != 0) | (c["h"] != 0))

    def put(cur: Column, c: Column) -> Column:
        return F.when(live(c), F.concat(cur, F.array(c))).otherwise(cur)

    def step(a: Column, e: Column) -> Column:
        same = a["last"]["i"] == e["i"]
        joined = F.struct(e["i"].alias("i"), (a["last"]["c"] + e["c"]).alias("c"), a["last"]["x"].bitwiseXOR(e["x"]).alias("x"), a["last"]["h"].bitwiseXOR(e["h"]).alias("h"))
        full = F.size(a["cur"]) >= BATCH  # cells are gathered in batches: appending to one long array would copy it each time
        moved = F.struct(F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"), put(F.when(full, none).otherwise(a["cur"]), a["last"]).alias("cur"), e.alias("last"))
        return F.when(same, F.struct(a["done"].alias("done"), a["cur"].alias("cur"), joined.alias("last"))).otherwise(moved)

    return F.aggregate(F.array_sort(cells), start, step, lambda a: F.flatten(F.concat(a["done"], F.array(put(a["cur"], a["last"])))))


def sketch(keys: Column, m: Column) -> Column:
    return summed(entries(keys, F.lit(1), m))


def written(n_keys: Column, m: Column, cells: Column) -> Column:
    """keys:m:base64 of place, count, key xor and check xor (its low half) of every cell."""
    body = F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["i"]), 8, "0"), F.lpad(F.hex(c["c"]), 8, "0"), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["h"].bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")
    return F.concat(n_keys.cast("string"), F.lit(":"), m.cast("string"), F.lit(":"), F.regexp_replace(F.base64(F.unhex(body)), "[\r\n]", ""))


def peeled(a: Column, b: Column, m: Column) -> Column:
    """struct<cells, plus, minus>: cells that stayed shut, and the numbers of keys recovered of a only and of b only."""
    start = F.struct(summed(F.concat(entries(a, F.lit(1), m), entries(b, F.lit(-1), m))).alias("cells"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))

    def step(s: Column, _: Column) -> Column:
        pure = F.filter(s["cells"], lambda c: (F.abs(c["c"]) == 1) & (F.xxhash64(c["x"], F.lit(7)) == c["h"]))
        found = F.array_distinct(F.transform(pure, lambda c: F.struct(c["x"].alias("x"), c["c"].alias("c"))))

        def without(f: Column) -> Column:
            out = F.flatten(F.transform(f, lambda k: entries(F.array(k["x"]), -k["c"], m)))
            n = F.size(F.filter(f, lambda k: k["c"] > 0))
            return F.struct(summed(F.concat(s["cells"], out)).alias("cells"), (s["plus"] + n).alias("plus"), (s["minus"] + F.size(f) - n).alias("minus"))

        return F.when(F.size(s["cells"]) == 0, s).otherwise(let(found, lambda f: F.when(F.size(f) == 0, s).otherwise(without(f))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def likeness(a: Column, b: Column) -> Column:
    """The share of joint keys, by peeling the difference of two sketches; a and b are distinct keys."""
    exact = F.struct(F.array().cast(f"array<{CELL}>").alias("cells"), F.size(F.array_except(a, b)).alias("plus"), F.size(F.array_except(b, a)).alias("minus"))
    m = table_cells(F.greatest(F.size(a), F.size(b)))

    def attempt(k: int) -> Column:
        if k > DOUBLINGS:
            return exact
        return let(peeled(a, b, m * (1 << k)), lambda s: F.when(F.size(s["cells"]) == 0, s).otherwise(attempt(k + 1)))

    share = let(attempt(0), lambda s: (F.size(a) - s["plus"]).cast("double") / (F.size(a) + s["minus"]))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).when(a == b, 1.0).otherwise(share)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, keys, fingerprint) of every row."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), keys_of(F.col("text")).alias("keys"))
    m = table_cells(F.size("keys"))
    return rows.withColumn("fingerprint", written(F.size("keys"), m, sketch(F.col("keys"), m)))


def with_next(rows: DataFrame, order: list[str], carried: list[str]) -> DataFrame:
    """Each row with columns next_* of the row after it in ascending order, cyclically.

    The order is cut at quantiles of its first column. Each part gets a copy of the next part's first row as its last,
    so one shuffle serves, and no task holds more than a part.
    """
    spark = rows.sparkSession
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = order[0]
    bounds = sorted(set(rows.agg(F.percentile_approx(first, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(first))) if bounds else F.lit(0)
    rows = rows.withColumn("_part", part)
    firsts = rows.groupBy("_part").agg(F.min(F.struct(*order)).alias("_first"))  # a row for each part
    heads = {r["_part"]: tuple(r["_first"]) for r in firsts.collect()}
    live = sorted(heads)
    if not live:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carried)).drop("_part")
    before = spark.createDataFrame([(p, *heads[q]) for p, q in zip(live, live[1:] + live[:1], strict=True)], "_to int, " + ", ".join(f"_k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(order)]
    ends = rows.join(F.broadcast(before), same[0] if len(same) == 1 else same[0] & same[1]).drop("_part").withColumnRenamed("_to", "_part")
    ends = ends.drop(*(f"_k{i}" for i in range(len(order)))).withColumn("_end", F.lit(1)).select(*rows.columns, "_end")
    laid = rows.withColumn("_end", F.lit(0)).unionByName(ends)
    w = Window.partitionBy("_part").orderBy("_end", *order)
    return laid.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where("_end = 0").drop("_part", "_end")


def compare_with_edit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document against its edited text, whose last quarter is the beginning of the next document, and against the next."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = with_next(rows, ["doc_id", "_tie"], ["text"])
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"), keys_of(F.col("next_text")).alias("next_keys"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), keys_of(F.col("text")).alias("keys"), keys_of(F.col("edited")).alias("edited_keys"), "next_keys")
    rows = kept(rows)
    a, e, x = F.col("keys"), F.col("edited_keys"), F.col("next_keys")

    def print_of(keys: Column) -> Column:
        return let(table_cells(F.size(keys)), lambda m: written(F.size(keys), m, sketch(keys, m)))

    return rows.select("doc_id", "n_chars", "edited_sha256", print_of(a).alias("fingerprint"), print_of(e).alias("edited_fingerprint"), likeness(a, e).alias("near_edited"), likeness(a, x).alias("near_next"))
