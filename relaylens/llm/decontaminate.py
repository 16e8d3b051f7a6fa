"""Benchmark decontamination with built-in functions only.

Texts are lower-cased (A-Z) and cut into words. The windows of an item are its runs of ``WINDOW``
words, or all its words if it has fewer. The hashes of all windows form a set that is sent with
the plan while there are at most ``SET_LIMIT`` of them (a benchmark is small; beyond that the
documents' windows are joined with the set instead). Each document's windows are looked up
inside its row, so texts are not shuffled; only hits leave the row, with the words themselves, and
are verified against the items' words by a join.

Null texts have no words. Items without words have no window; an item without id marks words but is
not listed. Rows of equal id and text share one answer. Documents or items may be empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relaylens.llm.common import fresh, sent, written

WINDOW = 13
SET_LIMIT = 20_000  # hashes in the set: 160 kB
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, GAPS), "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), use)[0]


def hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def window_hash(hashed: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.slice(hashed, at, size))


def starts(found: Column, size: int) -> Column:
    """1, 2, ... up to the last place where a window of ``size`` words fits."""
    last = F.size(found) - (size - 1)
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))


def phrase(found: Column, at: Column, size) -> Column:
    return F.array_join(F.slice(found, at, size), " ")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, hash, phrase): the distinct windows of each item."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).filter(
        F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    at = cut.select("item_id", "w", "size", F.explode(F.sequence(
        F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    return at.select(
        "item_id", "size", F.xxhash64(F.slice(hashes(F.col("w")), F.col("at"), F.col("size")))
        .alias("hash"), phrase(F.col("w"), F.col("at"), F.col("size")).alias("phrase")).distinct()


def _in_set(value: Column, members: list[int]) -> Column:
    """Spark turns a long IN list of literals into a hash set."""
    return value.isin(members)


def _hit_list(found: Column, known: dict[int, list[int]]) -> Column:
    """array<struct<at, size, phrase>> of the windows whose hash is in the set."""
    def of_size(hashed, size: int, members: list[int]) -> Column:
        at = F.filter(starts(found, size),
                      lambda i: _in_set(window_hash(hashed, i, size), members))
        return F.transform(at, lambda i: F.struct(
            i.alias("at"), F.lit(size).alias("size"), phrase(found, i, size).alias("phrase")))

    def per_row(hashed):
        return F.concat(*[of_size(hashed, size, members)
                          for size, members in sorted(known.items())])

    return bound(hashes(found), per_row)


NO_HITS = "array<struct<at: int, size: int, phrase: string>>"


def _looked_up(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, digest, n_words, hits) while the set travels with the plan."""
    known: dict[int, list[int]] = {}
    for row in windows.groupBy("size").agg(F.collect_set("hash").alias("h")).collect():
        known[row["size"]] = sorted(row["h"])  # at most SET_LIMIT in all

    def per_row(found):
        hits = _hit_list(found, known) if known else F.array().cast(NO_HITS)
        return F.struct(F.size(found).cast("long").alias("n_words"), hits.alias("hits"))

    return rows.select("doc_id", "digest", bound(words(F.col("text")), per_row).alias("r")
                       ).select("doc_id", "digest", "r.*")


def _all_windows(found: Column, size: int) -> Column:
    return bound(hashes(found), lambda h: F.transform(
        starts(h, size), lambda i: window_hash(h, i, size)))


def _joined(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The same for sets of any size: all windows of the documents meet the set in a join."""
    cut = rows.withColumn("w", words(F.col("text")))
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # WINDOW at most
    at = None
    for size in sizes:
        every = cut.select("doc_id", "digest", F.lit(size).alias("size"), F.posexplode(
            _all_windows(F.col("w"), size)).alias("at", "hash"))
        at = every if at is None else at.unionByName(every)
    found = at.join(windows.select("size", "hash").distinct(), ["size", "hash"]).groupBy(
        F.col("doc_id").alias("id"), F.col("digest").alias("d")).agg(F.collect_set(
            F.struct((F.col("at") + 1).alias("at"), "size")).alias("found"))
    both = cut.join(found, cut["doc_id"].eqNullSafe(found["id"])
                    & (cut["digest"] == found["d"]), "left")
    hits = F.transform(F.coalesce("found", F.array().cast("array<struct<at: int, size: int>>")),
                       lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"),
                                          phrase(F.col("w"), x["at"], x["size"])
                                          .alias("phrase")))
    return both.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"),
                       hits.alias("hits"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans (struct of at and size), which are in order of place."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(s, x):
        end = x["at"] + x["size"]
        return F.struct(
            (s["n"] + F.greatest(F.lit(0), end - F.greatest(x["at"], s["end"]))).alias("n"),
            F.greatest(s["end"], end).alias("end"))

    return F.aggregate(spans, state, step, lambda s: s["n"].cast("long"))


def found_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                  set_limit: int = SET_LIMIT) -> DataFrame:
    """doc_id, digest, n_words, spans (of verified windows, by place), items (sorted ids)."""
    rows = docs.select("doc_id", "text").withColumn(
        "digest", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    windows = written(item_windows(items, window), "windows")
    small = windows.select("size", "hash").distinct().count() <= set_limit
    looked = written((_looked_up if small else _joined)(rows, windows), "hits")
    phrases = windows.select("item_id", F.col("phrase").alias("known"))
    hits = looked.filter(F.size("hits") > 0).select(
        "doc_id", "digest", F.explode("hits").alias("h")).distinct()
    sure = hits.join(F.broadcast(phrases) if small else phrases,
                     F.col("h.phrase") == F.col("known"))
    by_row = sure.groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_set(F.struct("h.at", "h.size"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = looked.alias("l").join(
        by_row.alias("b"), F.col("l.doc_id").eqNullSafe(F.col("b.doc_id"))
        & (F.col("l.digest") == F.col("b.digest")), "left")
    return both.select(
        "l.doc_id", "l.digest", "l.n_words",
        F.coalesce("b.spans", F.array().cast("array<struct<at: int, size: int>>")).alias("spans"),
        F.coalesce("b.items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def judged(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, digest, n_words, n_hit, items, contaminated, spans: a row for every row."""
    found = found_windows(docs, items, **options).withColumn("n_hit", covered(F.col("spans")))
    return found.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def without(text: Column, spans: Column) -> Column:
    """A text without the words of the spans and what separates them from the next word."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(
        r"([0-9A-Za-z\x{80}-\x{10FFFF}]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    lead = F.regexp_extract(F.coalesce(text, F.lit("")),
                            r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    kept = F.filter(pieces, lambda _, i: ~F.exists(
        spans, lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["size"])))
    return F.concat(lead, F.array_join(kept, ""))


def cleaned(docs: DataFrame, items: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the words of
    benchmark windows; all columns and all other rows stay as they are."""
    found = judged(docs, items, **options).filter(
        "contaminated" if remove == "documents" else "n_hit > 0").select(
        F.col("doc_id").alias("id"), F.col("digest").alias("d"), "spans").dropDuplicates(
        ["id", "d"])
    if remove == "documents":  # whole texts need no shuffle for a list of ids
        found = sent(written(found.drop("spans"), "contaminated"))
    digest = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    same = docs["doc_id"].eqNullSafe(found["id"]) & (digest == found["d"])
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    spans = fresh(docs, "spans")
    both = docs.join(found.select("id", "d", F.col("spans").alias(spans)), same, "left")
    return both.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(
        without(F.col("text"), F.col(spans)))).select(*docs.columns)
