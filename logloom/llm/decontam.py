"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

Only DataFrame operations: texts become word arrays, and everything else is joins,
aggregations and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, saved, without_rows

# Words of a shingle; items with fewer words are one shingle.
SHINGLE = 5
# Rows, and bytes as JSON text, of a small side that is sent to every task at most;
# beyond either the join shuffles.
SMALL_ROWS, SMALL_BYTES = 50_000, 16 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value of the contract: everything ASCII but letters and digits separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    """A text with A-Z, and nothing else, in lower case.

    In a text of ASCII alone `lower` does just that, in a fraction of the time of `translate`.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def contract_words(text: Column) -> Column:
    """Array of the words of a text, A-Z in lower case; empty without words."""
    parts = F.split(_lowered(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.array_remove(parts, "")


def _word_count(text: Column) -> Column:
    """Number of the words of a text, whatever their case."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), ""))


def _is_small(df: DataFrame) -> bool:
    size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("bigint")), F.lit(0))
    n, text_bytes = df.limit(SMALL_ROWS + 1).agg(F.count(F.lit(1)), size).first()
    return n <= SMALL_ROWS and text_bytes <= SMALL_BYTES


def _shingled(worded: DataFrame, size: int) -> DataFrame:
    """Per place, where the `size` words from there on lie inside: `key`, `words`, `at`, `hash`.

    Hashes are taken after the places are rows: as a function over an array they would be
    interpreted, not compiled.
    """
    count = F.size("words") - size + 1
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return worded.select("key", "words", F.explode(places).alias("at")).withColumn(
        "hash", F.xxhash64(*[F.get("words", F.col("at") + j) for j in range(size)])
    )


def _windows(items: DataFrame, window: int) -> DataFrame:
    """Every item window: `item`, its `words`."""
    words = items.filter(F.size("words") > 0)
    count = F.greatest(F.size("words") - window + 1, F.lit(1))
    return words.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), count), lambda i: F.slice("words", i, F.lit(window))
            )
        ).alias("words"),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    share: int = 20,
) -> DataFrame:
    """How much of every document is text of benchmark items.

    Words are runs of characters other than ASCII separators, with A-Z in lower
    case. A window is `window` consecutive words of an item; a shorter item is one
    window. A document word inside any occurrence of a window is hit. Returns per
    row: the id, `n_words`, `n_hit`, `n_items` (items with windows that occur),
    `items_sha256` (of their ids, sorted as strings and joined by commas) and
    `contaminated` (`n_hit` > 0 and `share` * `n_hit` >= `n_words`).

    A document that contains a window contains its rarest shingle, which alone is
    the prefix to join on. Rarity is the number of times that the documents use a
    shingle's rarest word. A match fixes where the window would start; it must lie
    inside the document, and its words are then compared one by one.

    Null texts have no words: such documents are not hit, and such items have no
    windows. Items without an id take part, but are not named or counted. Repeated items count once.
    Repeated documents each get their own row. Empty tables are allowed on either
    side. Other columns are not looked at.
    """
    words = contract_words(F.col(text_col))
    items = saved(
        benchmark.select(
            F.col(item_col).cast("string").alias("item"),
            contract_words(F.col(item_text_col)).alias("words"),
        ).distinct(),
        "decontam-items",
    )
    worded = docs.select(row_key(id_col, F.col(text_col)).alias("key"), words.alias("words"))

    # Rarity of the words that items use.
    used = items.select(F.explode("words").alias("word")).distinct()
    used = F.broadcast(used) if _is_small(used) else used
    counts = (
        docs.select(F.explode(words).alias("word"))
        .join(used, "word", "left_semi")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("uses"))
    )
    windows = _windows(items, window).groupBy("words").agg(F.collect_set("item").alias("items"))
    window_shingles = windows.select(
        "words",
        "items",
        F.posexplode(
            F.when(F.size("words") < SHINGLE, F.array(F.col("words"))).otherwise(
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("words") - SHINGLE + 1, F.lit(1))),
                    lambda i: F.slice("words", i, F.lit(SHINGLE)),
                )
            )
        ).alias("offset", "shingle"),
    )
    rarity = (
        window_shingles.select("shingle").distinct()
        .select("shingle", F.explode("shingle").alias("word"))
        .join(counts, "word", "left")
        .groupBy("shingle")
        .agg(F.min(F.coalesce("uses", F.lit(0))).alias("uses"))
    )
    prefixes = saved(
        window_shingles.join(rarity, "shingle")
        .groupBy("words", "items")
        .agg(F.min(F.struct("uses", "shingle", "offset")).alias("rarest"))
        .select(
            F.col("words").alias("window"),
            "items",
            F.col("rarest.offset").alias("offset"),
            F.size("rarest.shingle").alias("length"),
            F.expr(
                "CASE size(rarest.shingle) "
                + " ".join(
                    f"WHEN {n} THEN xxhash64({', '.join(f'rarest.shingle[{j}]' for j in range(n))})"
                    for n in range(1, SHINGLE + 1)
                )
                + " END"
            ).alias("hash"),
        ),
        "decontam-prefixes",
    )
    lengths = [row[0] for row in prefixes.select("length").distinct().collect()]
    hits = None
    for size in lengths:
        part = prefixes.filter(F.col("length") == size)
        shingled = _shingled(worded, size)
        if _is_small(part):
            placed = shingled.join(F.broadcast(part), "hash")
        else:
            # Too many prefixes to send around: only keys and places are shuffled, and
            # the few matches meet their words again.
            placed = shingled.drop("words").join(part, "hash").join(worded.distinct(), "key")
        start = F.col("at") - F.col("offset")
        inside = (start >= 0) & (start + F.size("window") <= F.size("words"))
        same = F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size("window")) == F.col("window")
        found = placed.filter(inside & same).select(
            "key", start.alias("start"), F.size("window").alias("size"), "items"
        )
        hits = found if hits is None else hits.unionByName(found)
    base = docs.select(
        row_key(id_col, F.col(text_col)).alias("key"),
        _word_count(F.col(text_col)).cast("bigint").alias("n_words"),
    )
    if hits is None:
        measured = base.withColumns(
            {"n_hit": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>")}
        )
    else:
        hits = saved(hits, "decontam-hits")
        upto = Window.partitionBy("key").orderBy("start", "size").rowsBetween(
            Window.unboundedPreceding, -1
        )
        end = F.col("start") + F.col("size")
        covered = (
            hits.select("key", "start", "size").distinct()
            .withColumn("reached", F.coalesce(F.max(end).over(upto), F.lit(0)))
            .groupBy("key")
            .agg(
                F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0)))
                .cast("bigint")
                .alias("n_hit")
            )
        )
        named = (
            hits.select("key", F.explode("items").alias("item")).distinct()
            .groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
        )
        measured = base.join(covered, "key", "left").join(named, "key", "left").select(
            "key",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    return measured.select(
        "key",
        F.col("key.id").alias(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def without_benchmark(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """`docs` without the contaminated ones."""
    found = contamination(docs, benchmark, id_col, text_col).filter("contaminated")
    return without_rows(docs, found, id_col, text_col)
