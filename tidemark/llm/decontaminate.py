"""Benchmark decontamination by template windows, in DataFrame functions only.

Texts become sequences of lower-case tokens in which names, numbers and units are typed
placeholders. Windows of tokens are hash-joined with the benchmark's windows, so a question
whose numbers or names were changed still matches. For matches that go through placeholders
the values are compared: benchmark values and document values must stand for one another, one
to one, wherever the two texts run in parallel.

A window with few ordinary words says little once its values are gone, so such windows are not
joined; an item that mostly consists of them is joined by its literal tokens instead. A window
that an item repeats stands where the item has it first: each place of a document meets an
item's window once, however often either repeats it.

Windows that many items share, such as a common preamble, bring no document to an item: for
each item the commonest windows are set aside as long as all of them together cover too little
of it, so whatever covers enough has one of the others. Documents meet items by these others
alone, and only the pairs that result are compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACES, bind, materialise

WINDOW = 8
#: A document is contaminated by an item when its matching windows cover this share of the item's tokens.
MIN_COVERED = 0.5
#: Windows with fewer tokens that are no placeholders are not evidence.
MIN_ORDINARY = 3
#: An item of fewer tokens matches only a document that is nothing else.
MIN_ITEM = 4
#: The benchmark's rare windows, and the documents that they bring, are broadcast up to this many (about 10 MB), else shuffled.
BROADCAST_WINDOWS = 200_000

# Marks of the placeholders, what they replace, and what is dropped from tokens.
# Repeated groups are possessive: Java tries them in a loop then, else by a call within a call for
# each repetition, which ends a task's stack at one or two thousand. Nothing follows them, so they match the same.
MARK = "\u0002"
NAME = r"([\p{Ll}\p{N},;] +)(\p{Lu}[\p{L}'’-]*(?: +\p{Lu}[\p{L}'’-]*)*+)"
NUMBER = r"\p{N}+(?:[.,:/]\p{N}+)*+"
UNIT = rf"{MARK}d ?(%|°[CF]|(?:km|cm|mm|kg|mg|ml|mph|kmh|ft|lb|oz|usd|eur|gbp|percent|dollars?|euros?|pounds?|cents?|met(?:er|re)s?|miles?|feet|inch(?:es)?|gram(?:me)?s?|lit(?:er|re)s?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|degrees?|m|g|l|s|h)\b)"
PUNCTUATION = ".,;:!?\"()[]{}«»“”„…—–*#$%&|<>/\\_~^`+=@"


def _named(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES + MARK, " " * len(SPACES))
    return F.regexp_replace(spaced, NAME, f"$1{MARK}n")


def _numbered(named: Column) -> Column:
    counted = F.regexp_replace(F.regexp_replace(named, NUMBER, f" {MARK}d"), UNIT, f"{MARK}d {MARK}u")
    return F.when(named.rlike(r"\p{N}"), counted).otherwise(named)


def template(text: Column) -> Column:
    """array<string> of a text's template tokens; empty for null, blank or bare punctuation."""
    plain = bind(_named(text), lambda named: F.translate(F.lower(_numbered(named)), PUNCTUATION, ""))
    return F.filter(F.split(plain, " +"), lambda x: x != "")


def slot_values(text: Column) -> Column:
    """struct of the values that the placeholders n, d and u of template() stand for, in order."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES + MARK, " " * len(SPACES))
    named = _named(text)
    counted = F.regexp_replace(named, NUMBER, f" {MARK}d")
    return F.struct(
        F.regexp_extract_all(spaced, F.lit(NAME), F.lit(2)).alias("n"),
        F.regexp_extract_all(named, F.lit(NUMBER), F.lit(0)).alias("d"),
        F.regexp_extract_all(counted, F.lit(UNIT), F.lit(1)).alias("u"),
    )


def _slotted(token: Column) -> Column:
    """Whether a token has a placeholder: it starts with one, which a rest of the word may follow ('3rd', '5-year')."""
    return F.substring(token, 1, 2).isin(*[MARK + x for x in "ndu"])


def _windows(tokens: Column, n: int) -> Column:
    hashed = F.transform(tokens, lambda t: F.xxhash64(t))
    return bind(hashed, lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))))


def _literal(text: Column) -> Column:
    """array<string> of a text's lower-case tokens as they are."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES + MARK, " " * len(SPACES))
    return F.filter(F.split(F.translate(F.lower(spaced), PUNCTUATION, ""), " +"), lambda x: x != "")


def _covered(starts: Column, n: int | Column) -> Column:
    """How many positions windows of ``n`` cover that start at the distinct ``starts``."""
    return bind(F.array_sort(starts), lambda t: F.aggregate(
        F.transform(t, lambda x, j: F.least(F.coalesce(F.get(t, j + 1) - x, F.lit(1 << 30)), F.lit(n) if isinstance(n, int) else n)), F.lit(0), lambda a, x: a + x,
    ))


def _slots(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, value) of each placeholder of rows' texts, by token position from 0."""
    at = rows.select(*keys, slot_values(F.col("text")).alias("v"), F.posexplode(template(F.col("text"))).alias("pos", "token"))
    nth = W.partitionBy(*keys, "mark").orderBy("pos")
    at = at.filter(_slotted(F.col("token"))).withColumn("mark", F.substring("token", 1, 2)).withColumn("k", F.row_number().over(nth) - 1)
    value = F.coalesce(*[F.when(F.col("mark") == MARK + x, F.get(f"v.{x}", F.col("k"))) for x in "ndu"], F.lit(""))
    return at.select(*keys, "pos", F.lower(value).alias("value"))


def _known(items: DataFrame, window: int, min_covered: float) -> DataFrame:
    """(item_id, item_words, literal, n, h, ipos, starts, slotted, rare): an item's windows of n tokens, each once.

    ipos is where the item has it first and starts are all its places; n is 0 for an item that
    only matches as a whole document.
    """
    sized = items.withColumn("tokens", template(F.col("text"))).filter(F.size("tokens") > 0)
    sized = sized.withColumn("n", F.when(F.size("tokens") < MIN_ITEM, 0).otherwise(F.least(F.size("tokens"), F.lit(window))))
    starts = F.sequence(F.lit(0), F.size("tokens") - F.col("n"))
    plain = lambda i: F.size(F.filter(F.slice("tokens", i + 1, F.col("n")), lambda t: ~_slotted(t)))
    sized = sized.withColumn("telling", F.when(F.col("n") > 0, F.filter(starts, lambda i: plain(i) >= MIN_ORDINARY)).otherwise(F.array().cast("array<int>")))
    sized = sized.withColumn("literal", _covered(F.col("telling"), F.col("n")) < min_covered * F.size("tokens"))
    sized = sized.withColumn("tokens", F.when(F.col("literal"), _literal(F.col("text"))).otherwise(F.col("tokens"))).filter(F.size("tokens") > 0)
    sized = sized.withColumn("n", F.when(F.col("n") > 0, F.least("n", F.size("tokens"))).otherwise(0))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.xxhash64(F.transform("tokens", lambda t: F.xxhash64(t))).alias("h")))
    places = F.when(F.col("n") == 0, whole).otherwise(bind(F.transform("tokens", lambda t: F.xxhash64(t)), lambda g: F.transform(
        F.when(F.col("literal"), starts).otherwise(F.col("telling")), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice(g, i + 1, F.col("n"))).alias("h")))))
    rows = sized.select("item_id", F.size("tokens").alias("item_words"), "literal", "n", "tokens", F.explode(places).alias("p"))
    rows = rows.select("item_id", "item_words", "literal", "n", "p.i", "p.h", (~F.col("literal") & (F.size(F.filter(F.slice("tokens", F.col("p.i") + 1, F.greatest("n", F.lit(1))), _slotted)) > 0)).alias("slotted"))
    once = rows.groupBy("item_id", "item_words", "literal", "n", "h").agg(F.min("i").alias("ipos"), F.collect_set("i").alias("starts"), F.max("slotted").alias("slotted"))
    return _telling(materialise(once), min_covered)


def _telling(known: DataFrame, min_covered: float) -> DataFrame:
    """``known`` with rare: whether a window brings documents to its item.

    Windows of at least 2^k items are not rare for the least k at which all such windows of the
    item cover less than it takes to match.
    """
    window = ["literal", "n", "h"]
    counted = known.join(known.groupBy(*window).agg(F.count(F.lit(1)).alias("items")), window)
    shared = lambda k: F.flatten(F.transform(F.filter("w", lambda x: x["items"] >= F.call_function("shiftleft", F.lit(1).cast("long"), k)), lambda x: x["starts"]))
    per_item = counted.groupBy("item_id", "item_words", "n").agg(F.collect_list(F.struct("items", "starts")).alias("w"))  # an item's own windows
    per_item = per_item.withColumn("top", F.expr("CAST(ceil(log2(array_max(w.items) + 1)) AS INT)"))
    enough = F.col("item_words") * min_covered
    least = F.filter(F.sequence(F.lit(0), F.col("top")), lambda k: _covered(shared(k), F.col("n")) < enough)
    levels = per_item.select("item_id", F.when(F.col("n") == 0, F.lit(62)).otherwise(F.get(least, F.lit(0))).alias("level"))
    return counted.join(levels, "item_id").withColumn("rare", F.col("items") < F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))).drop("items", "level")


def _seen(docs: DataFrame, kinds: list[tuple[bool, int]]) -> DataFrame:
    """(doc_id, th, kind, pos, h): the windows of each kind, by its number, of every document, of one tokenisation.

    The arrays are made within explode(): Spark tests a named one for being empty where the
    table is read, and so would make it twice, and for rows that a join is to drop.
    """
    texts = {literal: F.col("__literal" if literal else "__template") for literal, _ in kinds}
    tokens = docs.select("doc_id", "th", *[(_literal if literal else template)(F.col("text")).alias("__literal" if literal else "__template") for literal in texts])

    def windows(literal: bool, n: int) -> Column:
        if n:
            return F.coalesce(_windows(texts[literal], n), F.array().cast("array<bigint>"))
        return F.array(F.xxhash64(F.transform(texts[literal], lambda t: F.xxhash64(t))))

    if len(kinds) == 1:
        return tokens.select("doc_id", "th", F.lit(0).alias("kind"), F.posexplode(windows(*kinds[0])).alias("pos", "h"))
    placed = lambda k, kind: F.transform(windows(*kind), lambda h, i: F.struct(F.lit(k).alias("kind"), i.alias("pos"), h.alias("h")))
    return tokens.select("doc_id", "th", F.explode(F.concat(*[placed(*x) for x in enumerate(kinds)])).alias("p")).select("doc_id", "th", "p.*")


def _hits(docs: DataFrame, known: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, item_id, n, pos, ipos, slotted): the windows that documents share with the items that a rare window brought them to."""
    kinds = sorted(map(tuple, known.select("literal", "n").distinct().collect())) or [(False, window)]  # at most two a length up to the window
    kind = F.coalesce(*[F.when((F.col("literal") == literal) & (F.col("n") == n), F.lit(k)) for k, (literal, n) in enumerate(kinds)])
    known = known.withColumn("kind", kind)
    key = ["kind", "h"]
    rare = known.filter("rare").select(*key, "item_id")
    rare = F.broadcast(rare) if rare.count() <= BROADCAST_WINDOWS else rare
    brought = materialise(_seen(docs, kinds).join(rare, key).select("doc_id", "th", "item_id").distinct())
    asked = brought.join(known.select("item_id", *key, "n", "ipos", "slotted"), "item_id")
    ids = brought.select("doc_id", "th").distinct()
    ids = F.broadcast(ids) if brought.count() <= BROADCAST_WINDOWS else ids
    again = _seen(docs.join(ids, ["doc_id", "th"], "left_semi"), kinds)
    return materialise(again.join(asked, ["doc_id", "th", *key]).select("doc_id", "th", "item_id", "n", "pos", "ipos", "slotted"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, min_covered: float) -> DataFrame:
    """contaminated() for each (doc_id, hash of its text)."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text"))
    known = materialise(_known(items, window, min_covered))
    hits = _hits(docs, known, window)
    key = ["doc_id", "th", "item_id"]
    good = hits.filter("NOT slotted").select(*key, "ipos")
    values = None
    if not hits.filter("slotted").isEmpty():
        through = hits.filter("slotted").withColumn("diagonal", F.col("pos") - F.col("ipos")).distinct()
        pairs = materialise(_compare(docs, items, through))
        value = ["item_value", "doc_value"]
        count = pairs.groupBy(*key, "diagonal").agg(F.count_distinct(*value).alias("both"), F.count_distinct("item_value").alias("a"), F.count_distinct("doc_value").alias("b"))
        one_to_one = materialise(count.filter("both = a AND both = b").select(*key, "diagonal"))
        good = good.unionByName(through.join(one_to_one, [*key, "diagonal"], "left_semi").select(*key, "ipos"))
        values = pairs.join(one_to_one, [*key, "diagonal"], "left_semi").groupBy(*key).agg(F.count_distinct("item_value").alias("slots"), F.max(F.col("item_value") != F.col("doc_value")).alias("reparameterised"))
    places = good.distinct().join(known.select("item_id", "item_words", "n", "ipos", "starts"), ["item_id", "ipos"])
    out = places.groupBy(*key, "item_words").agg(F.max("n").alias("n"), F.flatten(F.collect_list("starts")).alias("starts"))
    out = out.withColumn("covered_words", F.least("item_words", F.when(F.col("n") == 0, F.col("item_words")).otherwise(_covered(F.col("starts"), F.col("n")))))
    out = out.filter(F.col("covered_words") >= min_covered * F.col("item_words")).select(*key, "item_words", "covered_words")
    if values is None:
        return out.select("*", F.lit(0).cast("long").alias("slots"), F.lit(False).alias("reparameterised"))
    return out.join(values, key, "left").select(*out.columns, F.coalesce("slots", F.lit(0)).cast("long").alias("slots"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_covered: float = MIN_COVERED) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, slots, reparameterised) of contaminated pairs.

    ``covered_words`` counts the item's tokens inside windows that the document has, ``slots``
    the distinct values of the item that were compared, and ``reparameterised`` says that one of
    them differs. Items shorter than a window match as a whole inside a document, those of
    under MIN_ITEM tokens only a document that is nothing else. A null or empty text, in either
    table, matches nothing; repeated rows count once; of rows with one doc_id and different
    texts the best counts, of those with one item_id the smallest text; a null doc_id or
    item_id is ignored. Only doc_id, item_id and text are read.
    """
    best = F.max(F.struct("covered_words", "slots", "reparameterised")).alias("best")
    return _found(docs, benchmark, window, min_covered).groupBy("doc_id", "item_id", "item_words").agg(best).select("doc_id", "item_id", "item_words", "best.*")


def _compare(docs: DataFrame, items: DataFrame, through: DataFrame) -> DataFrame:
    """(doc_id, th, item_id, diagonal, item_value, doc_value): the values that meet in hits through placeholders, once each.

    Only documents with such a hit are tokenised again.
    """
    ours = _slots(docs.join(through.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"]), ["doc_id", "th"])
    theirs = _slots(items.join(through.select("item_id").distinct(), "item_id", "left_semi"), ["item_id"])
    at = through.select("doc_id", "th", "item_id", "diagonal", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + F.col("n") - 1)).alias("ipos")).distinct()
    both = (
        at.join(theirs.withColumnsRenamed({"pos": "ipos", "value": "item_value"}), ["item_id", "ipos"]).withColumn("pos", F.col("ipos") + F.col("diagonal"))
        .join(ours.withColumnRenamed("value", "doc_value"), ["doc_id", "th", "pos"])
    )
    return both.select("doc_id", "th", "item_id", "diagonal", "item_value", "doc_value").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_covered: float = MIN_COVERED) -> DataFrame:
    """``docs`` without the contaminated documents; rows with a null doc_id or text stay."""
    bad = _found(docs, benchmark, window, min_covered).select(F.col("doc_id").alias("__id"), F.col("th").alias("__hash")).distinct()
    return docs.join(bad, (docs["doc_id"] == bad["__id"]) & (F.xxhash64(docs["text"]) == bad["__hash"]), "left_anti")


def _sql_tokens(table: str, key: str) -> str:
    """Tokens of a table by SQL: (key, pos, token)."""
    name, number = (x.replace("*+", "*").replace("'", "''") for x in (NAME, NUMBER))  # DuckDB has no possessive groups and needs none
    spaced = f"regexp_replace(replace(text, '{MARK}', ''), '[\\x09-\\x0D]', ' ', 'g')"
    named = f"regexp_replace({spaced}, '{name}', '\\1{MARK}n', 'g')"
    counted = f"regexp_replace(regexp_replace({named}, '{number}', ' {MARK}d', 'g'), '{UNIT}', '{MARK}d {MARK}u', 'g')"
    plain = f"translate(lower({counted}), '{PUNCTUATION}', '')"
    return f"SELECT DISTINCT {key}, list_filter(string_split_regex({plain}, ' +'), lambda x: x <> '') AS l FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL"


def _sql_windows(tokens: str, key: str) -> str:
    grams = " || ' ' || ".join(f"lead(token, {k}) OVER (PARTITION BY {key} ORDER BY pos)" for k in range(WINDOW))
    return f"SELECT {key}, pos, {grams} AS gram FROM (SELECT {key}, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM {tokens})"


#: DuckDB SQL for the rows of op9 where no match goes through a placeholder and no item is shorter than a window, as in the given tables.
SQL = rf"""
WITH dt AS ({_sql_tokens("documents", "doc_id")}), bt AS ({_sql_tokens("benchmark", "item_id")}),
dw AS ({_sql_windows("dt", "doc_id")}), bw AS ({_sql_windows("bt", "item_id")}),
hits AS (SELECT DISTINCT doc_id, item_id, bw.pos FROM dw JOIN bw USING (gram)),
covered AS (SELECT doc_id, item_id, count(DISTINCT p)::INT AS covered_words FROM (SELECT doc_id, item_id, unnest(range(pos, pos + {WINDOW})) AS p FROM hits) GROUP BY ALL)
SELECT doc_id, item_id, len(l)::INT AS item_words, covered_words, 0::BIGINT AS slots, false AS reparameterised
FROM covered JOIN bt USING (item_id) WHERE covered_words >= {MIN_COVERED} * len(l)
"""
