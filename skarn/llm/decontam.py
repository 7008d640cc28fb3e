"""Benchmark decontamination by templates, in DataFrame functions alone.

A text is split into words at white space, and every word is typed by itself: one with a digit is a number, a known
unit right after a number is a unit, one whose first letter is a capital is a name, wherever it stands. The typed form
of a text has a placeholder for each of these and the lower-case form of every other word; the literal form has the
lower-case form of all words, so that a copy is found whatever its case and white space. Windows of eight words of the
documents are joined by hash to those of the benchmark items, in both forms at once: each text is split and typed
once, and the windows of all widths are made from that.

A typed window needs as many literal words as placeholders. One with fewer is widened to sixteen words; if that
doesn't help, or the item is too short, the place is looked for in its literal form alone, so that an exact copy is found and other
numbers in the same row of numbers aren't taken for it.

Slot consistency: where both sides have a placeholder, the words it stands for must map one way along an alignment of
item and document: an item's word always meets the same word of the document, and two names of the item never meet one
name. An item is leaked into a document if literal windows and consistent alignments cover at least half of its
windows.

Defined cases: null and empty texts have no windows; items of fewer than eight words are one window of all their words,
looked for at that width; null ids are ids like others; documents alike in doc_id and text, and items alike in id and
text, count once; a word that begins with U+0001 counts as a placeholder; empty tables give no rows; other columns of
the inputs are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

WIDTH, COVERAGE, WIDENED = 8, 0.5, 2
#: Item windows up to which they are broadcast (some 100 bytes each); beyond it the join shuffles.
BROADCAST_WINDOWS = 1_000_000
NUMBER, UNIT, NAME = "\u0001n", "\u0001u", "\u0001x"
#: Units of measure.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms t ton tons tonne tonnes oz ounce ounces lb lbs pound pounds "
    "ml cl dl l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hrs hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw kwh v volt volts a amp amps ohm ohms j joule joules kj cal kcal n newton newtons pa kpa bar atm mol k kelvin "
    "mph kph km/h m/s percent % degree degrees celsius fahrenheit dollar dollars cent cents euro euros $ € £ usd eur gbp"
).split()
_GAP = r"[\x20\x09-\x0D]+"
_CAPITAL = r"^[^\p{L}]*+\p{Lu}"
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def with_forms(df: DataFrame, text: str) -> DataFrame:
    """df with the columns raw, literal and typed: the words of text in each form, at the same places."""
    df = df.withColumn("raw", words(F.col(text))).withColumn("literal", F.transform("raw", F.lower))
    kind = lambda x, low: F.when(x.rlike("[0-9]"), NUMBER).when(x == low, low).when(x.rlike(_CAPITAL), NAME).otherwise(low)
    df = df.withColumn("typed", F.zip_with("raw", "literal", kind))
    is_unit = lambda i: (F.get("typed", i - 1) == NUMBER) & F.rtrim(F.get("literal", i), F.lit(".,;:!?)")).isin(UNITS)
    return df.withColumn("typed", F.transform("typed", lambda x, i: F.when(is_unit(i), UNIT).otherwise(x)))


def _is_slot(word: Column) -> Column:
    return word.startswith("\u0001")


def with_windows(df: DataFrame, form: str, spans: Iterable[int]) -> DataFrame:
    """df with <form>_k for each k of spans: the hashes of k words from each place on, made by joining those of half as many.

    The last k - 1 are of fewer words and mean nothing. Each is a column of its own, so that it is made once for a text.
    """
    wanted, todo = set(), list(spans)
    while todo:
        if (k := todo.pop()) not in wanted:
            wanted.add(k)
            todo += [] if k == 1 else [k // 2] if k % 2 == 0 else [k - 1, 1]
    for k in sorted(wanted):
        left, right = (k // 2, k // 2) if k % 2 == 0 else (k - 1, 1)
        ahead = lambda n, by: F.slice(f"{form}_{n}", F.lit(by + 1), F.size(form))
        df = df.withColumn(f"{form}_{k}", F.transform(form, lambda x: F.xxhash64(x)) if k == 1 else F.zip_with(f"{form}_{left}", ahead(right, left), lambda x, y: F.xxhash64(x, y)))
    return df


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, item_hash, windows (of the item), span (words in each), at (first word, from 0), covers (places of the item that a hit covers), slots, window.

    A place is a window of width words, or of all words of a shorter item. Each has a literal row (slots 0) and, if it has
    placeholders and literal words enough, a typed row at its own or the widened span.
    """
    items = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), "text").dropDuplicates(["item_id", "item_hash"])
    items = with_forms(items, "text").withColumn("n", F.size("raw")).where("n > 0").withColumn("span", F.least("n", F.lit(width)))
    items = items.withColumn("windows", F.col("n") - F.col("span") + 1)
    wide, spans = width * WIDENED, range(1, width + 1)
    items = with_windows(with_windows(items, "literal", spans), "typed", [*spans, wide])
    places = items.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
    at_span = lambda form: F.coalesce(*(F.when(F.col("span") == k, F.get(f"{form}_{k}", F.col("place"))) for k in spans))
    slots = lambda at, span: F.size(F.filter(F.slice("typed", at + 1, span), _is_slot))
    places = places.withColumns({"s": slots(F.col("place"), F.col("span")), "wide_at": F.least(F.col("place"), F.col("n") - wide)})
    places = places.withColumn("wide_s", F.when(F.col("n") >= wide, slots(F.col("wide_at"), F.lit(wide))))
    key = ["item_id", "item_hash", "windows", F.col("place").alias("covers")]
    literal = places.select(*key, "span", F.col("place").alias("at"), F.lit(0).alias("slots"), at_span("literal").alias("window"))
    light = places.where((F.col("s") > 0) & (2 * F.col("s") <= F.col("span"))).select(*key, "span", F.col("place").alias("at"), F.col("s").alias("slots"), at_span("typed").alias("window"))
    wider = places.where((2 * F.col("s") > F.col("span")) & (2 * F.col("wide_s") <= wide)).select(*key, F.lit(wide).alias("span"), F.col("wide_at").alias("at"), F.col("wide_s").alias("slots"), F.get(f"typed_{wide}", F.col("wide_at")).alias("window"))
    return literal.unionByName(light).unionByName(wider)


def _covered(found: DataFrame, coverage: float) -> DataFrame:
    """The pairs of document and item whose hits cover enough of the item's windows, with matched and windows of these."""
    pair = ["doc_id", "text_hash", "item_id", "item_hash"]
    n = found.select(*pair, "covers", "windows").distinct().groupBy(*pair, "windows").agg(F.count("*").alias("matched"))
    return n.where(F.col("matched") >= coverage * F.col("windows"))


def leaks(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, matched, windows: a row for each document and item that is leaked into it.

    matched: how many of the item's windows literal windows and consistent alignments cover; windows: how many there are.
    """
    items = store.cut(item_windows(benchmark, width), "item-windows")
    kinds = items.select("span", (F.col("slots") > 0).alias("typed")).distinct().collect()  # at most two for each width
    spans = {form: sorted(r.span for r in kinds if r.typed == typed) for form, typed in (("literal", False), ("typed", True))}
    if not kinds:
        return documents.select("doc_id", F.xxhash64("text").alias("text_hash")).join(items.select("item_id", F.lit(0).cast("long").alias("matched"), "windows"), F.lit(False))
    known = items.select("item_id", "item_hash", "windows", "at", "covers", "slots", "span", F.col("window").alias("_window"))
    if items.count() <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    docs = with_forms(documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").alias("_text")), "_text").drop("_text")
    for form, of in spans.items():
        docs = with_windows(docs, form, of)
    whole = lambda form, k: F.slice(f"{form}_{k}", F.lit(1), F.greatest(F.size(form) - (k - 1), F.lit(0)))
    lists = F.array(*(whole(form, k) for form, of in spans.items() for k in of))
    rows = docs.select("doc_id", "text_hash", F.explode(lists).alias("windows")).select("doc_id", "text_hash", F.posexplode("windows").alias("place", "window"))
    found = rows.join(known, F.col("window") == F.col("_window"))  # windows of other widths or forms have other hashes
    found = found.withColumn("shift", F.col("place") - F.col("at")).withColumn("form", (F.col("slots") > 0).cast("int"))
    keys = ["doc_id", "text_hash", "item_id", "item_hash", "form", "shift"]
    found = store.cut(found.select(*keys, "at", "covers", "windows", "slots", "span").dropDuplicates([*keys, "covers"]), "window-hits")
    pair = ["doc_id", "text_hash", "item_id", "item_hash"]
    enough = store.cut(_covered(found, coverage).select(*(F.col(c).alias(f"_{c}") for c in pair)), "covered")
    found = found.join(enough, _same(pair), "left_semi")
    wrong = _inconsistent(documents, benchmark, found.where("slots > 0"))
    sound = found.join(wrong.select(*(F.col(c).alias(f"_{c}") for c in keys)), _same(keys), "left_anti")
    return _covered(sound, coverage).select("doc_id", "text_hash", "item_id", "matched", "windows")


def _same(names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def _inconsistent(documents: DataFrame, benchmark: DataFrame, hits: DataFrame) -> DataFrame:
    """The alignments (document, item, form, shift) on which one word of the item meets two of the document, or two names of the item one."""
    keys = ["doc_id", "text_hash", "item_id", "item_hash", "form", "shift"]
    aligned = hits.select(*keys, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("span") - 1)).alias("i")).distinct()
    docs = documents.select(F.col("doc_id").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"), words(F.col("text")).alias("doc_words"))
    wanted = store.cut(hits.select("doc_id", "text_hash").distinct(), "slotted")
    docs = docs.join(wanted, _same(["doc_id", "text_hash"]), "left_semi").dropDuplicates(["_doc_id", "_text_hash"])
    items = with_forms(benchmark.select(F.col("item_id").alias("_item_id"), F.xxhash64("text").alias("_item_hash"), F.col("text").alias("_text")).dropDuplicates(["_item_id", "_item_hash"]), "_text")
    kind = F.get("typed", F.col("i"))
    both = aligned.join(items, _same(["item_id", "item_hash"])).where(_is_slot(kind))
    both = both.select(*keys, "i", (kind == NAME).alias("name"), F.get("raw", F.col("i")).alias("ours")).join(docs, _same(["doc_id", "text_hash"]))
    bare = lambda c: F.lower(F.regexp_replace(c, _EDGE, ""))
    both = both.select(*keys, "name", bare(F.col("ours")).alias("ours"), bare(F.get("doc_words", F.col("i") + F.col("shift"))).alias("theirs"))
    two = lambda df, one, other: df.groupBy(*keys, one).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a != b").select(*keys)
    return two(both, "ours", "theirs").unionByName(two(both.where("name"), "theirs", "ours")).distinct()


def clean(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of documents into which no item is leaked."""
    p = store.prefix(documents)
    bad = store.cut(leaks(documents, benchmark, **how).select(F.col("doc_id").alias(f"{p}_doc"), F.col("text_hash").alias(f"{p}_hash")).distinct(), "leaked")
    return documents.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col(f"{p}_doc")) & (F.xxhash64("text") == F.col(f"{p}_hash")), "left_anti")
