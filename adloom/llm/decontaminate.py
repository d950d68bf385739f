"""Benchmark decontamination by templates.

Texts are canonicalised word by word: numbers, units (after a number) and names (capitalised inside a sentence) become typed
placeholders; everything else is lower-cased and freed of punctuation. A capitalised word that opens a sentence, other than
common openers, may be a name or not: a second template has it as a placeholder, and windows of either may meet. Windows of five template words of the benchmark
items are joined by hash to those of the documents (a bit table of fixed size lets almost only true windows leave a
document's row), checked word by word, and gathered per document, item and diagonal. Every diagonal is tried as the begin of an
occurrence, which further ones join that begin within three times the item's length (and 96 words) after it. A document holds an
item if any occurrence covers at least 0.8 of the item's words and its slots agree: equal values of the item have equal
values in the document (different ones may have equal ones, as small numbers often do), so a re-parameterised question is caught.

Defined results: null and empty texts have no words; items of fewer than five words make one window of all of them and need a
whole match anywhere in a document; windows need at least two words that are no placeholders. Repeated rows, null ids and very long texts are
ordinary rows; ``decontaminate`` finds its rows by id and content. An empty table on either side finds nothing. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.functions.binding import let
from adloom.llm.common import bit_table, may_hit, need

WINDOW = 5
COVER = 0.8
STRETCH, SLACK = 3, 32
BITS = 1 << 20
UNITS = ("mm cm m km g mg kg t l ml s ms sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months "
         "year years meter meters metre metres mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents "
         "percent degree degrees liter liters litre litres gram grams kilogram kilograms kilometer kilometers watt watts volt volts").split()
# All patterns begin with a look at one character, where most places of a text fail at once.
# Possessive: a number with marks around takes one pass, however long it is.
NUMBER = r"(?![a-zA-Z ])(?<!\S)[^\p{L}\p{N}\s]*+[0-9][0-9.,:/]*+[^\p{L}\p{N}\s]*+(?!\S)"
UNIT = r"(?i)(?<=[ \t])(?<=[0-9][.,%]?[ \t])(?:" + "|".join(UNITS) + r")(?![\p{L}\p{N}])"
NAME = r"(?=\p{Lu})(?<=[\p{Ll}0-9,;][ \t])\p{Lu}[\p{Ll}'\-]+(?![\p{L}\p{N}])"
#: Words that open sentences and are never taken for names there.
OPENERS = ("a an the this that these those there here i he she it we you they his her its our your their my who whom whose which what when where "
           "why how if in on at by for from to of with without and but or nor so then thus hence as is are was were do does did can could will would "
           "shall should may might must has have had let each every all both some any no not one after before during while since until because").split()
#: The remaining capitalised words are marked: literal words in one template, names in the other.
MAYBE = r"(?=\p{Lu})(?<![\p{L}\p{N}\x01'\-])(?!(?i:" + "|".join(OPENERS) + r")(?![\p{L}\p{N}]))(\p{Lu}[\p{Ll}'\-]+)(?![\p{L}\p{N}])"

#: Words without any letter or digit, and other characters that are neither (\x01 marks placeholders).
BARE = r"(?![a-zA-Z ])(?<!\S)[^\p{L}\p{N}\s]++(?!\S)"
MARKS = r"(?![a-z ])[^\p{L}\p{N}\s\x01]+"
ASIDE = r"(?=\x01)(?<!\S)\x01q\S*"


def _split(text: Column) -> Column:
    """A blank alone is no pattern, so the text is cut without one."""
    return F.array_remove(F.split(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text), " "), "")


def templates(text: Column) -> Column:
    """Struct of strict, loose and plain words, aligned: words without any letter or digit are left out of all.

    Capitalised words that open a sentence may be names: ``strict`` has them as words, ``loose`` as placeholders.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), BARE, "")
    plain = lambda c: F.regexp_replace(F.lower(c), MARKS, "")
    marked = lambda c: plain(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, UNIT, "\x01u"), NUMBER, "\x01n"), NAME, "\x01p"), MAYBE, "\x01q$1"))
    strict, loose = (lambda m: F.replace(m, F.lit("\x01q"), F.lit(""))), (lambda m: F.replace(F.regexp_replace(m, ASIDE, "\x01p"), F.lit("\x01q"), F.lit("")))
    return let(bare, lambda c: let(marked(c), lambda m: F.struct(_split(strict(m)).alias("strict"), _split(loose(m)).alias("loose"), _split(plain(c)).alias("plain"))))


def _gram(words: str, n: int, start: Column | int = 0) -> Column:
    """Hash of the ``n`` words from ``start`` on; those beyond the end do not count."""
    return F.xxhash64(*[F.get(words, start + i) for i in range(n)])


def item_windows(items: DataFrame, w: int = WINDOW) -> DataFrame:
    """gram, item_id, t_pos, t_words, t_plain, n_item, loose: the windows of all items, as long as the item where it has fewer than ``w`` words.

    ``loose`` windows are those of the loose template that the strict one has not.
    """
    rows = need(items, "item_id", "text").select("item_id", F.explode(F.array(templates(F.col("text")))).alias("x")).select("item_id", "x.*")
    n, width = F.size("plain"), F.least(F.lit(w), F.size("plain"))
    spread = rows.filter(n > 0).select("item_id", "strict", "loose", "plain", n.alias("n_item"), width.alias("width"), F.explode(F.sequence(F.lit(0), n - width)).alias("t_pos"))
    cut = lambda c: F.slice(c, F.col("t_pos") + 1, F.col("width"))
    kinds = F.array(F.struct(cut("strict").alias("t_words"), F.lit(False).alias("loose")), F.struct(cut("loose").alias("t_words"), F.lit(True).alias("loose")))
    both = spread.select("item_id", "t_pos", "n_item", cut("plain").alias("t_plain"), F.explode(F.filter(kinds, lambda k: ~k["loose"] | (k["t_words"] != cut("strict")))).alias("k"))
    literal = F.size(F.filter("t_words", lambda x: ~x.startswith("\x01")))
    return (both.select("item_id", "t_pos", "n_item", "t_plain", "k.*").withColumn("gram", _gram("t_words", w))
            .filter(literal >= F.least(F.lit(2), F.size("t_words"))))


def _occurrences(pieces: DataFrame, w: int, min_cover: float) -> DataFrame:
    """Adds words, slots, first_word, last_word of each occurrence of an item that begins with a piece and passes.

    Pieces are (row, item, diagonal) with the item positions ``at`` of their windows. Every piece is tried as the first one of an
    occurrence; the others that begin within a stretch of STRETCH times the item's length (and SLACK words) after it join if
    they add windows and agree with the slots so far, the nearest diagonals first or the largest pieces first.
    """
    width = F.least(F.lit(w), F.col("n_item"))
    item = Window.partitionBy("row", "item_id", "n_item", "loose")
    # Ranges are whole numbers: places count in 1/1024 of the item's length with its slack.
    stretch = item.orderBy(F.floor(F.col("low").cast("long") * 1024 / (F.col("n_item") + SLACK))).rangeBetween(0, STRETCH * 1024)
    piece = F.struct("diagonal", "at", "pairs", "low", "high")
    enough = lambda over: F.sum(F.size("at")).over(over) * width >= min_cover * F.col("n_item")
    near = pieces.filter(F.size("at") > 0).withColumn("able", enough(item)).filter("able").withColumn("able", enough(stretch)).withColumn("parts", F.collect_list(piece).over(stretch)).filter("able")
    far = lambda x: F.abs(x["diagonal"] - F.col("diagonal"))
    kept = lambda x: F.struct(x["at"].alias("at"), x["pairs"].alias("pairs"), x["low"].alias("low"), x["high"].alias("high"))
    ordered = lambda key: F.array_sort(F.transform("parts", lambda x: F.struct(key(x).alias("key"), x["diagonal"].alias("tie"), kept(x).alias("x"))))

    def join(so_far, x):
        x = x["x"]
        pairs = F.array_distinct(F.concat(so_far["pairs"], x["pairs"]))
        both = F.struct(F.array_union(so_far["at"], x["at"]).alias("at"), pairs.alias("pairs"), F.least(so_far["low"], x["low"]).alias("low"), F.greatest(so_far["high"], x["high"]).alias("high"))
        return F.when((F.size(F.array_except(x["at"], so_far["at"])) > 0) & agree(pairs), both).otherwise(so_far)

    own = kept({c: F.col(c) for c in ("at", "pairs", "low", "high")})
    tries = [F.aggregate(ordered(key), own, join) for key in (far, lambda x: -F.size(x["at"]))]
    found = near.filter(agree(F.col("pairs"))).select("row", "doc_id", "text_key", "item_id", "n_item", F.explode(F.array(*tries)).alias("o"))
    covered = F.array_distinct(F.flatten(F.transform("o.at", lambda p: F.sequence(p, p + width - 1))))
    return found.select("row", "doc_id", "text_key", "item_id", "n_item", (F.size(covered) / F.col("n_item")).alias("cover"), F.size("o.pairs").alias("slots"),
                        F.col("o.low").alias("first_word"), (F.col("o.high") + width - 1).alias("last_word")).filter(F.col("cover") >= min_cover)


def agree(pairs: Column) -> Column:
    """Whether the slots' values agree: equal ones of the item, of one type, have equal ones in the document. Different ones may meet."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["kind"], p["t"])))) == F.size(pairs)


def contamination(docs: DataFrame, items: DataFrame, w: int = WINDOW, min_cover: float = COVER) -> DataFrame:
    """doc_id, item_id, cover, slots, first_word, last_word, text_key: one row per document and item that it holds, with its best occurrence."""
    windows = item_windows(items, w)
    table = bit_table(windows, "gram", BITS)
    # Of at most w values. Documents give windows of no other lengths.
    lengths = sorted(r[0] for r in windows.select(F.size("t_words")).distinct().collect())

    # A generator keeps its values from being computed again by all that uses them: the templates of a text, then the hashes of a
    # place's windows. The rows of the two inner ones stay inside one loop of compiled code, which almost none of them leaves.
    cut = need(docs, "doc_id", "text").select("doc_id", F.explode(F.array(F.struct(F.md5("text").alias("text_key"), templates(F.col("text")).alias("t")))).alias("x"))
    row = cut.select("doc_id", "x.text_key", F.monotonically_increasing_id().alias("row"), "x.t.strict", "x.t.loose", "x.t.plain")
    lengths = lengths or [w]
    grams = F.array(F.struct(*[_gram(c, n, F.col("pos")).alias(f"{c}_{n}") for n in lengths for c in ("strict", "loose")]))
    hashed = row.select("*", F.posexplode("strict")).drop("col").select("*", F.inline(grams))
    hit = {n: (F.col("pos") + n <= F.size("strict")) & (may_hit(table, F.col(f"strict_{n}"), BITS) | may_hit(table, F.col(f"loose_{n}"), BITS)) for n in lengths}
    window = lambda n: F.struct(F.slice("plain", F.col("pos") + 1, n).alias("own"), F.array_distinct(F.array(f"strict_{n}", f"loose_{n}")).alias("grams"))
    # The plan's text has the whole bit table wherever it is used, and the driver keeps that text: windows of one length are not looked up again.
    kept = F.array(window(lengths[0])) if len(lengths) == 1 else F.array_compact(F.array(*[F.when(hit[n], window(n)) for n in lengths]))
    held = hashed.filter(reduce(Column.__or__, hit.values())).select("doc_id", "text_key", "row", "pos", F.explode(kept).alias("h"))
    flat = held.select("doc_id", "text_key", "row", "pos", "h.own", F.explode("h.grams").alias("gram"))
    found = flat.join(windows, "gram")
    slot = lambda i: F.get("t_words", i).startswith("\x01")
    places = F.sequence(F.lit(0), F.size("t_words") - 1)
    same = (F.size("own") == F.size("t_words")) & F.forall(places, lambda i: slot(i) | (F.get("own", i) == F.get("t_words", i)))
    pairs = F.transform(F.filter(places, slot), lambda i: F.struct(F.get("t_words", i).alias("kind"), F.get("t_plain", i).alias("t"), F.get("own", i).alias("d")))
    # Judged twice: by the strict windows, and by all of them.
    checked = found.filter(same).select("row", "doc_id", "text_key", "item_id", "n_item", F.when(F.col("loose"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True))).alias("ways"), "pos", "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"), pairs.alias("pairs")).withColumn("loose", F.explode("ways"))
    # At most one window per item position on a diagonal, so the lists are as long as an item at most.
    pieces = checked.groupBy("row", "doc_id", "text_key", "item_id", "n_item", "loose", "diagonal").agg(
        F.collect_set("t_pos").alias("at"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    best = _occurrences(pieces, w, min_cover).groupBy("row", "doc_id", "text_key", "item_id", "n_item").agg(
        F.max(F.struct("cover", (-F.col("first_word")).alias("early"), (-F.col("last_word")).alias("short"), "slots")).alias("o"))
    return best.select("doc_id", "item_id", "o.cover", "o.slots", (-F.col("o.early")).alias("first_word"), (-F.col("o.short")).alias("last_word"), "text_key")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    bad = contamination(docs, items).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & F.md5(docs["text"]).eqNullSafe(bad["_key"]), "left_anti")
