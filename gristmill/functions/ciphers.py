"""Letter ciphers (F8-F11) and substitution maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.text import bound

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The words that plain texts are made of.
VOCABULARY = (
    "above", "alice", "ancient", "around", "beyond", "bird", "book", "bright", "castle", "cat", "cave", "chases", "clever",
    "colorful", "creates", "crystal", "curious", "dark", "discovers", "door", "dragon", "draws", "dreams", "explores",
    "follows", "forest", "found", "garden", "golden", "hatter", "hidden", "imagines", "in", "inside", "island", "key", "king",
    "knight", "library", "magical", "map", "message", "mirror", "mountain", "mouse", "mysterious", "near", "ocean", "palace",
    "potion", "princess", "puzzle", "queen", "rabbit", "reads", "school", "secret", "sees", "silver", "story", "strange",
    "student", "studies", "teacher", "the", "through", "tower", "treasure", "turtle", "under", "valley", "village", "watches",
    "wise", "wizard", "wonderland", "writes",
)


def caesar(s: Column, k: int) -> Column:
    k %= 26
    return F.translate(s, _UPPER + _LOWER, _UPPER[k:] + _UPPER[:k] + _LOWER[k:] + _LOWER[:k])


def atbash(s: Column) -> Column:
    return F.translate(s, _UPPER + _LOWER, _UPPER[::-1] + _LOWER[::-1])


def reverse_words(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, " "), F.reverse), " ")


def swap_pairs(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)(.)(.)", "$2$1")


def aligned(pairs: Column) -> Column:
    """(c, p): cipher and plain letters at equal places, of words at equal places, as array<struct<c,p>>.

    pairs is array<struct<inp,out>>; pairs with unequal numbers of words and words of unequal length count for nothing.
    """

    def letters(a: Column, b: Column) -> Column:
        return F.when(F.length(a) == F.length(b), F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("c"), y.alias("p")))).otherwise(F.array().cast("array<struct<c:string,p:string>>"))

    def words(x: Column) -> Column:
        a, b = F.split(x["inp"], " +"), F.split(x["out"], " +")
        return F.when(F.size(a) == F.size(b), F.flatten(F.zip_with(a, b, letters))).otherwise(F.array().cast("array<struct<c:string,p:string>>"))

    return F.filter(F.flatten(F.transform(pairs, words)), lambda x: x["c"] != "")


def char_map(pairs: Column, injective: bool = True) -> Column:
    """Map from cipher to plain letter: the first one seen stays and, if injective, no plain letter is given twice."""
    start = F.struct(F.array().cast("array<string>").alias("c"), F.array().cast("array<string>").alias("p"))

    def step(a: Column, x: Column) -> Column:
        new = ~F.array_contains(a["c"], x["c"])
        if injective:
            new = new & ~F.array_contains(a["p"], x["p"])
        return F.struct(F.when(new, F.array_append(a["c"], x["c"])).otherwise(a["c"]).alias("c"), F.when(new, F.array_append(a["p"], x["p"])).otherwise(a["p"]).alias("p"))

    return F.aggregate(aligned(pairs), start, step, lambda a: F.map_from_arrays(a["c"], a["p"]))


def apply_map(s: Column, m: Column) -> Column:
    """Letters by the map, '?' for unknown ones; spaces stay."""
    return F.array_join(F.transform(F.split(s, ""), lambda c: F.when((c == " ") | (c == ""), c).otherwise(F.coalesce(F.try_element_at(m, c), F.lit("?")))), "")


def _pattern(word: str) -> str:
    """Each letter by the place, from 1, where the word has it first: words that a substitution can turn into each other have one pattern."""
    return ".".join(str(word.index(c) + 1) for c in word)


def _by_pattern() -> Column:
    """The vocabulary by pattern, as map<string, array<string>>; words in alphabetical order."""
    held: dict[str, list[str]] = {}
    for w in sorted(VOCABULARY):
        held.setdefault(_pattern(w), []).append(w)
    return F.create_map(*[x for k, ws in held.items() for x in (F.lit(k), F.array(*map(F.lit, ws)))])


def candidates(word: Column, known: Column) -> Column:
    """Vocabulary words that a cipher word may stand for and that agree with the map, both ways, in alphabetical order.

    Only words of the cipher word's pattern are looked at; they are of its length, and letters that are equal in one are
    equal in the other. known is struct<c:array<string>,p:array<string>>, letters known so far.
    """
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    pattern = F.array_join(F.transform(letters, lambda c: F.array_position(letters, c).cast("string")), ".")

    def agrees(q: Column) -> Column:
        return F.array_position(known["c"], q["c"]) == F.array_position(known["p"], q["p"])

    def fits(v: Column) -> Column:
        return F.forall(F.zip_with(letters, F.split(v, ""), lambda x, y: F.struct(x.alias("c"), y.alias("p"))), agrees)

    return F.filter(F.coalesce(F.try_element_at(_by_pattern(), pattern), F.array().cast("array<string>")), fits)


def fill(query: Column, pairs: Column) -> Column:
    """struct<text, solved, by_map>: the query's words left to right by map and vocabulary; each word found constrains the next.

    A word whose letters are all known is read by the map, whether or not it is in the vocabulary. Of the others, one with
    one candidate is solved, one with several takes the first and leaves the text unsolved, and one with none leaves it
    unsolved too and shows what the map knows. by_map says that no word needed the vocabulary.
    """
    m = char_map(pairs)
    start = F.struct(F.map_keys(m).alias("c"), F.map_values(m).alias("p"), F.array().cast("array<string>").alias("words"), F.lit(True).alias("solved"), F.lit(True).alias("by_map"))

    def read(a: Column, w: Column) -> Column:
        return F.array_join(F.transform(F.split(w, ""), lambda x: F.when(x == "", x).otherwise(F.coalesce(F.get(a["p"], (F.array_position(a["c"], x) - 1).cast("int")), F.lit("?")))), "")

    def chosen(a: Column, w: Column) -> Column:
        known = F.forall(F.split(w, ""), lambda x: F.array_contains(a["c"], x))
        fits = F.when(known, F.array(read(a, w))).otherwise(candidates(w, F.struct(a["c"].alias("c"), a["p"].alias("p"))))
        return bound(F.struct(fits.alias("fits"), known.alias("known")), lambda x: F.struct(F.size(x["fits"]).alias("n"), F.get(x["fits"], F.lit(0)).alias("v"), x["known"].alias("known")))

    def grown(a: Column, w: Column, x: Column) -> Column:
        new = F.filter(F.array_distinct(F.zip_with(F.split(w, ""), F.split(x["v"], ""), lambda c, p: F.struct(c.alias("c"), p.alias("p")))), lambda q: (q["c"] != "") & ~F.array_contains(a["c"], q["c"]))
        has = x["n"] > 0
        return F.struct(
            F.when(has, F.concat(a["c"], F.transform(new, lambda q: q["c"]))).otherwise(a["c"]).alias("c"),
            F.when(has, F.concat(a["p"], F.transform(new, lambda q: q["p"]))).otherwise(a["p"]).alias("p"),
            F.array_append(a["words"], F.when(has, x["v"]).otherwise(read(a, w))).alias("words"),
            (a["solved"] & (x["n"] == 1)).alias("solved"),
            (a["by_map"] & x["known"]).alias("by_map"),
        )

    def step(a: Column, w: Column) -> Column:
        return bound(chosen(a, w), lambda x: grown(a, w, x))

    return F.aggregate(F.filter(F.split(query, " +"), lambda w: w != ""), start, step, lambda a: F.struct(F.array_join(a["words"], " ").alias("text"), a["solved"].alias("solved"), a["by_map"].alias("by_map")))
