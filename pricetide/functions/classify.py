"""Listing classifier: free text to type, set code, language, main set and packaging.

All rules are Column expressions built from the tables: a gate for what has no sealed product, then
families in order, the first that applies wins.  Tags only count when name and variant say nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.functions import tables as t
from pricetide.functions.columns import contains_any, first_case, found
from pricetide.functions.titles import with_titles

_PREFIXES = "|".join(t.SET_CODE_PREFIXES)
_GENERIC = rf"(?i)\b({_PREFIXES})[\s-]?0*(\d{{1,3}})\b"
#: Two codes of one prefix with a dash between: a range, which is no single product.
_RANGE = rf"(?i)\[?({_PREFIXES})[\s-]?\d{{1,3}}\]?\s*[-~]\s*\[?\1[\s-]?\d{{1,3}}\]?"
_SCHEMA = ("product_type", "set_code", "language", "main_set", "packaging")


def _family(prefix: str) -> str:
    return rf"(?i)\b{prefix}[\s-]?0*(\d{{1,3}})\b(?!-\d)"


def _code(prefix: str, digits: Column) -> Column:
    return F.when(digits.isNotNull(), F.format_string(f"{prefix}%02d", digits.cast("int")))


def normalized(c: Column) -> Column:
    """Text as the title tables have it: entities decoded, lower case, apostrophes dropped, other signs
    as one blank.  An entity other than ampersands and apostrophes can only stand for a sign here."""
    c = F.regexp_replace(F.lower(c), r"&(#0*39|#x0*27|apos|#0*8217|#x0*2019|rsquo);", "")
    c = F.regexp_replace(c, r"&(amp|#0*38|#x0*26);", "&")
    c = F.regexp_replace(c, r"&(#\d+|#x[0-9a-f]+|[a-z]+);", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "['’]", ""), "[^a-z0-9]+", " "))


def look_up(norm: Column, table: list[tuple[str, str]]) -> Column:
    """The code of the first table line whose title part is in the text.  The table is one constant
    array, so the plan stays small however long it is."""
    rows = F.array(*(F.struct(F.lit(part).alias("part"), F.lit(code).alias("code")) for part, code in table))
    return F.try_element_at(F.filter(rows, lambda row: F.contains(norm, row["part"])), F.lit(1))["code"]


def language_of(text: Column) -> Column:
    """Language named in a text; JP and EN count as codes in capitals only."""
    low = F.lower(text)
    return first_case([
        (contains_any(low, t.LANGUAGE_WORDS["JP"]) | text.rlike(t.LANGUAGE_CODES["JP"]), F.lit("JP")),
        (contains_any(low, t.LANGUAGE_WORDS["KR"]), F.lit("KR")),
        (contains_any(low, t.LANGUAGE_WORDS["EN"]) | text.rlike(t.LANGUAGE_CODES["EN"]), F.lit("EN")),
        (contains_any(low, t.LANGUAGE_WORDS["ES"]), F.lit("ES")),
    ])


def generic_code(text: Column) -> Column:
    digits = found(text, _GENERIC, 2)
    return F.when(digits.isNotNull(), F.concat(F.upper(found(text, _GENERIC, 1)), F.format_string("%02d", digits.cast("int"))))


def packaging_of(family: str, text: Column) -> Column:
    """case before display before sobre; the first "x N" counts if N is the family's number of units."""
    units, quantity = t.PACKAGING_UNITS.get(family, {}), found(text, r"(?i)\bx\s*(\d+)\b").try_cast("int")
    holds = lambda kind: F.coalesce(quantity == units[kind], F.lit(False)) if kind in units else F.lit(False)
    return first_case([
        (text.rlike(t.CASE) | holds("case"), F.lit("case")),
        (text.rlike(t.DISPLAY) | holds("display"), F.lit("display")),
    ], F.lit("sobre"))


def _volume(text: Column, prefix: str = "VOL") -> Column:
    return _code(prefix, found(text, t.VOLUME))


#: Title tables of ``functions.tables`` that ``classify`` looks texts up in.
TITLE_TABLES = ("BOOSTER_TITLES", "PREMIUM_BOOSTER_TITLES", "EXTRA_BOOSTER_TITLES", "STARTER_DECK_TITLES", "STARTER_DECK_CHARACTERS", "DOUBLE_PACK_TITLES", "PREMIUM_CARD_EDITIONS", "PREMIUM_CARD_EDITIONS_SHORT", "PLAYMAT_CHARACTERS", "SLEEVES_VARIANTS")


def standard_titles(spark: SparkSession) -> DataFrame:
    """The built-in title tables, to be changed and given to ``classify``."""
    rows = [(name, place, title, code) for name in TITLE_TABLES for place, (title, code) in enumerate(getattr(t, name))]
    return spark.createDataFrame(rows, "table string, place int, title string, code string")


def _one_pass(nv: Column, norm: Column, text: Column, name: Column, language: Column, title: Callable[[str], Column]) -> Column:
    """The decision as a struct.  ``nv``: name and variant; ``norm``: the same, normalized; ``text``: all
    in lower case, with tags on the second pass; ``title``: the code that a title table has for ``norm``."""
    single = ~nv.rlike(_RANGE)
    numbered = lambda prefix: _code(prefix, found(nv, _family(prefix)))

    def result(kind: str, code: Column | None = None, main: Column | None = None, packaging: Column | None = None) -> Column:
        values = [F.lit(kind), code, language, main, packaging]
        return F.struct(*((F.lit(None) if v is None else v).cast("string").alias(n) for n, v in zip(_SCHEMA, values, strict=True)))

    packed = lambda kind, code, main=None: result(kind, code, main, packaging_of(kind, text))
    titled = lambda prefix, table: F.when(single, F.coalesce(numbered(prefix), title(table)))
    low = F.lower(nv)
    deck = F.coalesce(
        F.when(single, F.coalesce(numbered("ST"), *(_code("ST", found(low, p)) for p in t.DECK_NUMBERS), title("STARTER_DECK_TITLES"))),
        title("STARTER_DECK_CHARACTERS"),
    )
    double = F.when(single, F.coalesce(numbered("DP"), _code("DP", F.coalesce(*(found(text, p) for p in t.DOUBLE_PACK_NUMBERS))), title("DOUBLE_PACK_TITLES")))
    main_of_double = first_case([(double == dp, F.lit(op)) for dp, op in t.BOOSTER_OF_DOUBLE_PACK.items()])
    sleeves = F.coalesce(_volume(nv), *(_code("VOL", found(nv, p)) for p in t.SLEEVE_NUMBERS), title("SLEEVES_VARIANTS"))
    booster = titled("OP", "BOOSTER_TITLES")

    return first_case([
        (contains_any(text, t.LOT_WORDS), result("LOTE_CARTAS", generic_code(nv))),
        (contains_any(text, t.PROMO_WORDS) | name.rlike(t.PROMO_NUMBER), result("PROMO_CARD", generic_code(nv))),
        (text.rlike(t.DON) & ~text.rlike(t.DON_SEALED), result("PROMO_CARD", _code("DP", found(text, _family("DP"))))),
        (contains_any(text, t.MYSTERY_WORDS), result("MYSTERY_PACK")),
        (contains_any(text, t.DICE_WORDS), result("DICE_ACCESSORY")),
        (text.rlike(_family("DF")) | contains_any(text, t.DEVIL_FRUIT_WORDS), result("DEVIL_FRUITS_COLLECTION", F.when(single, F.coalesce(numbered("DF"), _volume(nv, "DF"))))),
        (text.rlike(_family("IB")) | contains_any(text, t.ILLUSTRATION_WORDS), result("ILLUSTRATION_BOX", F.coalesce(_volume(nv), F.when(single, _code("VOL", found(nv, _family("IB"))))))),
        (contains_any(text, t.PLAYMAT_WORDS), result("PLAYMAT", F.coalesce(_volume(nv), title("PLAYMAT_CHARACTERS")))),
        (contains_any(text, t.SLEEVE_WORDS), result("SLEEVES", sleeves)),
        (contains_any(text, t.CARD_COLLECTION_WORDS), result("PREMIUM_CARD_COLLECTION", F.coalesce(_volume(nv), title("PREMIUM_CARD_EDITIONS"), title("PREMIUM_CARD_EDITIONS_SHORT")))),
        (contains_any(text, t.LEARNING_WORDS), packed("STARTER_DECK", F.coalesce(_code("LD", found(nv, t.LEARNING_NUMBER)), F.lit("LD01")))),
        (text.rlike(_family("ST")) | contains_any(text, t.DECK_WORDS), packed("STARTER_DECK", deck)),
        (text.rlike(_family("DP")) | contains_any(text, t.DOUBLE_PACK_WORDS), packed("DOUBLE_PACK", double, main_of_double)),
        (text.rlike(_family("PRB")) | title("PREMIUM_BOOSTER_TITLES").isNotNull(), packed("PREMIUM_BOOSTER_BOX", titled("PRB", "PREMIUM_BOOSTER_TITLES"))),
        (text.rlike(_family("OP")) | title("BOOSTER_TITLES").isNotNull(), packed("ONE_PIECE", booster, booster)),
        (text.rlike(_family("EB")) | contains_any(text, t.EXTRA_BOOSTER_WORDS) | title("EXTRA_BOOSTER_TITLES").isNotNull(), packed("EXTRA_BOOSTER", titled("EB", "EXTRA_BOOSTER_TITLES"))),
        (text.rlike(t.SEALED) & ~text.rlike(t.ACCESSORY), packed("ONE_PIECE", None)),
    ], result("OTROS", generic_code(nv)))


def classify(df: DataFrame, name: str = "name", variant: str = "variant", tags: str = "tags", out: str = "cls", titles: DataFrame | None = None) -> DataFrame:
    """``df`` with the classification struct ``out``.  An empty or missing name is OTROS throughout.

    ``titles`` (table, place, title, code; see ``standard_titles``) stand in for the built-in title tables."""
    have = F.coalesce(F.col(name), F.lit("")) != ""
    variant_text, tag_text = F.coalesce(F.col(variant), F.lit("")), F.coalesce(F.col(tags), F.lit(""))
    staged = df.withColumn("_nv", F.concat_ws(" ", F.col(name), variant_text))
    named = F.coalesce(language_of(F.col(name)), language_of(F.col(variant)))
    staged = staged.withColumn("_norm", normalized(F.col("_nv"))).withColumn("_lang", F.coalesce(named, F.when(~contains_any(F.lower("_nv"), t.NOT_ENGLISH), F.lit("EN"))))
    staged = staged.withColumn("_low", F.lower(F.concat(F.col("_nv"), F.lit(" ")))).withColumn("_all", F.concat(F.col("_low"), F.lower(tag_text)))
    title = lambda table: look_up(F.col("_norm"), getattr(t, table))
    if titles is not None:
        staged, title = with_titles(staged, "_norm", titles, "_titles"), lambda table: F.col("_titles")[table]
    once = lambda text: _one_pass(F.col("_nv"), F.col("_norm"), F.col(text), F.col(name), F.col("_lang"), title)
    staged = staged.withColumn("_first", once("_low"))
    nothing = F.struct(F.lit("OTROS").alias(_SCHEMA[0]), *(F.lit(None).cast("string").alias(n) for n in _SCHEMA[1:]))
    cls = F.when(~have, nothing).when((F.col("_first.product_type") != "OTROS") | (tag_text == ""), F.col("_first")).otherwise(once("_all"))
    return staged.withColumn(out, cls).drop("_nv", "_norm", "_lang", "_low", "_all", "_first", "_titles")


def category_of(product_type: Column) -> Column:
    """The category's slug, null for types without one."""
    return first_case([(product_type == k, F.lit(v)) for k, v in t.CATEGORY_OF_TYPE.items()])


def quantity_is_ambiguous(raw_name: Column, product_type: Column, packaging: Column) -> Column:
    """Whether the name holds a quantity other than the one its type and packaging stand for."""
    number = F.coalesce(*(found(raw_name, t.QUANTITY, k) for k in (1, 2, 3))).try_cast("int")
    expected = first_case([((product_type == kind) & (packaging == pack), F.lit(n)) for kind, units in t.PACKAGING_UNITS.items() for pack, n in units.items()], F.lit(1))
    return F.coalesce(number != expected, F.lit(False))
