"""Text functions, Column to Column; no Python runs on rows except in name_ratio."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Punctuation stripped from facet values.
EDGES = " .,:;!?()[]{}\"'"


# These are made at each call: a used one holds a gateway, which cannot be sent to executors with this module.


def _icu(method: str, c: Column) -> Column:
    """A static method of ICU's Normalizer, which Spark ships with; it stays in the JVM.

    Spark takes such calls for nondeterministic, so they stand in projections, not in aggregates or join conditions.
    """
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), c, F.lit(False))


def nfc(c: Column) -> Column:
    """Unicode form NFC; characters below U+0300 are in it already."""
    return F.when(c.rlike(r"[^\x00-\x{2FF}]"), _icu("compose", c)).otherwise(c)


def strip_marks(c: Column) -> Column:
    """Without combining marks (NFD, category Mn dropped)."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(_icu("decompose", c), r"\p{Mn}", "")).otherwise(c)


def name_ratio(a: Column | str, b: Column | str) -> Column:
    """Matching-blocks similarity of two names, 0 to 1."""

    @F.pandas_udf(DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])

    return udf(a, b)


def squeeze(c: Column) -> Column:
    """NFC, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(nfc(c), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Lower-cased words between white space; an empty text has none."""
    return F.filter(F.split(F.lower(squeeze(c)), " "), lambda w: w != "")


def key(c: Column) -> Column:
    """Match key: NFC, lower case, everything but letters and numbers as one space."""
    return F.trim(F.regexp_replace(F.lower(nfc(c)), r"[^\p{L}\p{N}]+", " "))


def fold_key(c: Column) -> Column:
    """Key without diacritics, every y as i."""
    return squeeze(F.regexp_replace(strip_marks(F.translate(key(c), "đ", "d")), "y", "i"))


def years(c: Column) -> Column:
    """Distinct years 1000 to 2099 that stand as whole digit runs, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(1[0-9]{3}|20[0-9]{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int")))


def years_to_2029(c: Column) -> Column:
    """Distinct years 1000 to 2029 between word borders, as texts, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?U)\b(1[0-9]{3}|20[0-2][0-9])\b"), F.lit(1)))


def content_tokens(c: Column, least: int = 3) -> Column:
    """Words of letters, numbers and underscores; splitting between them costs a tenth of extracting them."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= max(1, least))


def facet_value(c: Column) -> Column:
    return F.btrim(squeeze(c), F.lit(EDGES))


def confidence(c: Column) -> Column:
    """To [0, 1]; what is no number is 0."""
    x = c.try_cast("double")
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))))


def uppercase_ratio(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Share of set a that is in b."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def tail(c: Column, n: int) -> Column:
    """The last n characters, from the first word border in them."""
    end = F.right(c, F.lit(n))
    return F.when(F.length(c) <= n, c).otherwise(F.regexp_replace(end, r"^\S* ", ""))


def smart_crop(text: Column, claim: Column, width: int) -> Column:
    """The first window of width characters, at steps of half of it, with most claim tokens."""
    step = max(1, width // 2)
    wanted = F.array_distinct(tokens(claim))
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))

    def window(s: Column) -> Column:
        part = F.substring(text, s + 1, F.lit(width))
        return F.struct(F.size(F.array_intersect(wanted, tokens(part))).alias("n"), (-s).alias("s"), part.alias("part"))

    best = F.array_max(F.transform(starts, window))["part"]
    return F.when(F.length(text) <= width, text).when(F.size(wanted) == 0, F.substring(text, F.lit(1), F.lit(width))).otherwise(best)


def label(c: Column) -> Column:
    """Verdict text to real, fake or unknown; lacking evidence counts as fake."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    real, fake = x.contains("real"), x.contains("fake")
    return F.when(x.contains("insufficient"), "fake").when(real & ~fake, "real").when(fake & ~real, "fake").otherwise("unknown")


#: Units that belong to a number before them.
UNITS = ["%", "phần trăm", "triệu", "tỉ", "tỷ", "nghìn", "vạn", "ha", "km2", "km²", "năm", "người", "quân", "lần", "tháng"]


def quantities(c: Column) -> Column:
    """Distinct numbers and ranges, with their unit, in order; bare years are none."""
    number = r"\d+(?:[.,]\d+)?"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_]){number}(?:(?U:\s*)[-–—](?U:\s*){number})?(?U:\s*)(?:{'|'.join(UNITS)})?"), F.lit(0))
    clean = F.transform(found, facet_value)
    return F.array_distinct(F.filter(clean, lambda v: (v != "") & ~v.rlike(r"^(1[0-9]{3}|20[0-9]{2})$")))


#: Words that tell claims and facts nothing.
GRAPH_STOP = (
    "a ai anh bà bài bị bộ bởi các cái cần có còn của cùng đã đang đây để đến đều đi đó được gì hay hơn khi là lại làm lên mà một này năm nên nếu "
    "người như những ở ra rằng sau sẽ so sự tại theo thì trong trên trước từ và vào về vì với cho chủ yếu nhiều không thành phần"
).split()
#: Words that tell names nothing.
NAME_STOP = "của cho các những một nước quốc gia dân nhân thế giới chiến tranh phong trào cách mạng thời kỳ kì năm lần".split()


def name_tokens(c: Column, stop: list[str] = NAME_STOP, least: int = 3) -> Column:
    """Distinct words of a key without stop words and short words; numbers stay."""
    return F.array_except(F.filter(F.split(key(c), " "), lambda w: F.length(w) >= least), F.array(*map(F.lit, stop)).cast("array<string>"))


def string_list(c: Column, distinct: bool = True) -> Column:
    """The texts of a list squeezed, blanks dropped; repeats stay if not distinct."""
    out = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), squeeze), lambda x: x != "")
    return F.array_distinct(out) if distinct else out


def graph_tokens(c: Column, stop: list[str] = GRAPH_STOP, least: int = 3) -> Column:
    """Distinct words of a key without stop words, short words and numbers."""
    words = F.filter(F.split(key(c), " "), lambda w: (F.length(w) >= least) & ~w.rlike(r"^\p{Nd}+$"))
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>"))


def strip_fence(c: Column) -> Column:
    """An answer without the code fence around it."""
    x = F.trim(c)
    bare = F.regexp_replace(F.regexp_replace(x, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.trim(F.when(x.startswith("```"), bare).otherwise(x))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def json_object(c: Column) -> Column:
    """A model's answer as a JSON text, or null: fences go, text around the braces goes, a cut end is closed."""
    # raw control characters are legal here, so they become spaces
    return let(F.regexp_replace(strip_fence(c), r"[\x00-\x1F]", " "), _object)


def _object(x: Column) -> Column:
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    open_ = F.regexp_extract(x, r"(?s)(\{.*)$", 1)
    tries = [x, inner, *[F.concat(open_, F.lit(end)) for end in ('"}', "}", '"]}', "]}")]]
    valid = lambda t: F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(*map(valid, tries))


#: What a verdict may call wrong.
WRONG = ["time", "place", "person", "organization", "event", "quantity", "action", "result", "concept", "insufficient_evidence"]


def wrong_facets(items: Column) -> Column:
    """Distinct known names in a list of texts that may each hold several."""
    words = F.split(F.lower(F.array_join(F.coalesce(items, F.array().cast("array<string>")), " ")), r"[|,;/\s]+")
    return F.array_distinct(F.filter(words, lambda w: w.isin(WRONG)))


def verdict(c: Column) -> Column:
    """A verifier's answer as struct(label, confidence, evidence_ids, wrong_facets, how).

    how is json, or salvaged where only single fields could be read, or null where none could.
    """
    return let(F.struct(strip_fence(c).alias("x"), json_object(c).alias("j")), lambda b: _verdict(b["x"], b["j"]))


def _verdict(x: Column, j: Column) -> Column:
    none = F.array().cast("array<string>")
    schema = "label string, confidence string, evidence_ids array<string>, wrong_facets array<string>"
    parts = lambda s, ids, wrong, how: F.struct(s["label"].alias("label"), confidence(s["confidence"]).alias("confidence"), F.array_distinct(ids).alias("evidence_ids"), wrong_facets(wrong).alias("wrong_facets"), F.lit(how).alias("how"))
    read = let(F.from_json(j, schema), lambda s: parts(F.struct(label(s["label"]).alias("label"), s["confidence"].alias("confidence")), F.coalesce(s["evidence_ids"], none), s["wrong_facets"], "json"))
    said = F.struct(F.regexp_extract(x, r'"label"\s*:\s*"(real|fake)"', 1).alias("label"), F.regexp_extract(x, r'"confidence"\s*:\s*([0-9.]+)', 1).alias("confidence"))
    listed = F.regexp_extract_all(F.regexp_extract(x, r'"wrong_facets"\s*:\s*\[([^\]]*)\]', 1), F.lit(r'"([a-z_]+)"'), F.lit(1))
    saved = parts(said, F.regexp_extract_all(x, F.lit(r'"(E\d+)"'), F.lit(1)), listed, "salvaged")
    return F.when(j.isNotNull(), read).when(said["label"] != "", saved)
