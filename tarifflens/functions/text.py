"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a section heading, and words that a price may carry.
SECTION_HINTS = ("раздел", "блок", "подраздел", "глава", "часть")
PRICE_WORDS = ("тенге", "kzt", "тг")
#: Cyrillic letters and the Latin ones that look like them.
LOOKALIKES = ("АВЕКМНОПРСТХУавекмнопрстху", "ABEKMHOPPCTXYabekmhoppctxy")
#: Phrases in which a row isn't a service.
NOT_A_SERVICE = ("стоимость", "наименование услуги", "раздел", "приложение", "таблица")
EDGE = " ,.;:-|"
SPACES = "(?U)\\s+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(text: Column) -> Column:
    """No null, no soft hyphens, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("­"), F.lit("")), SPACES, " "))


def contains_any(text: Column, hints) -> Column:
    return text.rlike("|".join(h.replace(".", "\\.") for h in hints))


def truncate(text: Column, limit: int) -> Column:
    """Cleaned, null if empty, cut with a question mark if longer than limit."""
    short = F.concat(F.rtrim(F.substring(clean(text), 1, max(0, limit - 1))), F.lit("?"))
    return F.when(F.length(clean(text)) > limit, short).otherwise(F.nullif(clean(text), F.lit("")))


def is_section(text: Column) -> Column:
    lowered = F.lower(clean(text))
    # Cleaned text never ends in a space, so one after the number has text behind it.
    return contains_any(lowered, SECTION_HINTS) | lowered.rlike("^\\d+(\\.\\d+)*[.)]?\\s")


def is_code_like(text: Column) -> Column:
    """At most 24 characters without spaces, a digit among them, Latin letters, digits and . - / only."""
    packed = F.replace(clean(text), F.lit(" "), F.lit(""))
    return (F.length(packed) <= 24) & packed.rlike("[0-9]") & packed.rlike("^[A-Za-z0-9][A-Za-z0-9.\\-/]*$")


def without_price_words(text: Column) -> Column:
    return F.regexp_replace(F.lower(clean(text)), "|".join(PRICE_WORDS), "")


def is_price_like(text: Column) -> Column:
    packed = F.replace(without_price_words(text), F.lit(" "), F.lit(""))
    return packed.rlike("^\\d+([.,]\\d+)?$")


def normalize_code(text: Column) -> Column:
    """Look-alike letters to Latin, no spaces, lost characters as U."""
    return F.replace(F.replace(F.translate(text, *LOOKALIKES), F.lit(" "), F.lit("")), F.lit("?"), F.lit("U"))


def strip_noise(text: Column) -> Column:
    """Without a row number in front and marks at the ends."""
    tail = F.regexp_replace(F.regexp_replace(clean(text), "^[ийИЙ]\\s+\\d+(\\.\\d+)+\\s+", ""), "^\\d+(\\.\\d+)+\\s+", "")
    return F.btrim(tail, F.lit(EDGE))


def looks_uncertain(text: Column) -> Column:
    t = F.lower(clean(text))
    letters = F.length(F.regexp_replace(t, "[^\\p{L}]", ""))
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (F.length(t) < 4) | contains_any(t, NOT_A_SERVICE) | (letters < 3) | (digits / F.greatest(F.length(t), F.lit(1)) > 0.35)


def suffix(path: Column) -> Column:
    """Lower-cased ending with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, "[^/\\\\.](\\.[^./\\\\]+)$", 1))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def source_label(path: Column) -> Column:
    kind = F.replace(suffix(path), F.lit("."), F.lit(""))
    return (
        F.when(kind == "docx", "WORD").when(kind.isin("xls", "xlsx"), "EXCEL").when(kind == "pdf", "PDF").when(kind == "zip", "ZIP").when(kind == "", "FILE").otherwise(F.upper(kind))
    )


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))


def group_key(path: Column) -> Column:
    """The first folder, or __root__ for a file outside any."""
    return F.when(F.size(path_parts(path)) > 1, F.get(path_parts(path), F.lit(0))).otherwise("__root__")


#: Fixed value: a year of the 1900s or 2000s between marks, spaces or ends.
YEAR = "(?:^|[._\\-\\s])(19\\d{2}|20\\d{2})(?:$|[._\\-\\s])"


def cleaned_partner(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(name, "(?iu)прайс|price|год", " "), YEAR, " ")
    bare = F.btrim(F.regexp_replace(F.regexp_replace(bare, "[_-]+", " "), "\\s+", " "), F.lit(" ._-"))
    return F.when(bare == "", name).otherwise(bare)


def partner_name(path: Column) -> Column:
    """The partner that a file's name tells of."""
    s = stem(path)
    numbered = F.nullif(F.trim(F.regexp_extract(s, "^((?iu)клиника\\s*\\d+)", 1)), F.lit(""))
    no_number = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\\b\\d{4}\\b", " "), "[_-]+", " "), "\\s+", " "), F.lit(" ._-"))
    return F.coalesce(numbered, F.when(cleaned_partner(s) != s, cleaned_partner(s)), F.nullif(no_number, F.lit("")), s)


def archive_partner(archive: Column, path: Column) -> Column:
    """The partner of a file in an archive: what its name tells of, else its first folder, else the archive's name."""
    own = partner_name(path)
    return F.when(own != stem(path), own).when(group_key(path) != "__root__", group_key(path)).otherwise(stem(archive))


def display_name(file_name: Column) -> Column:
    """The name without its ending, blanks for underscores."""
    return F.replace(F.regexp_replace(file_name, "\\.[^.]*$", ""), F.lit("_"), F.lit(" "))


def short_id(x: Column) -> Column:
    return F.substring(x.cast("string"), 1, 8)


#: What statuses are called, and how a name looks that a machine has given.
STATUS_LABELS = {
    "processed": "обработан", "needs_review": "требует проверки", "processing": "обрабатывается", "pending": "в очереди", "partial": "частично разобран",
    "error": "ошибка", "failed": "ошибка", "loading": "загрузка",
}
NO_STATUS, NO_NAME, INTERNAL = "неизвестно", "Файл", "(?i)^([0-9a-f-]{12,}|upload)$"


def short_text(x: Column, size: int = 12) -> Column:
    """The text, or if it is longer than twice the size, its two ends."""
    return F.when(F.length(x) > 2 * size, F.concat(F.substring(x, 1, size), F.lit("…"), F.substring(x, -size, size))).otherwise(x)


def leaf_stem(path: Column) -> Column:
    """The last part of a path without its ending; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.trim(path), "([^\\\\/]*)$", 1), "\\.[^.]+$", ""), F.lit(""))


def resolved_name(file_name: Column, fallback: Column, doc_id: Column) -> Column:
    """What a document is called: its file, unless a machine named it, else the fallback, else a short id."""
    stems = [leaf_stem(file_name), leaf_stem(fallback)]
    told = [F.when(~x.rlike(INTERNAL), x) for x in stems]
    return F.coalesce(*told, short_text(F.nullif(doc_id.cast("string"), F.lit(""))), *stems, F.lit(NO_NAME))


def status_label(status: Column) -> Column:
    out = F.coalesce(F.nullif(status, F.lit("")), F.lit(NO_STATUS))
    for name, label in STATUS_LABELS.items():
        out = F.when(status == name, label).otherwise(out)
    return out


def status_class(status: Column) -> Column:
    return F.when(status == "processed", "status-badge ok").when(status.isin("needs_review", "error", "failed"), "status-badge error").otherwise("status-badge")


def format_key(file_name: Column, file_format: Column) -> Column:
    """The kind of file by its format, or where none is given, by the ending of its name."""
    kind = F.lower(F.coalesce(F.nullif(file_format, F.lit("")), F.element_at(F.split(file_name, "\\."), -1)))
    return F.when(kind.isin("xlsx", "xls", "docx", "pdf", "zip"), kind).otherwise("file")


def join_notes(*parts: Column) -> Column:
    """The parts that are there, each once, in order."""
    return F.array_join(F.array_distinct(F.filter(F.array_compact(F.array(*parts)), lambda p: p != "")), "; ")


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, "\\s+"), lambda t: t != "")), " ")


#: The longest text whose table row fits the bits of a long.
BITS = 62


def _subsequence_by_rows(a: Column, b: Column) -> Column:
    """A fold over a's characters with one row of the table as state, for texts of any length."""
    chars = F.split(b, "")

    def row(prev: Column, c: Column) -> Column:
        def cell(acc: Column, i: Column) -> Column:
            diagonal = F.get(prev, i)
            value = F.when(F.get(chars, i) == c, diagonal + 1).otherwise(F.greatest(F.get(prev, i + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), F.array(F.lit(0)), cell)

    start = F.transform(F.sequence(F.lit(0), F.size(chars)), lambda i: F.lit(0))
    return F.element_at(F.aggregate(F.split(a, ""), start, row), -1)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence. Up to BITS characters of b, a row of its table is kept as the bits where it doesn't grow, and a step is an addition."""
    m = F.length(b)
    whole = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(m, F.lit(BITS))) - 1
    places = F.transform(F.split(b, ""), lambda y, i: F.struct(y.alias("y"), F.when(i < BITS, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(i, F.lit(BITS)))).otherwise(F.lit(0)).alias("bit")))

    def fold(known: Column) -> Column:
        def step(v: Column, x: Column) -> Column:
            here = F.aggregate(known["places"], F.lit(0).cast("bigint"), lambda acc, p: F.when(p["y"] == x, acc.bitwiseOR(p["bit"])).otherwise(acc))
            return let(F.struct(v.alias("v"), v.bitwiseAND(here).alias("u")), lambda s: (s["v"] + s["u"]).bitwiseOR(s["v"] - s["u"]).bitwiseAND(known["whole"]))

        return m - F.bit_count(F.aggregate(F.split(a, ""), known["whole"], step))

    short = let(F.struct(places.alias("places"), whole.alias("whole")), fold)
    return F.when((a == "") | (b == ""), 0).when(m <= BITS, short).otherwise(_subsequence_by_rows(a, b))


def ratio(x: Column, y: Column) -> Column:
    """Normalised insert-delete similarity, 0 to 100."""
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(200.0 * common_subsequence(x, y) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """ratio of the sorted tokens."""
    return ratio(token_sorted(a), token_sorted(b))
