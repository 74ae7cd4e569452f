"""Text columns: similarities, cleaning, character classes and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The character classes that mark valid vocabulary entries.
CHINESE = r"\x{4e00}-\x{9fa5}"
CHINESE_OR_LETTERS = rf"^[{CHINESE}a-zA-Z]+$"
EXTENDED = rf"^[{CHINESE}a-zA-Z0-9\s`~!@#$%^\&Ω\x{{1F51E}}*()≈≡≠＝<>＜＞≮≯∷±＋－×÷／∫∮∝∞∧∨∑∏∪∩∈∵∴⊥‖∠⌒≌∽√（）【】｛｝ⅠⅡ⊕⊙∥αβγδεζηθΔ+={{}}\[\]:;\"',.?/]+$"
#: Fixed value: the pre-tokenizer's pattern.
PRE_TOKEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike (1.0)."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def characters(text: Column) -> Column:
    """The characters of a text as an array; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def quick_ratio(a: Column, b: Column) -> Column:
    """2 * shared characters (as multisets) / total characters; two empty texts give 1.0."""
    x, y = characters(a), characters(b)
    size = lambda arr, c: F.size(F.filter(arr, lambda e: e == c))
    shared = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, c: acc + F.least(size(x, c), size(y, c)))
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * shared / total)


def decoded(text: Column, eos: str = "</s>", pad: str = "<pad>", task_tag: bool = True) -> Column:
    """Model output without end and padding marks, its first tag, and blanks beside tags."""
    clean = F.replace(F.replace(text, F.lit(eos), F.lit("")), F.lit(pad), F.lit(""))
    if task_tag:
        clean = F.regexp_replace(clean, r"^([^<]*)<.*?>", "$1")
    clean = F.btrim(clean)
    return F.replace(F.replace(clean, F.lit("> "), F.lit(">")), F.lit(" </s_"), F.lit("</s_"))


def rows_text(rows: Column) -> Column:
    """Rows of boxes (array of arrays with .text) as one text: blanks in a row, ``</n>`` between rows."""
    return F.array_join(F.transform(rows, lambda row: F.array_join(F.transform(row, lambda b: b["text"]), " ")), "</n>")


def linux_path(path: Column, drive: str = "J:/", mount: str = "/mnt/j/") -> Column:
    return F.replace(F.replace(path, F.lit("\\"), F.lit("/")), F.lit(drive), F.lit(mount))


def path_part(path: Column, n: int) -> Column:
    """The n-th part of a path, counted from 1, or from the end if negative; null beyond it."""
    return F.try_element_at(F.split(path, "/"), F.lit(n))


def stem(path: Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def unlabelled_path(path: Column) -> Column:
    """True for label files outside split folders: the path names Label.txt and, 'pretrain' aside, no split."""
    rest = F.replace(path, F.lit("pretrain"), F.lit(""))
    return F.contains(path, F.lit("Label.txt")) & ~F.contains(rest, F.lit("train")) & ~F.contains(rest, F.lit("validation")) & ~F.contains(rest, F.lit("test"))


def chinese_or_letters(text: Column) -> Column:
    return text.rlike(CHINESE_OR_LETTERS)


def extended_valid(text: Column) -> Column:
    return text.rlike(EXTENDED)


def piece(text: Column) -> Column:
    """A sentence piece without its word mark."""
    return F.replace(text, F.lit("▁"), F.lit(""))


def pre_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PRE_TOKEN), F.lit(0))


def spelled(word: Column) -> Column:
    """A word as space-separated symbols with an end mark."""
    return F.concat(F.array_join(characters(word), " "), F.lit(" </w>"))


def words(text: Column) -> Column:
    """The parts of a text between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def trimmed_response(text: Column, sep: str) -> Column:
    """What stands before the first separator, trimmed."""
    return F.btrim(F.substring_index(text, sep, 1))
