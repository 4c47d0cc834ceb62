"""Text normalisation and cleaning as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that a regular expression's \s stands for in the data model.
SPACE_CHARS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{SPACE_CHARS}]"
#: The same, with a first look that most characters fail at once (for Spark's expressions only).
BLANK = f"[[^!-~]&&{WS}]"
#: The same as WS without the line feed.
INLINE = r"[\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
#: The characters of WS.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Phrases that mark a sentence of a lecture's speech as irrelevant.
IRRELEVANT_PHRASES = (
    "добрый день", "добрый вечер", "здравствуйте", "здрасьте", "всем привет", "приветствую", "перерыв",
    "вопросы есть", "какие вопросы", "начинаем", "заканчиваем", "до свидания", "спасибо за внимание", "ладно",
    "так", "следующая тема", "перейдём к следующему", "как вы помните", "давайте вспомним",
)
MIN_SENTENCE = 10


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def strip_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def remove_invisible(c: Column) -> Column:
    """Byte-order marks and zero-width characters go, wherever they are."""
    return F.regexp_replace(c, r"[[^\x00-\x7F]&&[\x{FEFF}\x{FFFE}\x{200B}-\x{200D}]]", "")


def normalize_linebreaks(c: Column) -> Column:
    """Line ends become LF; three and more become two; none at either end."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n\n\n+", "\n\n"), F.lit("\n"))


def join_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"-\r?\n", "")


def remove_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def normalize_spaces(c: Column) -> Column:
    """Runs of spaces and tabs become a space; every line is stripped."""
    return F.array_join(F.transform(F.split(F.regexp_replace(c, r"[ \t]+", " "), "\n", -1), strip), "\n")


def normalize_punctuation(c: Column) -> Column:
    """Straight quotes and hyphens; no space before punctuation, one between it and a letter."""
    c = F.regexp_replace(c, "[«»„‟\"＂]", '"')
    c = F.regexp_replace(c, "[–—]", "-")
    c = F.regexp_replace(c, rf"(?<!{BLANK}){BLANK}++([.,;:!?])", "$1")  # tried once for each run of white space
    return F.regexp_replace(c, "([.,;:!?])([А-Яа-яA-Za-z])", "$1 $2")


def normalize(c: Column, aggressive: bool = False) -> Column:
    """All steps in order; a null text becomes empty."""
    c = F.coalesce(c, F.lit(""))
    for step in (remove_invisible, normalize_linebreaks, join_hyphenated, remove_control, normalize_spaces):
        c = step(c)
    return normalize_punctuation(c) if aggressive else c


def normalization_stats(before: Column, after: Column) -> Column:
    """Lengths before and after, and three counts that stay 0."""
    zero = F.lit(0)
    return F.struct(F.length(before).alias("original_length"), F.length(after).alias("normalized_length"), zero.alias("removed_special_chars"), zero.alias("normalized_linebreaks"), zero.alias("normalized_spaces"))


def normalize_whitespace(c: Column) -> Column:
    """Only line ends, runs of spaces and tabs, and both ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " "))


def split_sentences_raw(c: Column) -> Column:
    return F.split(c, rf"(?<=[.!?]){BLANK}+", -1)


def sentences(c: Column) -> Column:
    """Pieces after a full stop, exclamation or question mark; stripped, without empty ones."""
    return F.filter(F.transform(split_sentences_raw(c), strip), lambda s: s != "")


def clean_speech(c: Column, phrases: tuple[str, ...] = IRRELEVANT_PHRASES, shortest: int = MIN_SENTENCE) -> Column:
    """Sentences without an irrelevant phrase and of `shortest` characters at least, joined by a space."""
    pattern = rf"(?iuU)\b(?:{'|'.join(phrases)})\b"
    kept = F.filter(split_sentences_raw(c), lambda s: ~s.rlike(pattern) & (F.length(strip(s)) >= shortest))
    return F.array_join(kept, " ")


# Private-use characters of symbol fonts, and what each stands for.
SYMBOL_FROM = (
    "\uf061\uf062\uf063\uf064\uf065\uf066\uf067\uf068\uf069\uf06a\uf06b\uf06c\uf06d\uf06e\uf06f\uf070\uf071\uf072\uf073\uf074\uf075\uf076\uf077\uf078\uf079"
    "\uf041\uf042\uf043\uf044\uf045\uf046\uf047\uf048\uf049\uf04a\uf04b\uf04c\uf04d\uf04e\uf04f\uf050\uf051\uf052\uf053\uf054\uf055\uf056\uf057\uf058"
    "\uf03d\uf02d\uf02b\uf02f\uf027\uf03c\uf03e\uf028\uf029\uf05b\uf05d\uf07b\uf07d\uf03a\uf03b\uf02c\uf02e\uf020"
    "\uf0b3\uf0b4\uf0b5\uf0b6\uf0b7\uf0b8\uf0b9\uf0ba\uf0bb\uf0bc\uf0bd\uf0be\uf0bf\uf0c0\uf0c1"
)
SYMBOL_TO = (
    "αβγδεζηθικμλνξοπρσστυφχψω"
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
    "=-+/*<>()[]{}:;,. "
    "≥≤≠≈∼∝∞∂∇∫∑∏√∛∜"
)


def repair_symbols(c: Column) -> Column:
    """Private-use characters that PDF fonts leave become Greek letters, signs and brackets."""
    return F.translate(c, SYMBOL_FROM, SYMBOL_TO)
