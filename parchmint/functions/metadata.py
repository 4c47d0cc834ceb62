"""Statistics, topics and formula facts of a text, as Column functions. Keywords are a DataFrame operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmint.functions.spans import let
from parchmint.functions.text import BLANK, strip, words

# Words that are no keywords, Russian and English.
STOP_WORDS_RU = """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет
о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя
ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж
тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех
никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три
эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
""".split()
STOP_WORDS_EN = """
a an the and or but in on at to for of with by is are was were be been being have has had do does did will would shall
should can could may might must i you he she it we they me him her us them my your his its our their mine yours hers
ours theirs this that these those am not so too very just now then here there when where why how all any both each few
more most other some such no nor only own same than s t don ain aren couldn didn doesn hadn hasn haven isn ma mightn
mustn needn shan shouldn wasn weren won wouldn
""".split()
# Topics and the strings that speak for them; the first of equal scores wins.
TOPICS = {
    "математика": "теорема формула уравнение функция интеграл производная матрица вектор алгебра геометрия".split(),
    "информатика": "алгоритм программа код база данные сеть сервер клиент интерфейс бит байт".split(),
    "программирование": "python java javascript функция класс объект метод переменная цикл условие".split(),
}
NO_TOPIC = "неизвестно"
SHORT, LONG = 50, 500
STATISTICS = ("word_count", "sentence_count", "character_count", "avg_word_length", "avg_sentence_length", "unique_words", "lexical_diversity", "is_short", "is_long")


def clean_for_analysis(c: Column) -> Column:
    """Without formula placeholders, in lower case, with single spaces."""
    bare = F.lower(F.regexp_replace(c, r"(?d)\[\[FORMULA_.*?\]\]", ""))
    return strip(F.regexp_replace(bare, f"{BLANK}+", " "))


def text_statistics(c: Column) -> Column:
    """Counts and unrounded averages of a text; see rounded_statistics for what is shown.

    Words are found once for all of them. Take the fields in a select after the one that makes the struct, or the planner
    copies it into each.
    """
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def counted(found):
        parts = F.size(F.filter(F.split(c, "[.!?]+", -1), lambda s: strip(s) != ""))
        counts = F.struct(F.size(found).alias("n"), F.size(F.array_distinct(found)).alias("unique"), parts.alias("parts"), F.length(F.array_join(found, "")).alias("letters"))
        return let(counts, shown)

    def shown(x):
        n, unique, parts = x["n"], x["unique"], x["parts"]
        return F.struct(
            n.alias("word_count"), parts.alias("sentence_count"), F.length(c).alias("character_count"),
            share(x["letters"], n).alias("avg_word_length"), share(n, parts).alias("avg_sentence_length"),
            unique.alias("unique_words"), share(unique, n).alias("lexical_diversity"),
            (n < SHORT).alias("is_short"), (n > LONG).alias("is_long"),
        )

    return let(words(clean_for_analysis(c)), counted)


def rounded_statistics(stats: Column) -> Column:
    digits = {"avg_word_length": 2, "avg_sentence_length": 2, "lexical_diversity": 3}
    return let(stats, lambda s: F.struct(*[(F.round(s[name], digits[name]) if name in digits else s[name]).alias(name) for name in STATISTICS]))


def formula_presence(text: Column, formulas: Column) -> Column:
    marks = text.rlike(r"(?d)\[\[FORMULA_.*?\]\]")
    n = F.size(formulas)

    def of(kind):
        return F.size(F.filter(formulas, lambda f: f["formula_type"] == kind)).alias(kind)

    kinds = F.when(n > 0, F.struct(of("latex_inline"), of("latex_display"), of("plain_text"), n.alias("total")))
    return F.struct((marks | (n > 0)).alias("has_formulas"), n.alias("formula_count"), kinds.alias("formula_types"), marks.alias("has_formula_placeholders"))


def first_sentence(c: Column) -> Column:
    """Up to the first closing mark of the first line; else the first line."""
    found = F.regexp_extract(strip(c), r"(?d)\A.*?[.!?]", 0)
    return let(found, lambda f: F.when(f != "", strip(f)).otherwise(strip(F.substring_index(c, "\n", 1))))


def topic_scores(c: Column) -> Column:
    """How many strings of each topic the text holds, in the order of TOPICS."""
    return let(F.lower(c), lambda low: F.array(*[sum((low.contains(k).cast("int") for k in keys), F.lit(0)) for keys in TOPICS.values()]))


def topic_of(c: Column) -> Column:
    """The topic with most strings in the text; null without any."""
    names = F.array(*map(F.lit, TOPICS))
    return let(topic_scores(c), lambda s: F.when(F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))))


def main_topic(c: Column, inherited: Column | None = None, use_first_sentence: bool = True) -> Column:
    """main_topic, source and confidence: of the first sentence, else the whole text, else a parent's, else unknown."""

    def told(topic, source, confidence):
        return let(topic, lambda t: F.when(t.isNotNull(), F.struct(t.alias("main_topic"), F.lit(source).alias("source"), F.lit(confidence).alias("topic_confidence"))))

    ways = [told(topic_of(first_sentence(c)), "first_sentence", 0.8)] if use_first_sentence else []
    ways.append(told(topic_of(clean_for_analysis(c)), "full_text", 0.7))
    if inherited is not None:
        ways.append(told(inherited, "inherited", 0.6))
    return F.coalesce(*ways, told(F.lit(NO_TOPIC), "unknown", 0.3))


def keyword_words(c: Column) -> Column:
    """The words that can be keywords: no stop words, of three letters and more; all such words where none is left."""
    stop = STOP_WORDS_RU + STOP_WORDS_EN  # planned as a look-up in a hash set
    either = let(F.filter(words(clean_for_analysis(c)), lambda w: F.length(w) > 2), lambda found: F.struct(found.alias("found"), F.filter(found, lambda w: ~w.isin(stop)).alias("kept")))
    return let(either, lambda x: F.when(F.size(x["kept"]) > 0, x["kept"]).otherwise(x["found"]))


class Extractors:
    """The extractors of a composite, by name: functions of (text, formulas) that give a struct."""

    def __init__(self):
        self.found: dict[str, Callable[[Column, Column], Column]] = {
            "FormulaDetector": formula_presence,
            "TextStats": lambda text, formulas: rounded_statistics(text_statistics(text)),
            "TopicIdentifier": lambda text, formulas: main_topic(text),
        }

    def add(self, name: str, extractor: Callable[[Column, Column], Column]) -> None:
        self.found[name] = extractor

    def remove(self, name: str) -> None:
        self.found.pop(name, None)

    def columns(self, text: Column, formulas: Column) -> list[Column]:
        return [f(text, formulas).alias(name) for name, f in self.found.items()]
