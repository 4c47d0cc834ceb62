import pytest
from pyspark.sql import functions as F

from parchmint.functions import formulas as FO
from parchmint.functions import metadata as M
from parchmint.functions import text as T
from parchmint.functions.code import guess_language, is_code_line, is_likely_text
from parchmint.functions.markdown import clean_markdown


@pytest.fixture(scope="session")
def apply(spark):
    def run(f, *values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
        got = [r.out for r in rows.select("i", f(F.col("t")).alias("out")).orderBy("i").collect()]
        return got[0] if len(got) == 1 else got

    return run


def test_normalize_steps(apply):
    assert apply(T.remove_invisible, "\ufeffa\u200bb\ufffec") == "abc"
    assert apply(T.normalize_linebreaks, "\n\na\r\n\r\n\r\nb\rc\n") == "a\n\nb\nc"
    assert apply(T.join_hyphenated, "a-\nb-\r\nc-") == "abc-"
    assert apply(T.remove_control, "a\x00b\x0bc\td\ne\x7f") == "abc\td\ne"
    assert apply(T.normalize_spaces, " a \t b\u00a0\n \n c\x1c ") == "a b\n\nc"
    assert apply(T.normalize_punctuation, "«a» – b , c.d!E") == '"a" - b, c. d! E'


def test_normalize_order(apply):
    # the hyphen rule comes after line ends are normalised; spaces may make three line ends again
    assert apply(T.normalize, "a-\n\nb") == "a\nb"
    assert apply(T.normalize, "a\n \n \nb") == "a\n\n\nb"
    assert apply(T.normalize, None, "") == ["", ""]
    assert apply(lambda c: T.normalize(c, True), "x ,y") == "x, y"


def test_whitespace_only(apply):
    assert apply(T.normalize_whitespace, "\u2003 a\r\n b\t\tc \n") == "a\n b c"


@pytest.mark.parametrize("f", [T.remove_invisible, T.normalize_linebreaks, T.remove_control, T.normalize_whitespace])
def test_idempotent(apply, f):
    texts = ["a\r\r\n\n\n\nb \t c", "\ufeff\u200b\n\n", "x\x00-\ny", ""]
    assert apply(f, *apply(f, *texts)) == apply(f, *texts)


def test_speech_cleaner(apply):
    text = "Добрый день, коллеги. Так, начнём с определений. Интеграл есть предел сумм. Коротко. Этакий пример длинный."
    assert apply(T.clean_speech, text) == "Интеграл есть предел сумм. Этакий пример длинный."
    assert apply(T.clean_speech, "") == ""


def test_sentences(apply):
    assert apply(T.sentences, "A b.  C?\nD! e", "", "one") == [["A b.", "C?", "D! e"][:2] + ["D!", "e"], [], ["one"]]


def test_symbol_repair(apply):
    assert apply(T.repair_symbols, "\uf061\uf06b\uf073\uf041\uf03d\uf0b3\uf0c1\uf027x") == "αμσΑ=≥∜*x"


def test_markdown(apply):
    text = "# Title\n\n> quote\n- **bold** and *it*\n1. [link](u) ![img $a_b$](v)\n~~gone~~ __b__ $x * y * z$ ***both***  _u_"
    assert apply(clean_markdown, text) == "Title\n\nquote\nbold and it\nlink\ngone b $x * y * z$ both u"
    assert apply(clean_markdown, "plain", "") == ["plain", ""]


def test_formulas(spark):
    text = "Let $a+b=c$ and $x^2 + y^2$ be. E=mc^2. \\[ \\sum  i \\] cost \\$5 and $ab$, p = 1\n$$\\int f$$"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in FO.extract_formulas(df).withColumn("back", FO.restore_formulas(F.col("text_with_placeholders"), F.col("formulas"))).collect()}
    r = rows[1]
    assert r.back == text
    assert all(text[f.start_pos : f.end_pos] == f.full for f in r.formulas)
    kinds = {f.full: (f.formula_type, f.original, f.normalized) for f in r.formulas}
    assert kinds["$a+b=c$"] == ("latex_inline", "a+b=c", "a+b=c")
    assert kinds["\\[ \\sum  i \\]"] == ("latex_display", "\\[ \\sum  i \\]", "\\sum i")
    assert kinds["E=mc^2."] == ("plain_text", "E=mc^2.", "E=mc**2.")
    assert "$ab$" not in kinds
    assert [f.start_pos for f in r.formulas] == sorted(f.start_pos for f in r.formulas)
    assert r.detection_stats.total == len(r.formulas) and rows[2].formulas == [] == rows[3].formulas
    only = FO.extract_formulas(df, methods=("latex_inline",)).collect()
    assert {f.formula_type for x in only for f in x.formulas} == {"latex_inline"}


def test_formula_search_is_not_slow():
    text = "a" + "-" * 20_000 + ":" + " =" * 5_000 + " x"
    FO.find_formulas(text)


def test_looks_like_formula(apply):
    told = apply(FO.looks_like_formula, "1.5", "a=b+1", "abcdefgh", "verylongword=another", "α+βγδεζηθ", "12-34")
    assert told == [False, True, False, False, True, True]


def test_code_lines(apply):
    lines = ["def f(x):", "The cat sat.", "    indented", ">>> 1", "x = {1; 2;}", "this is a line of many plain words", "key:", "", "and so"]
    assert apply(is_code_line, *lines) == [True, False, True, True, True, False, True, False, False]
    assert apply(is_likely_text, *lines)[1] and not apply(is_likely_text, *lines)[0]
    assert apply(guess_language, "def a:\n", "function f() {", "public static void main", '#include "x"', "using namespace std;", "package a;", "zzz") == ["python", "javascript", "java", "c/c++", "c++", "java", "unknown"]


def test_statistics_and_topics(apply):
    s = apply(M.text_statistics, "Two words. Two! [[FORMULA_1_2]]")
    assert (s.word_count, s.sentence_count, s.unique_words, s.character_count, s.is_short) == (3, 3, 2, 31, True)
    assert apply(M.text_statistics, "").word_count == 0
    assert apply(M.first_sentence, "  a\nb. c", "One? Two.", "none\nhere") == ["a", "One?", "none"]
    topics = apply(M.main_topic, "Теорема и формула.", "Функция", "нет темы", "Слово. Далее алгоритм и сервер")
    assert [(t.main_topic, t.source) for t in topics] == [("математика", "first_sentence"), ("математика", "first_sentence"), ("неизвестно", "unknown"), ("информатика", "full_text")]


def test_extractors_can_be_added_and_removed(spark):
    found = M.Extractors()
    found.add("length", lambda text, formulas: F.struct(F.length(text).alias("n")))
    found.remove("TopicIdentifier")
    df = FO.extract_formulas(spark.createDataFrame([(1, "some text")], "doc_id long, text string"))
    row = df.select(*found.columns(F.col("text"), F.col("formulas"))).first()
    assert row["length"].n == 9 and set(row.asDict()) == {"FormulaDetector", "TextStats", "length"}


def test_encoder_works_in_batches(spark):
    from parchmint.functions.encoder import encoder

    def load():
        return lambda values: [[len(v), len(values)] for v in values]

    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "i int, t string").coalesce(1)
    got = [list(r.e) for r in df.select("i", encoder(load, 2)(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == [[0, 2], [1, 2], [2, 2], [3, 2], [4, 1]]
