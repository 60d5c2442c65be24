import pytest
from pyspark.sql import functions as F

from pathloom.functions import answers as an
from pathloom.functions import expressions as ex
from pathloom.functions import judge, prompts


@pytest.mark.parametrize(
    ("ref", "pred", "want"),
    [
        ("0.5", "50", True), ("1", "100", False), (r"\frac{1}{2}", "1/2", True), ("x^2+2x+1", "(x+1)^2", True), ("(1,2]", "(1, 4/2]", True), ("[1,2]", "(1,2]", False), (r"\sqrt{8}", r"2\sqrt2", True),
        ("x=5", "5", True), ("5 cm", "5", True), ("abc", "def", False), ("3:4", r"\frac{3}{4}", True), (r"\text{yes}", "true", True), ("1,234", "1234", False), ("2021-04-03", "03/04/2021", True),
        ("Monday", "mon", True), (r"\begin{pmatrix}1\\2\end{pmatrix}", r"\begin{pmatrix}1\\\frac{4}{2}\end{pmatrix}", True), ("", "5", False), ("5", "", False), ("7", "π", False), (r"\frac{2}{4}", "0.5", True), ("10", "10.0", True),
    ],
)
def test_equality(ref, pred, want):
    assert an.answers_equal(ref, pred) is want


def test_sets_and_bags():
    assert an.answers_equal("1,2,3", "3,2,1", True) and not an.answers_equal("1,2,3", "3,2", True)
    assert an.answers_equal(None, "1") is None and an.answers_equal("1", None) is False
    assert an.bag_equal(r"\boxed{1}, \boxed{2}", "2,1") and not an.bag_equal("1,2", "1")
    assert an.bag_equal("x=2y", "2x=4y") and not an.bag_equal("x=2y", "x=3y")
    assert an.bag_equal(r"1\pm\sqrt{2}", r"1-\sqrt2,1+\sqrt2") and an.bag_equal("0.5", "50") and an.bag_equal("3.14", "3.15", 0.02)
    assert not an.bag_equal(r"\boxed{1", "1")


def test_extraction():
    assert an.extract_boxed(r"so \boxed{\frac{1}{2}} ok") == r"\frac{1}{2}" and an.extract_boxed("") == ""
    assert an.extract_boxed(r"\boxed 5$ x") == "5" and an.extract_boxed(r"\boxed{a\}b}") == r"a\}b"
    assert an.boxed_solution("none") is None and an.boxed_solution(r"\fbox{3}") is None and an.boxed_solution(r"\boxed{\frac{1}{2}} .") == r"\frac{1}{2}"
    assert an.raw_answer("Therefore the final answer is 7.") == "7" and an.raw_answer("#### 12") != "" and an.raw_answer("sum $a+b$ then") == "a+b"
    assert an.raw_answer("we get 3 and then 1,234 apples") == "1234" and an.raw_answer("nothing") == ""


def test_words():
    assert an.normalize("north") == "False" and an.normalize("twenty") == "20" and an.normalize("zero") == "zero"
    assert an.date_time("13:05") == "13:05:00" and an.date_time("1:05 PM") == "13:05:00" and an.date_time("13/13/2021") is None


def test_expressions():
    assert ex.equal(r"\frac{1}{1+x}+\sin^2 x+\cos^2 x", r"1+(1+x)^{-1}") and not ex.equal("x", "y") and ex.equal("2^{10}", "1024") and ex.equal("5!", "120") and ex.equal("e^{i\\pi}", "-1")
    with pytest.raises(ex.NotAnExpression):
        ex.parse("(1")


def test_columns(spark):
    df = spark.createDataFrame([(1, "0.5", "50", "ind the"), (2, None, "1", None), (3, "1", None, ""), (4, "x" * 5000, "y", "q")], "id int, r string, p string, q string")
    assert {r.id: r.correct for r in judge.judged(df, "r", "p", ["id"], query="q").collect()} == {1: True, 2: None, 3: False, 4: False}
    dates = ["03/04/2021", "2021/4/3", "2021-04-03 7:05", "13:05", "25:00", "31/02/2021", "x", "12/31/2020"]
    d = spark.createDataFrame([(x,) for x in dates], "t string")
    got = {r.t: r.x for r in d.select("t", judge.date_time(F.col("t")).alias("x")).collect()}
    assert got == {x: an.date_time(x) for x in dates}
    n = spark.createDataFrame([(0.5, 50.0), (1.0, 100.0), (3.0, 3.0), (0.0, 1.0)], "a double, b double")
    assert [r.x for r in n.select(judge.numeric_equal(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, False]


def test_prompts(spark):
    df = spark.createDataFrame([("q ",)], "q string")
    text = df.select(prompts.render(F.col("q"), prompts.TEMPLATES["qa"], [("a", "b")]).alias("x")).first().x
    assert text == "User:\na\n\nAssistant:\nb\n\nUser:\nq \n\nAssistant:\n"
    t = spark.createDataFrame([([5, prompts.THINK_END, 7, 2], True), ([5, 6], True), ([5, 6], False), ([], False)], "t array<int>, on boolean")
    rows = [tuple(r.s) for r in t.select(prompts.thinking_split(F.col("t"), F.col("on"), 2, [2]).alias("s")).collect()]
    assert rows == [(1, 2, "complete", True, False), (2, 0, "missing_end_marker", False, True), (0, 2, "disabled", False, True), (0, 0, "disabled", False, False)]
    m = spark.createDataFrame([("a|b\nc", "Qwen3-8B-Instruct")], "t string, n string")
    assert tuple(m.select(prompts.markdown_cell(F.col("t")), prompts.model_depth(F.col("n"))).first()) == ("a\\|b c", 36)
