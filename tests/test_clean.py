import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import clean as C

VECTORS = [
    ("Text\fPage break", "TextPage break"),
    ("Página 1 de 10", ""),
    ("pg. 5", ""),
    ("Conteúdo Página 12", "Conteúdo"),
    ("1 2 3 4 5", ""),
    ("2024 12 31", "2024 12 31"),
    ("10 20 30", "10 20 30"),
    ("R$ 10,00 R$ 20,00", ""),
    ("R$ R$ R$", ""),
    ("10,00 20,00", ""),
    ("con-\ntinuo", "continuo"),
    ("Frase que\ncontinua.", "Frase que continua."),
    ("Frase finalizada.\nNova frase.", "Frase finalizada.\nNova frase."),
    ("Erro de extração....", "Erro de extração."),
    ("O que houve??", "O que houve?"),
    ("R$ 1.234,56", "R$"),
    ("Total de 1.500,00 reais", "Total de reais"),
    ("10.000.000", "0"),
    ("foto.jpg 2", "foto.j"),
    ("RELATÓRIO ANUAL", "## RELATÓRIO ANUAL"),
    ("ADMINISTRAÇÃO", "ADMINISTRAÇÃO"),
    ("Assunto: Teste", "### Assunto: Teste"),
    ("**Resumo**", "### Resumo"),
    ("a\nb\nc", "a b\nc"),
    ("25/02/2026 10:00\nTexto importante", ""),
    ("con- tinuou", "con- tinuou"),
    ("anÃ¡lise", "análise"),
    ("anÃ¡lise €", "anÃ¡lise €"),
    ("NÃO", "NÃO"),
    (None, ""),
    ("", ""),
    ("x<BR />y", "x y"),
]


def test_vectors(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(VECTORS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", C.clean(F.col("t")).alias("c")).collect()}
    assert got == {i: b for i, (_, b) in enumerate(VECTORS)}


def test_long_numeric_runs_do_not_overflow(spark):
    text = " ".join(str(i % 900) for i in range(20_000))
    df = spark.createDataFrame([(text,), ("R$ 1,00 " * 20_000,)], "t string")
    assert [r.c for r in df.select(C.clean(F.col("t")).alias("c")).collect()] == ["", ""]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123 ,.\nR$pg", max_size=60))
def test_possessive_repeats_change_nothing(text):
    greedy = {
        "axis_numbers": r"(?:\b\d{1,3}\b(?:\s+|,)?\s?){4,}",
        "price_runs": r"(?:R\$\s*\d+(?:[.,]\d{0,2})?\s*){2,}",
        "decimal_runs": r"(?:\d+[.,]\d{2}\s*){2,}",
    }
    for name, pattern in greedy.items():
        assert re.sub(C.PATTERNS[name][0], "", text) == re.sub(pattern, "", text)
