"""Job-role templates: which question numbers belong to which subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASIC = "Conhecimentos Básicos"
SPECIFIC = "Conhecimentos Específicos"

# Template id, label, board, question total.
TEMPLATES = [
    ("agente-tecnologia", "Agente de Tecnologia", "Cesgranrio", 70),
    ("agente-comercial", "Agente Comercial", "Cesgranrio", 70),
    ("escriturario", "Escriturário", "Cesgranrio", 70),
    ("escriturario-agente-comercial", "Escriturário – Agente Comercial e Administrativo", "Cesgranrio", 70),
]

# Template id, seq, subject, area, first, last, points each, has shared text.
SUBJECT_RANGES = [
    ("agente-tecnologia", 1, "Língua Portuguesa", BASIC, 1, 10, 1.5, True),
    ("agente-tecnologia", 2, "Língua Inglesa", BASIC, 11, 15, 1.0, True),
    ("agente-tecnologia", 3, "Matemática", BASIC, 16, 20, 1.5, False),
    ("agente-tecnologia", 4, "Atualidades do Mercado Fin.", BASIC, 21, 25, 1.0, False),
    ("agente-tecnologia", 5, "Probabilidade e Estatística", SPECIFIC, 26, 30, 1.5, False),
    ("agente-tecnologia", 6, "Conhecimentos Bancários", SPECIFIC, 31, 40, 1.5, False),
    ("agente-tecnologia", 7, "Tecnologia da Informação", SPECIFIC, 41, 70, 1.5, False),
    ("agente-comercial", 1, "Língua Portuguesa", BASIC, 1, 10, 1.5, True),
    ("agente-comercial", 2, "Língua Inglesa", BASIC, 11, 15, 1.0, True),
    ("agente-comercial", 3, "Matemática", BASIC, 16, 20, 1.5, False),
    ("agente-comercial", 4, "Atualidades do Mercado Fin.", BASIC, 21, 25, 1.0, False),
    ("agente-comercial", 5, "Matemática Financeira", SPECIFIC, 26, 30, 1.5, False),
    ("agente-comercial", 6, "Conhecimentos Bancários", SPECIFIC, 31, 40, 1.5, False),
    ("agente-comercial", 7, "Conhecimentos de Informática", SPECIFIC, 41, 55, 1.5, False),
    ("agente-comercial", 8, "Vendas e Negociação", SPECIFIC, 56, 70, 1.5, False),
    ("escriturario", 1, "Língua Portuguesa", BASIC, 1, 10, 1.5, True),
    ("escriturario", 2, "Língua Inglesa", BASIC, 11, 15, 1.0, True),
    ("escriturario", 3, "Matemática", BASIC, 16, 20, 1.5, False),
    ("escriturario", 4, "Atualidades do Mercado Fin.", BASIC, 21, 25, 1.0, False),
    ("escriturario", 5, "Matemática Financeira", SPECIFIC, 26, 30, 1.5, False),
    ("escriturario", 6, "Conhecimentos Bancários", SPECIFIC, 31, 45, 1.5, False),
    ("escriturario", 7, "Vendas e Negociação", SPECIFIC, 46, 60, 1.5, False),
    ("escriturario", 8, "Conhecimentos de Informática", SPECIFIC, 61, 70, 1.5, False),
    ("escriturario-agente-comercial", 1, "Língua Portuguesa", BASIC, 1, 10, 1.5, True),
    ("escriturario-agente-comercial", 2, "Língua Inglesa", BASIC, 11, 15, 1.0, True),
    ("escriturario-agente-comercial", 3, "Matemática", BASIC, 16, 20, 1.5, False),
    ("escriturario-agente-comercial", 4, "Atualidades do Mercado Fin.", BASIC, 21, 25, 1.0, False),
    ("escriturario-agente-comercial", 5, "Conhecimentos Bancários", SPECIFIC, 26, 45, 1.5, False),
    ("escriturario-agente-comercial", 6, "Atualidades", SPECIFIC, 46, 50, 1.0, False),
    ("escriturario-agente-comercial", 7, "Matemática Financeira", SPECIFIC, 51, 55, 1.5, False),
    ("escriturario-agente-comercial", 8, "Vendas e Negociação", SPECIFIC, 56, 70, 1.5, False),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TEMPLATES, "template_id string, label string, board string, total_questions int"
    )


def subject_ranges(spark: SparkSession) -> DataFrame:
    """The 31-row dimension; its size is fixed, so joins may broadcast it."""
    return spark.createDataFrame(
        SUBJECT_RANGES,
        "template_id string, seq int, subject string, area string, "
        "first int, last int, points_each double, has_shared_text boolean",
    )
