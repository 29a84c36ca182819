"""A small own lexicon of Spanish adjectives, inflected by rule; callers may pass theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tertulia.schema import LEXICON

_BASE = (
    "abierto activo amplio bueno claro completo corto directo distinto especializado gratuito "
    "largo listo malo moderno nuevo pequeño practico publico rapido seguro tecnico unico vivo "
    "actual digital especial facil dificil final general gran ideal importante inteligente "
    "interesante libre local mejor peor mayor menor natural oficial personal posible "
    "presente principal profesional real siguiente simple social util virtual"
).split()


def _forms(word: str) -> list[str]:
    if word.endswith("o"):
        return [word, word[:-1] + "a", word + "s", word[:-1] + "as"]
    return [word, word + ("s" if word[-1] in "ae" else "es")]


def spanish_adjectives(spark: SparkSession) -> DataFrame:
    rows = sorted({(form, "ADJ") for word in _BASE for form in _forms(word)})
    return spark.createDataFrame(rows, LEXICON)
