"""Prompt building and reply cleaning for an instruction-following model.

All column expressions; the few-shot example block is a scalar subquery over at
most ``k`` training rows, evaluated once, never a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.text import py_strip, rest_from, strip_prefix

# System instructions by language.
SYSTEM_EN = (
    "You are a grammatical error correction assistant. "
    "Correct all grammatical errors in the given sentence. "
    "Output ONLY the corrected sentence — no explanation, no extra text."
)
SYSTEM_ES = (
    "Eres un asistente de corrección gramatical. "
    "Corrige todos los errores gramaticales en la oración dada. "
    "Devuelve ÚNICAMENTE la oración corregida — sin explicaciones ni texto adicional."
)
# Reply prefixes removed in this order, each at most once.
REPLY_PREFIXES = ("Corrected:", "Corrected sentence:", "Answer:", "Corregida:", "Oración corregida:")


# The pieces of the prompts and of the chat template.
SENTENCE, ASK, SHOWN, BETWEEN = "Sentence: ", "\nCorrected:", "\nCorrected: ", "\n\n"
CHAT_OPEN, CHAT_CLOSE = "<s>[INST] ", " [/INST]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_shot(sentence) -> Column:
    """F6."""
    return F.concat(F.lit(SENTENCE), _c(sentence), F.lit(ASK))


def example_block(examples: DataFrame, order: str = "_idx", src: str = "source",
                  tgt: str = "target") -> Column:
    """The few-shot examples joined by a blank line, as a scalar subquery."""
    agg = examples.agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(src).alias("s"),
                                             F.col(tgt).alias("t")))),
        lambda x: F.concat(F.lit(SENTENCE), x.getField("s"), F.lit(SHOWN), x.getField("t"))),
        BETWEEN))
    return agg.scalar()


def few_shot(sentence, lang, block: Column) -> Column:
    """F7 (+J4): examples, then the sentence; Spanish falls back to zero-shot."""
    s = _c(sentence)
    return F.when(_c(lang) == "es", zero_shot(s)).otherwise(
        F.concat(block, F.lit(BETWEEN), zero_shot(s)))


def chat_wrap(message, lang) -> Column:
    """F8: instruction-model chat template; English system text iff ``lang='en'``."""
    system = F.when(_c(lang) == "en", F.lit(SYSTEM_EN)).otherwise(F.lit(SYSTEM_ES))
    return F.concat(F.lit(CHAT_OPEN), system, F.lit(BETWEEN), _c(message), F.lit(CHAT_CLOSE))


def cut_prompt(generated, prompt) -> Column:
    """drop the prompt (by character count) from the generated text, strip."""
    return py_strip(rest_from(generated, F.length(_c(prompt)) + 1))


def clean_reply(reply, source) -> Column:
    """F10 + F11: strip, remove each known prefix once in list order, fall back
    to the source for an empty or missing reply."""
    t = py_strip(_c(reply))
    for p in REPLY_PREFIXES:
        t = strip_prefix(t, p)
    return F.coalesce(F.nullif(t, F.lit("")), _c(source))
