"""Prompts for the generation model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the default instruction.
SYSTEM = "You are a helpful AI assistant. Answer the question based on the provided context. If the answer is not in the context, say so clearly."


def context_block(contexts: Column) -> Column:
    """Numbered contexts, a blank line between them."""
    return F.array_join(F.transform(contexts, lambda c, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), c)), "\n\n")


def prompt(model: Column, question: Column, contexts: Column, system: Column | None = None) -> Column:
    """The prompt in the form that the named model family expects."""
    body = F.concat(F.coalesce(system, F.lit(SYSTEM)) if system is not None else F.lit(SYSTEM), F.lit("\n\nContext:\n"), context_block(contexts), F.lit("\n\nQuestion: "), question)
    name = F.lower(model)
    return (
        F.when(name.contains("mistral") | name.contains("instruct"), F.concat(F.lit("<s>[INST] "), body, F.lit("\n\nAnswer: [/INST]")))
        .when(name.contains("gemma"), F.concat(F.lit("<start_of_turn>user\n"), body, F.lit("<end_of_turn>\n<start_of_turn>model\n")))
        .otherwise(F.concat(body, F.lit("\n\nAnswer:")))
    )
