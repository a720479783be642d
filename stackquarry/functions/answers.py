"""Prompts, request bodies, replies: P07-P10, F09, F11."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackquarry import wording
from stackquarry.functions import variants
from stackquarry.functions.text import (
    contains_all,
    contains_any,
    fill,
    remove_all,
    squeeze_ends,
)

# ---- fixed values -----------------------------------------------------------
FAMILY_MARKS = [("anthropic", "anthropic"), ("amazon.titan", "titan"), ("meta.llama", "llama")]
ANTHROPIC_VERSION = "bedrock-2023-05-31"
# -----------------------------------------------------------------------------


def answer_prompt(context: Column, question: Column) -> Column:
    """P07."""
    return fill(wording.ANSWER_PROMPT, context=context, question=question)


def intent_prompt(question: Column) -> Column:
    """P08."""
    return F.concat(F.lit(wording.INTENT_PROMPT), question)


def model_family(kind: Column, model_id: Column) -> Column:
    """anthropic, titan, llama, sagemaker, openai; NULL when unsupported."""
    bedrock = reduce(
        lambda other, mark: F.when(F.contains(model_id, F.lit(mark[0])), F.lit(mark[1])).otherwise(other),
        reversed(FAMILY_MARKS),
        F.lit(None).cast("string"),
    )
    return (
        F.when(kind == "bedrock", bedrock)
        .when(kind == "sagemaker", F.lit("sagemaker"))
        .when(kind == "openai", F.lit("openai"))
    )


def supported_model(kind: Column, model_id: Column) -> Column:
    return model_family(kind, model_id).isNotNull()


def unsupported_message(kind: Column, model_id: Column) -> Column:
    return F.when(
        kind == "bedrock", F.concat(F.lit("unsupported Bedrock model: "), model_id)
    ).otherwise(F.concat(F.lit("unsupported model type: "), kind))


def request_body(
    kind: Column, model_id: Column, prompt: Column, max_tokens: Column, temperature: Column
) -> Column:
    """The JSON body a model family expects; NULL when unsupported."""
    family = model_family(kind, model_id)
    length = max_tokens.alias
    heat = temperature.alias("temperature")
    top_p = F.lit(1.0)
    bodies = {
        "anthropic": F.struct(
            F.lit(ANTHROPIC_VERSION).alias("anthropic_version"),
            length("max_tokens"),
            prompt.alias("prompt"),
            heat,
            top_p.alias("top_p"),
        ),
        "titan": F.struct(
            prompt.alias("inputText"),
            F.struct(length("maxTokenCount"), heat, top_p.alias("topP")).alias("textGenerationConfig"),
        ),
        "llama": F.struct(length("max_gen_len"), prompt.alias("prompt"), heat, top_p.alias("top_p")),
        "sagemaker": F.struct(length("max_tokens"), prompt.alias("prompt"), heat),
        "openai": F.struct(
            length("max_tokens"),
            F.array(F.struct(prompt.alias("content"), F.lit("user").alias("role"))).alias("messages"),
            heat,
        ),
    }
    return reduce(
        lambda other, item: F.when(family == item[0], F.to_json(item[1])).otherwise(other),
        bodies.items(),
        F.lit(None).cast("string"),
    )


# where the reply text of each family sits; the first non-empty one counts
REPLY_PATHS = {
    "anthropic": ["$.completion"],
    "titan": ["$.results[0].outputText"],
    "llama": ["$.generation"],
    "sagemaker": ["$.response", "$.output", "$.text"],
    "openai": ["$.choices[0].message.content"],
}
# what the texts lie in
REPLY_CONTAINERS = {
    "titan": [("$.results", "ARRAY"), ("$.results[0]", "OBJECT")],
    "openai": [("$.choices", "ARRAY"), ("$.choices[0]", "OBJECT"), ("$.choices[0].message", "OBJECT")],
}


def _reply(body: Column, family: str) -> Column:
    reply = F.try_parse_json(body)
    paths = REPLY_PATHS[family]
    fits = reduce(
        lambda a, b: a & b,
        [variants.text_fits(reply, p) for p in paths]
        + [variants.container_fits(reply, *c) for c in REPLY_CONTAINERS.get(family, [])],
        variants.decodes_as_object(reply),
    )
    text = F.coalesce(
        *[F.nullif(variants.text_or_null(reply, p), F.lit("")) for p in paths], F.lit("")
    )
    failed = F.lit(f"failed to parse {family} response")
    if family == "openai":
        empty = variants.field(reply, "$.choices[0]").isNull()
        error = F.when(~fits, failed).when(empty, F.lit("no response from model"))
    else:
        error = F.when(~fits, failed)
    return F.struct(
        F.when(error.isNull(), squeeze_ends(text)).alias("text"), error.alias("error")
    )


def extract_response(kind: Column, model_id: Column, body: Column) -> Column:
    """P10: struct of (text, error) read from a model reply."""
    family = model_family(kind, model_id)
    unsupported = F.struct(
        F.lit(None).cast("string").alias("text"), unsupported_message(kind, model_id).alias("error")
    )
    return reduce(
        lambda other, name: F.when(family == name, _reply(body, name)).otherwise(other),
        REPLY_PATHS,
        unsupported,
    )


def _is_noise(line: Column) -> Column:
    return reduce(lambda a, b: a | b, [contains_all(line, words) for words in wording.NOISE_LINES])


def clean_response(text: Column) -> Column:
    """drop filler and noise; shorten an answer of more than 500 bytes.

    The shortening looks at the first three raw pieces between dots and keeps the
    useful ones; when none is useful the text stays as it is.
    """
    body = remove_all(squeeze_ends(text), wording.FILLER_PHRASES)
    lines = F.filter(
        F.transform(F.split(body, "\n", -1), squeeze_ends), lambda line: (line != "") & ~_is_noise(line)
    )
    # the joined lines and the kept sentences are each used more than once, so
    # they are bound by a one-element transform instead of being spelled out twice
    return F.get(F.transform(F.array(F.array_join(lines, "\n")), _shortened), F.lit(0))


def _shortened(answer: Column) -> Column:
    pieces = F.slice(
        F.split(answer, r"\.", wording.KEPT_SENTENCES + 1), 1, wording.KEPT_SENTENCES
    )
    useful = F.filter(
        F.transform(pieces, squeeze_ends),
        lambda s: (s != "") & ~contains_any(s, wording.WEAK_SENTENCES),
    )
    summary = F.array_join(useful, ". ")
    return squeeze_ends(
        F.when(
            (F.octet_length(answer) > wording.LONG_ANSWER_BYTES) & (summary != ""),
            F.concat(summary, F.lit(".")),
        ).otherwise(answer)
    )
