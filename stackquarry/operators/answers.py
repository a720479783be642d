"""Answering questions in bulk around a caller's model function: U01-U03, J06, K04, P05, P06.

Order of the steps: scrub, route, prompt, gate, call, record usage, clean,
unscrub. Everything but the call itself is Catalyst expressions; the call is an
Arrow-batched function that sees only the backend name and the prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackquarry.functions.answers import answer_prompt, clean_response
from stackquarry.functions.money import NANO_PER_MICRO, cost_nano, estimate_micro, token_estimate, with_prices
from stackquarry.functions.questions import decoded_query, route_backend, unknown_question
from stackquarry.functions.redact import MAP_TYPE, numbered_entries, numbered_text, scrub, text_pieces, unscrub
from stackquarry.functions.text import squeeze_ends
from stackquarry.operators.budget import (
    GROUP,
    ORDER,
    border_groups,
    group_back,
    group_text,
    refusal_message,
    slice_summaries,
)
from stackquarry.operators.ordered import join_same, ordered_chunks
from stackquarry.sources.checkpoints import written
from stackquarry.wording import NO_SNAPSHOT, NOT_IMPLEMENTED

# (backend names, prompts) -> replies, one batch at a time
Backend = Callable[[pd.Series, pd.Series], pd.Series]


def question_context(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``context``, the project's state as compact JSON with sorted keys.

    ``documents`` has one row per project. Join last and after filtering: every
    question carries its context from here on. NULL context means no state.
    """
    return questions.join(_contexts(documents), "project", "left")


def _contexts(documents: DataFrame) -> DataFrame:
    return documents.select("project", F.to_json(F.parse_json("doc")).alias("context"))


def redacted_context(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """J06 for questions that are to be sent: add ``context_parts``, the project's state
    redacted into pieces. The patterns run once per project, below the join, however many
    questions ask about it; ``prepare_prompts`` numbers the placeholders for each question.
    NULL means no state."""
    parts = _contexts(documents).select("project", text_pieces(F.col("context")).alias("context_parts"))
    return questions.join(parts, "project", "left")


def prepare_prompts(
    questions: DataFrame,
    has_architecture_backend: bool = True,
    classifier: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Scrub, route and build the prompt.

    Needs columns question and either context or context_parts; adds redactions, backend and
    prompt. The route is decided on the question as asked; ``classifier`` (U02) replaces the
    keyword rule by any expression or pandas UDF over the question.
    """
    backend = (
        classifier(F.col("question"))
        if classifier
        else route_backend(F.col("question"), has_architecture_backend)
    )
    routed = questions.withColumn("backend", backend)
    if "context_parts" in questions.columns:
        parts, seen = F.col("context_parts"), F.size("redactions")
        hidden = scrub(routed, ["question"])
        hidden = hidden.select(
            *[name for name in hidden.columns if name != "redactions"],
            numbered_text(parts, seen).alias("scrubbed_context"),
            F.concat("redactions", F.coalesce(numbered_entries(parts, seen), F.from_json(F.lit("[]"), MAP_TYPE))).alias("redactions"),
        )
    else:
        hidden = scrub(routed, ["question", "context"])
    return hidden.withColumn(
        "prompt", answer_prompt(F.col("scrubbed_context"), F.col("scrubbed_question"))
    ).drop("scrubbed_question", "scrubbed_context")


def _known(questions: DataFrame) -> Column:
    """Whether a question's project has a state."""
    return F.col("context_parts" if "context_parts" in questions.columns else "context").isNotNull()


def call_backend(df: DataFrame, backend: Backend) -> DataFrame:
    """Add ``reply``. Only two text columns cross to Python; a NULL prompt is not sent."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for names, prompts in parts:
            known = prompts.notna()
            if known.all():
                yield backend(names, prompts)
            else:
                replies = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
                if known.any():
                    replies[known] = backend(names[known], prompts[known]).to_numpy()
                yield replies

    return df.withColumn("reply", ask.asNondeterministic()("backend", "prompt"))


def finish_answers(df: DataFrame) -> DataFrame:
    """Clean, then put the originals back, then trim for display."""
    return df.withColumn(
        "answer", squeeze_ends(unscrub(clean_response(F.col("reply")), F.col("redactions")))
    )


def answer_batch(
    questions: DataFrame,
    backend: Backend,
    has_architecture_backend: bool = True,
    classifier: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """U01 without a budget: adds backend, answer and error. One pass: a question without a
    context has no prompt and is not sent."""
    ready = prepare_prompts(questions, has_architecture_backend, classifier)
    ready = ready.withColumn("prompt", F.when(_known(questions), F.col("prompt")))
    missing = F.when(~_known(questions), F.lit(NO_SNAPSHOT))
    answered = finish_answers(call_backend(ready, backend)).withColumn("error", missing)
    return answered.drop("redactions", "prompt", "reply", "context_parts")


def answer_within_budget(
    questions: DataFrame,
    backend: Backend,
    prices: DataFrame,
    has_architecture_backend: bool = True,
    classifier: Callable[[Column], Column] | None = None,
    chunks: int | None = None,
    most_reply_tokens: int | None = None,
) -> DataFrame:
    """U01 with the budget gate in front of each call.

    questions: user_id, day, ts, req_id, question, context or context_parts, model_id,
    limit_micro.
    A refused question is never sent. The cost of an admitted one is known only
    after its reply, so a (user, day) advances in order; different groups advance
    together and their next prompts share one batch. Groups that cross chunk
    borders go on chunk by chunk, in as many rounds as a group still has budget for.
    Questions without a context are not sent and do not count.

    ``most_reply_tokens`` states a bound on a reply. With it the prompts of a (user, day)
    that fit whatever the replies before them cost are reserved together, go out in one
    batch and are settled in order afterwards. The decisions are the same; a reply beyond
    the bound is an error.
    """
    ready = prepare_prompts(questions, has_architecture_backend, classifier)
    known = _known(questions)
    priced = with_prices(ready.filter(known), prices).withColumns(
        {
            "prompt_tokens": token_estimate(F.col("prompt")),
            "est_micro": estimate_micro(token_estimate(F.col("prompt"))),
            "cost_micro": F.lit(0).cast("bigint"),
            "opening": F.lit(0).cast("bigint"),
            "nano_in": cost_nano(F.lit(1), F.lit(0)),
            "nano_out": cost_nano(F.lit(0), F.lit(1)),
        }
    ).drop("input_cost", "output_cost", "speed", "quality")
    pieces = ordered_chunks(priced, GROUP, ORDER, chunks)
    decided = _rounds(pieces, backend, most_reply_tokens)
    finished = finish_answers(pieces.drop("cost_micro").join(decided, "req_id"))
    finished = finished.withColumn("error", refusal_message()).drop(
        "redactions", "prompt", "reply", "chunk", "opening", "nano_in", "nano_out", "prompt_tokens", "context_parts"
    )
    missing = ready.filter(~known).drop("redactions", "prompt", "context_parts")
    return finished.unionByName(
        missing.withColumns({"admitted": F.lit(False), "error": F.lit(NO_SNAPSHOT)}),
        allowMissingColumns=True,
    )


def _rounds(pieces: DataFrame, backend: Backend, most: int | None = None) -> DataFrame:
    groups = border_groups(pieces)
    summaries = slice_summaries(pieces, groups, {}) if groups else {}
    later = {group: chunks[1:] for group, chunks in groups.items()}
    # first round: everything but the later slices of groups that cross a border
    postponed = [(*g, chunk) for g, chunks in later.items() for chunk in chunks]
    tables = [written(_called(_without(pieces, postponed), [], backend, most), "answers")]
    spent = _ends(tables[0], list(groups), pieces)
    while any(later.values()):
        now = []
        for group, chunks in later.items():
            while chunks:
                chunk = chunks.pop(0)
                now.append((*group, chunk, spent[group]))
                piece = summaries[*group, chunk]
                if spent[group] + piece["least"] <= piece["limit"]:
                    break
        table = written(_called(_only(pieces, now), now, backend, most), "answers")
        spent.update(_ends(table, list({tuple(n[:2]) for n in now}), pieces))
        tables.append(table)
    done = tables[0]
    for table in tables[1:]:
        done = done.unionByName(table)
    return done.drop("user_text", "day_text")


def _keys(pieces: DataFrame, rows: list[tuple], extra: list[T.StructField] = []) -> DataFrame:
    schema = T.StructType([*(pieces.schema[c] for c in [*GROUP, "chunk"]), *extra])
    return F.broadcast(pieces.sparkSession.createDataFrame(rows, schema))


def _without(pieces: DataFrame, slices: list[tuple]) -> DataFrame:
    if not slices:
        return pieces
    return join_same(pieces, _keys(pieces, slices), [*GROUP, "chunk"], "left_anti")


def _only(pieces: DataFrame, slices: list[tuple]) -> DataFrame:
    chosen = pieces.filter(F.col("chunk").isin(sorted({s[2] for s in slices})))
    return join_same(chosen, _keys(pieces, [s[:3] for s in slices]), [*GROUP, "chunk"], "left_semi")


def _ends(table: DataFrame, groups: list[tuple], pieces: DataFrame) -> dict[tuple, int]:
    if not groups:
        return {}
    keys = table.sparkSession.createDataFrame(groups, T.StructType([pieces.schema[c] for c in GROUP]))
    ends = (
        join_same(table.select("*", *group_back(pieces)), F.broadcast(keys), GROUP)
        .groupBy(*GROUP)
        .agg(F.max(F.col("spent_before_micro") + F.col("cost_micro")).alias("end"))
    )
    return {(r["user_id"], r["day"]): r["end"] for r in ends.collect()}


def _called(pieces: DataFrame, starts: list[tuple], backend: Backend, most: int | None = None) -> DataFrame:
    start_field = [T.StructField("start", T.LongType())]
    if starts:
        rows = join_same(pieces, _keys(pieces, starts, start_field), [*GROUP, "chunk"], "left")
    else:
        rows = pieces.withColumn("start", F.lit(0).cast("bigint"))
    slice_key = [*GROUP, "chunk"]
    ordered = (
        rows.repartition(*slice_key)
        .sortWithinPartitions(*slice_key, *ORDER)
        .select(
            *group_text(), "chunk", "req_id", "backend", "prompt",
            "prompt_tokens", "nano_in", "nano_out", "est_micro", "limit_micro",
            F.coalesce("start", F.lit(0)).alias("start"),
        )
    )
    kept = ["user_text", "day_text", "req_id"]
    schema = T.StructType(
        [ordered.schema[c] for c in kept]
        + [
            T.StructField("admitted", T.BooleanType()),
            T.StructField("spent_before_micro", T.LongType()),
            T.StructField("cost_micro", T.LongType()),
            T.StructField("reply", T.StringType()),
        ]
    )

    def micro(nano: int) -> int:
        return (int(nano) + NANO_PER_MICRO // 2) // NANO_PER_MICRO

    def reserved(queue, cursor, spent, before, est, limit, tokens, nano_in, nano_out) -> tuple[int, list[int]]:
        """The prompts of a queue, from the cursor on, that are admitted whatever the
        replies to those before them cost, one at least unless all are refused; and where
        the queue goes on."""
        own: list[int] = []
        most_spent = spent
        while cursor < len(queue):
            at = queue[cursor]
            if most_spent + est[at] <= limit[at]:
                own.append(at)
                if most is None:
                    return cursor + 1, own
                most_spent += micro(tokens[at] * nano_in[at] + most * nano_out[at])
            elif own:
                # open until the replies before it are in
                break
            else:
                before[at] = spent
            cursor += 1
        return cursor, own

    def advance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: dict[tuple, int] = {}
        for batch in batches:
            key = list(zip(batch["user_text"].tolist(), batch["day_text"].tolist(), batch["chunk"].tolist()))
            queues: dict[tuple, list[int]] = {}
            for position, k in enumerate(key):
                queues.setdefault(k, []).append(position)
            spent = {k: carried.get(k, int(batch["start"].iloc[q[0]])) for k, q in queues.items()}
            last = key[-1]
            admitted = [False] * len(key)
            before = [0] * len(key)
            cost = [0] * len(key)
            reply: list[str | None] = [None] * len(key)
            est, limit = batch["est_micro"].tolist(), batch["limit_micro"].tolist()
            tokens, nano_in, nano_out = (batch[c].tolist() for c in ("prompt_tokens", "nano_in", "nano_out"))
            cursor = dict.fromkeys(queues, 0)
            active = list(queues)
            while active:
                sent: list[int] = []
                for k in active:
                    cursor[k], own = reserved(queues[k], cursor[k], spent[k], before, est, limit, tokens, nano_in, nano_out)
                    sent += own
                if not sent:
                    break
                rows = batch.iloc[sent]
                for at, text in zip(sent, backend(rows["backend"], rows["prompt"])):
                    tokens_out = len(text.encode()) // 4
                    if most is not None and tokens_out > most:
                        raise ValueError(f"a reply of {tokens_out} tokens is beyond the stated bound of {most}")
                    cost[at] = micro(tokens[at] * nano_in[at] + tokens_out * nano_out[at])
                    admitted[at], reply[at], before[at] = True, text, spent[key[at]]
                    spent[key[at]] += cost[at]
                active = list(dict.fromkeys(key[at] for at in sent))
            carried = {last: spent[last]}
            out = batch[kept].copy()
            out["admitted"], out["spent_before_micro"] = admitted, before
            out["cost_micro"], out["reply"] = cost, reply
            yield out

    return ordered.mapInPandas(advance, schema)


def first_valid_chunk(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per request the first chunk that mentions an intent and decodes, else unknown.

    requests: req_id, text. The parsed reply is made before the aggregate, which
    keeps one row per request and task.
    """
    raw = F.lit(None).cast("string")
    readable = (
        chunks.filter(F.contains("response", F.lit("intent")))
        .withColumn("parsed", decoded_query(F.col("response"), raw))
        .filter(F.col("parsed").isNotNull())
    )
    first = readable.groupBy("req_id").agg(F.min_by("parsed", "chunk_idx").alias("parsed"))
    joined = requests.join(first, "req_id", "left")
    return joined.withColumn(
        "parsed",
        F.coalesce(
            F.when(F.col("parsed").isNotNull(), F.col("parsed").withField("raw_query", F.col("text"))),
            unknown_question(F.col("text")),
        ),
    )


def result_envelope(df: DataFrame, query: str, data: str = "data", error: str = "error") -> DataFrame:
    """Query, data (JSON text), error, success."""
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    return df.select(
        F.col(query).alias("query"),
        F.when(~failed, F.col(data)).alias("data"),
        F.when(failed, F.col(error)).alias("error"),
        (~failed).alias("success"),
    )


def not_implemented(intent: Column) -> Column:
    """The answer for any other intent, as JSON."""
    return F.to_json(F.struct(intent.alias("intent"), F.lit(NOT_IMPLEMENTED).alias("message")))
